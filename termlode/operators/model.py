"""The vector-space model as four DataFrames: postings, vocabulary, norms and totals.

``postings(doc_id, term, tf, w)``, ``vocab(term, df, idf)``, ``doc_norms(doc_id, norm)`` and ``meta(n_docs, vocab_size)``, with
``w = (1 + log2 tf) * log2(N / df)``.  No smoothing: a term of every document weighs nothing.

Two profiles differ in the tokens and in N:

* ``engine``: tokens between blanks, stop words and one-byte tokens out, N is the number of rows, ranking gives the k best;
* ``oracle``: tokens between separators, lower case, stop words out, N is the number of documents with a token, ranking gives all.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlode.functions import text as T
from termlode.functions.stem import stem_tokens
from termlode.functions.stopwords import SEPARATORS, as_set
from termlode.plans.scratch import cut_lineage


@dataclass(frozen=True)
class TextOptions:
    """How text becomes terms.  ``clean``: all normalisation steps first, for documents and queries alike."""

    profile: str = "engine"
    clean: bool = True
    stem: bool = True
    language: str = "english"
    stopwords: frozenset[str] = field(default_factory=lambda: as_set(None))
    separators: tuple[str, ...] = SEPARATORS

    def __post_init__(self) -> None:
        if self.profile not in ("engine", "oracle"):
            raise ValueError(f"unknown profile {self.profile!r}")

    def tokens(self, c: Column, is_query: bool = False) -> Column:
        """Terms of a text before stemming, as an array."""
        if self.clean:
            c = T.clean_text(c)
        if self.profile == "oracle":
            return T.filter_tokens(T.tokenize_separators(c, self.separators), self.stopwords)
        return T.filter_tokens(T.tokenize_blanks(T.lower(c) if is_query and not self.clean else c), self.stopwords, least_bytes=2)


def with_stopwords(words: Iterable[str], **options) -> TextOptions:
    return TextOptions(stopwords=frozenset(words), **options)


def picked(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, text)`` under the model's own names, whatever else the table holds."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def count_terms(rows: DataFrame, key: str, options: TextOptions, is_query: bool = False) -> DataFrame:
    """``(key, term, tf)`` of ``rows(key, text)``; filters run before stemming, and texts are stemmed as they pass, without a join."""
    tokens = options.tokens(F.col("text"), is_query)
    terms = rows.select(key, F.explode(stem_tokens(tokens, options.language) if options.stem else tokens).alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def tf_weight(tf: Column) -> Column:
    return F.when(tf > 0, 1 + F.log2(tf)).otherwise(F.lit(0.0))


def idf_weight(n_docs: Column, df: Column) -> Column:
    return F.when(df > 0, F.log2(n_docs / df)).otherwise(F.lit(0.0))


@dataclass
class Model:
    """A corpus and its statistics.  ``docs(doc_id, text)`` are all rows, also those without a term."""

    docs: DataFrame
    tf: DataFrame
    vocab: DataFrame
    postings: DataFrame
    doc_norms: DataFrame
    meta: DataFrame
    options: TextOptions

    def _ask(self, term: str, strict: bool) -> None:
        if strict and not self.vocab.where(F.col("term") == term).limit(1).count():
            raise KeyError(term)

    def freq(self, term: str, doc_id: int, *, strict: bool = False) -> DataFrame:
        """``(freq)``: occurrences of a term in a document, 0 if none; an unknown term gives no row, or raises KeyError if ``strict``."""
        self._ask(term, strict)
        held = self.tf.where((F.col("term") == term) & (F.col("doc_id") == doc_id)).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("freq"))
        known = self.vocab.where(F.col("term") == term).select(F.lit(1).alias("known")).limit(1)
        return held.join(known).select("freq")

    def term_weight(self, term: str, doc_id: int, *, strict: bool = False) -> DataFrame:
        """``(tf_weight)`` as :meth:`freq`."""
        return self.freq(term, doc_id, strict=strict).select(tf_weight(F.col("freq")).alias("tf_weight"))


def model_from_counts(docs: DataFrame, tf: DataFrame, options: TextOptions) -> Model:
    """The model over term counts that are already there."""
    if options.profile == "oracle":
        n_docs = tf.agg(F.countDistinct("doc_id").alias("n_docs"))
    else:
        n_docs = docs.agg(F.count("*").alias("n_docs"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    vocab = df.join(F.broadcast(n_docs)).select("term", "df", idf_weight(F.col("n_docs"), F.col("df")).alias("idf"))  # n_docs is one row
    postings = weighted(tf, vocab)
    doc_norms = norms_of(docs, postings)
    meta = n_docs.join(F.broadcast(vocab.agg(F.count("*").alias("vocab_size"))))
    return Model(docs, tf, vocab, postings, doc_norms, meta, options)


def weighted(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, w)``."""
    return tf.join(vocab, "term").select("doc_id", "term", "tf", (tf_weight(F.col("tf")) * F.col("idf")).alias("w"))


def norms_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """``(doc_id, norm)`` for every document; 0 without a term."""
    own = postings.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return docs.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def build_model(df: DataFrame, key: str, text: str, options: TextOptions | None = None, *, entries: int = 0, materialise: str = "") -> Model:
    """Model of a table.  ``entries``: only ids below it (0 or more than there are: all).

    ``materialise``: "counts" writes the term counts once, so that the text is taken apart once and not for every table that is made from
    them; "weights" also writes vocabulary and weights, for searches, which read both several times.
    Ids are expected to be unique; documents keep their own id, whatever gaps or NULL texts there are.
    """
    if entries < 0:
        raise ValueError("entries must not be negative")
    if materialise not in ("", "counts", "weights"):
        raise ValueError(f"unknown materialise {materialise!r}")
    options = options or TextOptions()
    docs = picked(df, key, text)
    if entries:
        docs = docs.where(F.col("doc_id") < entries)
    tf = count_terms(docs, "doc_id", options)
    model = model_from_counts(docs, cut_lineage(tf, "tf") if materialise else tf, options)
    if materialise == "weights":
        model.vocab = cut_lineage(model.vocab, "vocab")
        model.postings = cut_lineage(weighted(model.tf, model.vocab), "postings")
        model.doc_norms = norms_of(docs, model.postings)
    return model
