"""Free-text queries over a model: query vectors, cosine similarity, ranking and late text lookup.

:func:`search_many` joins the postings of the queries' terms: right for one query or a few.  :func:`search_batch` ranks many queries without
a row for each query and document that share a term: postings are laid out in blocks of documents, each block is scored against the query
set in one task, and only a block's ``k`` best documents of each query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlode.functions.text import snippet
from termlode.operators.model import Model, count_terms, tf_weight
from termlode.plans.scratch import cut_lineage


def query_frame(model: Model, queries: dict[int, str]) -> DataFrame:
    return model.docs.sparkSession.createDataFrame(list(queries.items()), "query_id long, text string")


def query_vectors(model: Model, queries: DataFrame) -> DataFrame:
    """``(query_id, term, tf, w)`` over the corpus vocabulary; a term the corpus lacks weighs 0."""
    counts = count_terms(queries.select("query_id", "text"), "query_id", model.options, is_query=True)
    known = counts.join(model.vocab.select("term", "idf"), "term", "left")
    return known.select("query_id", "term", "tf", (tf_weight(F.col("tf")) * F.coalesce("idf", F.lit(0.0))).alias("w"))


def query_norms(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(query_id, norm)`` for every query; 0 without a known term."""
    own = vectors.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return queries.select("query_id").distinct().join(own, "query_id", "left").select("query_id", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def _products(model: Model, vectors: DataFrame) -> DataFrame:
    q = vectors.where("w > 0").select("query_id", "term", F.col("w").alias("qw"))
    return model.postings.where("w > 0").join(q, "term").select("query_id", "doc_id", (F.col("w") * F.col("qw")).alias("dot"))


def dot_products(model: Model, vectors: DataFrame) -> DataFrame:
    """``(query_id, doc_id, dot)`` of pairs that share a term of positive weight."""
    return _products(model, vectors).groupBy("query_id", "doc_id").agg(F.sum("dot").alias("dot"))


def _cosines(model: Model, norms: DataFrame, dots: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded, so that the order doesn't hang on the order of additions; 0 where a norm is 0."""
    both = dots.join(norms.withColumnRenamed("norm", "qn"), "query_id").join(model.doc_norms, "doc_id")
    product = F.col("qn") * F.col("norm")
    return both.select("query_id", "doc_id", F.round(F.when(product > 0, F.col("dot") / product).otherwise(0.0), digits).alias("similarity"))


def positive_scores(model: Model, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, similarity)`` above zero."""
    vectors = query_vectors(model, queries)
    return _cosines(model, query_norms(queries, vectors), dot_products(model, vectors)).where("similarity > 0")


def similarity_all(model: Model, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, similarity)`` of every document with every query, zeros included: as many rows as the product of both.
    For one query, or a few; :func:`search_many` and :func:`search_batch` rank without it."""
    every = model.docs.select("doc_id").join(queries.select("query_id").distinct())
    return every.join(positive_scores(model, queries), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def rank_all(model: Model, queries: DataFrame) -> DataFrame:
    """:func:`similarity_all` with ``rank``: best first, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return similarity_all(model, queries).withColumn("rank", F.row_number().over(order))


def search_many(model: Model, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, doc_id, similarity)``: the ``min(k, N)`` best documents of each query, ties by id.

    Documents that score 0 fill up in order of id.  They come from the ``2k`` least ids, which take part with a product of 0: a query that
    has fewer than k positive documents leaves at least k of those free.
    """
    if k <= 0:
        return model.docs.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, similarity double")
    vectors = query_vectors(model, queries)
    zeros = _zeros(model, queries, k).select("query_id", "doc_id", F.lit(0.0).alias("dot"))
    dots = _products(model, vectors).unionByName(zeros).groupBy("query_id", "doc_id").agg(F.sum("dot").alias("dot"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    ranked = _cosines(model, query_norms(queries, vectors), dots).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "similarity")


def _zeros(model: Model, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc_id)`` of the 2k least ids, for every query."""
    least = model.docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    return queries.select("query_id").distinct().join(F.broadcast(least)).select("query_id", "doc_id")


#: A block's table of weights by term and document has at most so many cells; terms that don't fit are added up from their lists.
_CELLS = 16_000_000
#: More than rounding to 6 places and the order of additions can move a score.
_SLACK = 2e-6


class _Block:
    """Postings of a block of documents: by term, by term with the greatest weight first, and a table for the costliest terms."""

    def __init__(self, ids, at, code, u, uses) -> None:
        """``ids``: documents in order; ``at``, ``code``, ``u``: postings in order of code and place of the document; ``uses``: queries by code."""
        self.ids, self.at, self.u = ids, at, u
        self.edge = np.searchsorted(code, np.arange(len(uses) + 1))
        size = np.diff(self.edge)
        held = np.flatnonzero(size)
        self.peak = np.zeros(len(uses))
        self.peak[held] = np.maximum.reduceat(u, self.edge[held]) if len(held) else 0
        cost = size * uses
        rows = np.argsort(-cost, kind="stable")[: _CELLS // max(1, len(ids))]
        rows = rows[(size[rows] > 256) & (cost[rows] > 0)]
        self.row = np.full(len(uses), -1)
        self.row[rows] = np.arange(len(rows))
        self.table = np.zeros((len(rows), len(ids)))
        self.lists = []  # by row: documents and negative weights, greatest weight first
        for row, t in enumerate(rows):
            at, u = self.at[self.edge[t] : self.edge[t + 1]], self.u[self.edge[t] : self.edge[t + 1]]
            self.table[row, at] = u
            order = np.argsort(-u, kind="stable")
            self.lists.append((at[order], -u[order]))
        self.total = np.zeros(len(ids))

    def _candidates(self, mine, v, k: int, least: float):
        """Documents and their scores: all that the ``k`` best by rounded score and id can be, as far as they reach ``least``.

        Terms outside the table are added up.  A document with none of them that is among the best must exceed, in one term of the table at
        least, that term's share of the k-th best score so far; so only the heads of the lists down to those shares are looked at.
        """
        listed, tabled, total, parts = [], [], self.total, []
        for t, x, r in zip(mine.tolist(), v.tolist(), self.row[mine].tolist(), strict=True):
            if r < 0:
                listed.append((t, x))
            else:
                tabled.append((x, self.table[r], *self.lists[r]))
        for t, x in listed:
            i, j = self.edge[t], self.edge[t + 1]
            at = self.at[i:j]
            total[at] += x * self.u[i:j]
            parts.append(at)
        touched = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else self.at[:0]

        def scores(docs):
            s = total.take(docs) if listed else np.zeros(len(docs))
            for x, row, _, _ in tabled:
                s += x * row.take(docs)
            return s

        seen, score = touched, scores(touched)
        read, step = [0] * len(tabled), 512 if least > 0 else max(2 * k, 48)
        whole = sum(x * x for x, _, _, _ in tabled)
        while True:
            if len(score) >= k:
                least = max(least, np.partition(score, len(score) - k)[len(score) - k] - _SLACK)
            if least > 0:
                fits = score >= least
                seen, score = seen[fits], score[fits]
            need = [int(u.searchsorted(-(least * x / whole), "right")) if least > 0 else len(u) for x, _, _, u in tabled]
            want = [min(n, step) for n in need]
            more = [at[a:b] for (_, _, at, _), a, b in zip(tabled, read, want, strict=True) if b > a]
            if not more:
                break
            docs = more[0] if len(more) == 1 else np.concatenate(more)
            s = scores(docs)
            if least > 0:
                fits = s >= least
                docs, s = docs[fits], s[fits]
            if len(docs):
                seen, score = np.concatenate([seen, docs]), np.concatenate([score, s])
                order = np.argsort(seen)
                seen, score = seen[order], score[order]
                first = np.r_[True, seen[1:] != seen[:-1]]
                seen, score = seen[first], score[first]
            read, step = [max(a, b) for a, b in zip(read, want, strict=True)], 8 * step
        total[touched] = 0
        return seen, score

    def best(self, terms, starts, weights, k: int, floor=None):
        """Yields (query, documents, scores): the up to k best documents for each query, by score rounded to 6 places, then by id.

        ``floor``: by query, the score that k documents elsewhere reach; documents below it are left out.
        """
        floor = np.zeros(len(starts) - 1) if floor is None else floor
        bound = np.add.reduceat(weights * self.peak[terms], starts[:-1]) if len(terms) else floor
        for q in np.flatnonzero((bound > 0) & (bound >= floor - _SLACK)).tolist():
            mine, v = terms[starts[q] : starts[q + 1]], weights[starts[q] : starts[q + 1]]
            held = self.peak[mine] > 0
            if not held.all():
                mine, v = mine[held], v[held]
            seen, score = self._candidates(mine, v, k, floor[q] - _SLACK)
            near = np.round(score, 6)
            first = np.lexsort((seen, -near))[:k]
            first = first[near[first] > 0]
            if len(first):
                yield q, self.ids[seen[first]], score[first]


def _best_of_block(terms, starts, weights, doc, code, u, k: int, floor=None):
    """:meth:`_Block.best`; ``doc``, ``code``, ``u``: the block's postings in order of code and document number."""
    ids, at = doc
    uses = np.bincount(terms, minlength=int(code[-1]) + 1 if len(code) else 0)
    yield from _Block(ids, at, code, u, uses).best(terms, starts, weights, k, floor)


def _score_blocks(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, starts, terms, weights = asked.value
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            doc, code, w = (t.column(c).to_numpy() for c in ("doc_id", "code", "w"))
            is_norm = code < 0
            order = np.argsort(doc[is_norm])
            ids, norm = doc[is_norm][order], w[is_norm][order]
            doc, code, w = doc[~is_norm], code[~is_norm], w[~is_norm]
            at = np.searchsorted(ids, doc).astype(np.int32)
            order = np.lexsort((at, code))
            at, code, w = at[order], code[order], w[order]
            del t, is_norm, doc, order
            got = list(_best_of_block(terms, starts, weights, (ids, at), code, w / norm[at], k))
            if got:
                n = [len(d) for _, d, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query[[q for q, _, _ in got]], n)), pa.array(np.concatenate([d for _, d, _ in got])), pa.array(np.concatenate([s for _, _, s in got]))], names=["query_id", "doc_id", "similarity"]
                )

        block = None
        for b in batches:
            if not b.num_rows:
                continue
            of = b.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and of[x] != block:
                    yield from done()
                    held.clear()
                block = of[x]
                held.append(b.slice(x, y - x))
        if held:
            yield from done()

    return run


def search_batch(model: Model, queries: DataFrame, k: int = 10, *, block_docs: int = 200_000, chunk_terms: int = 500_000) -> DataFrame:
    """The rows of :func:`search_many` for a query set of any size.

    Queries of equal vectors are ranked once.  What is shuffled are the postings of asked terms, once for every ``chunk_terms`` terms of such
    classes of queries, and at most ``k`` rows for each class and block of about ``block_docs`` documents; a block is a task.  A chunk of the
    query set is broadcast; its size is bounded by ``chunk_terms``.
    """
    spark = model.docs.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, similarity double")
    vectors = query_vectors(model, queries).where("w > 0").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("v"))
    classes = queries.select("query_id").distinct().join(vectors, "query_id", "left").withColumn("first", F.min("query_id").over(Window.partitionBy("v")))
    classes = cut_lineage(classes, "classes")
    firsts = classes.where("query_id <=> first")
    n_docs, n_terms = model.docs.count(), firsts.agg(F.sum(F.array_size("v"))).first()[0] or 0
    blocks = max(-(-n_docs // block_docs), min(spark.sparkContext.defaultParallelism, -(-n_docs // 2_000)), 1)
    chunks = max(1, -(-n_terms // chunk_terms))
    norms = model.doc_norms.where("norm > 0").select("doc_id", F.lit(-1).cast("bigint").alias("code"), F.col("norm").alias("w"))
    found = _zeros(model, firsts, k).select("query_id", "doc_id", F.lit(0.0).alias("similarity"))
    for chunk in range(chunks):
        part = firsts.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == chunk).select("query_id", F.inline("v")).toPandas()
        if not len(part):
            continue
        names, code = np.unique(part["term"].to_numpy(dtype=object), return_inverse=True)
        order = np.argsort(part["query_id"].to_numpy(), kind="stable")
        query, w, code = part["query_id"].to_numpy()[order], part["w"].to_numpy()[order], code[order]
        start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        norm = np.sqrt(np.add.reduceat(w * w, start))
        asked = spark.sparkContext.broadcast((query[start], np.r_[start, len(query)], code, w / np.repeat(norm, np.diff(np.r_[start, len(query)]))))
        coded = spark.createDataFrame(list(zip(names.tolist(), range(len(names)), strict=True)), "term string, code bigint")
        rows = model.postings.where("w > 0").join(F.broadcast(coded), "term").select("doc_id", "code", "w").unionByName(norms)  # at most chunk_terms terms
        rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "*").repartitionById(blocks, "block").sortWithinPartitions("block")
        found = found.unionByName(rows.mapInArrow(_score_blocks(asked, k), "query_id bigint, doc_id bigint, similarity double").withColumn("similarity", F.round("similarity", 6)))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    best = found.repartition("query_id").groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("query_id", "first")
    return classes.select("query_id", F.col("first").alias("of")).join(best, F.col("of").eqNullSafe(F.col("first"))).select("query_id", "rank", "doc_id", "similarity")


def with_text(model: Model, ranked: DataFrame, length: int = 100) -> DataFrame:
    """Ranked rows with their snippet; the text is fetched for them only.  Documents whose text is NULL are left out."""
    return ranked.join(model.docs, "doc_id").where("text IS NOT NULL").select("query_id", "rank", "doc_id", "similarity", snippet(F.col("text"), length).alias("snippet"))


class Session:
    """Queries by id over one model: an id that was asked before gives its earlier answer's query."""

    def __init__(self, model: Model) -> None:
        self.model, self.asked = model, {}

    def search(self, query_id: int, query: str | None = None, k: int | None = 10) -> DataFrame:
        if query_id not in self.asked:
            if not query:
                raise ValueError("empty query")
            self.asked[query_id] = query
        rows = query_frame(self.model, {query_id: self.asked[query_id]})
        if k is None or self.model.options.profile == "oracle":
            return rank_all(self.model, rows).orderBy("rank")
        return search_many(self.model, rows, k).orderBy("rank")
