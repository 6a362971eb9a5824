"""Reports over a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlode.operators.model import Model


def top_idf(model: Model, n: int = 5) -> DataFrame:
    """The ``n`` terms of highest idf, ties by term."""
    return model.vocab.select("term", "idf").orderBy(F.desc(F.round("idf", 9)), "term").limit(n)


def idf_list(model: Model, n: int = 20) -> DataFrame:
    """The first ``n`` terms in alphabetical order."""
    return model.vocab.select("term", "df", "idf").orderBy("term").limit(n)


def vector_heads(model: Model, n: int = 10) -> DataFrame:
    """Of every document the weights of the first ``n`` terms in alphabetical order, one column each, named ``w1`` to ``wn``."""
    first = [r["term"] for r in model.vocab.select("term").orderBy("term").limit(n).collect()]
    held = model.postings.where(F.col("term").isin(first)).groupBy("doc_id").agg(*[F.sum(F.when(F.col("term") == t, F.col("w"))).alias(f"w{k + 1}") for k, t in enumerate(first)])
    return model.docs.select("doc_id").join(held, "doc_id", "left").na.fill(0.0)


def norm_list(model: Model) -> DataFrame:
    return model.doc_norms


def top_words(model: Model, words: int = 10, docs: int | None = None) -> DataFrame:
    """``(doc_id, rank, term, w)``: each document's terms of highest positive weight, ties by term; ``docs``: only ids below it."""
    rows = model.postings.where("w > 0")
    if docs is not None:
        rows = rows.where(F.col("doc_id") < docs)
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("w", 9)), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= words).select("doc_id", "rank", "term", "w")


def all_reports(model: Model) -> dict[str, DataFrame]:
    return {"idf": idf_list(model), "vectors": vector_heads(model), "norms": norm_list(model), "top_words": top_words(model, docs=5), "top_idf": top_idf(model)}
