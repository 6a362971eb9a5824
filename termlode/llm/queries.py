"""Queries of the training-data operators, over whole tables with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlode.llm import sql
from termlode.llm.distinctive import TermWeights, top_terms
from termlode.llm.formatting import collapse_formatting, formatting_classes
from termlode.llm.frequencies import term_frequencies
from termlode.llm.leakage import LeakageIndex
from termlode.llm.lookalikes import Lookalikes
from termlode.llm.neardup import NearDuplicates
from termlode.llm.packing import pack_documents
from termlode.llm.residue import template_residue
from termlode.llm.topn import top_n


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "test_tbl_3")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "queries").where("tbl = 3")


def _both(make: Callable[[DataFrame, str, str], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    articles = make(_articles(spark, d), "article_id", "article_text").select(F.lit("test_tbl_3").alias("rel"), "*")
    return articles.unionByName(make(_queries(spark, d), "query_id", "query").select(F.lit("queries").alias("rel"), "*"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = _both(lambda df, key, text: Lookalikes(df, key, text).pairs(), spark, d)
    return out.select("rel", F.col("key_a").cast("bigint").alias("key_a"), F.col("key_b").cast("bigint").alias("key_b"))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _both(lambda df, key, text: Lookalikes(df, key, text).classes().select(F.col("rec_id").cast("bigint").alias("rec_id"), "canonical", F.col("class_id").cast("bigint").alias("class_id"), "links"), spark, d)


def _neardup(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(_articles(spark, d), "article_id", "article_text", threshold=0.7)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _neardup(spark, d).pairs().select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return _neardup(spark, d).groups().select(F.col("rec_id").alias("article_id"), "group_id", "links")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_classes(_articles(spark, d), "article_id", "article_text").where("rec_id != keep_id").select("keep_id", F.col("rec_id").alias("copy_id"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapse_formatting(_articles(spark, d), "article_id", "article_text").select(F.col("rec_id").alias("article_id"), "copies")


def _weights(spark: SparkSession, d: str) -> TermWeights:
    return TermWeights(_articles(spark, d), "article_id", "article_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    weights = _weights(spark, d)
    return _both(lambda df, key, text: top_terms(weights.score(df, key, text, ("weight",), top=3), "weight", 3), spark, d).select("rel", "rec_id", "term")


def p4_enrichment(spark: SparkSession, d: str) -> DataFrame:
    weights = _weights(spark, d)
    out = _both(lambda df, key, text: top_terms(weights.adjusted(df, key, text), "q_score", 3), spark, d)
    return out.select("rel", "rec_id", "term", "f", "n", F.round("score", 6).alias("score"), F.round("q_score", 6).alias("q_score"), "rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_articles(spark, d), "article_id", "article_text").where("mark IS NOT NULL").select("term", "mark")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_articles(spark, d), "article_id", "article_text")


def _top(spark: SparkSession, d: str) -> DataFrame:
    top = top_n(_table(spark, d, "docsim"), ("tbl", "query_id"), "doc_id", "similarity", 10)
    return top.select(F.col("g1").cast("int").alias("tbl"), F.col("g2").cast("int").alias("query_id"), F.col("item").alias("doc_id"), "rank", F.col("score").alias("similarity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("tbl", "query_id", "doc_id")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("tbl", "query_id", "rank", "doc_id", F.round("similarity", 6).alias("similarity"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_table(spark, d, "documents"), _table(spark, d, "containers"), "doc_id", "text", "source")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing(spark, d).where("pieces > 1 AND piece = 1").select("container_kind", "doc_id")


def _leaks(spark: SparkSession, d: str, rank: int) -> LeakageIndex:
    return LeakageIndex(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_items"), "item_id", "item_text", "answer", rank=rank)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, 16).shared_runs(10).select("doc_id", "item_id")


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, 32).paraphrases().select("doc_id", "item_id", F.round("lcs_share", 6).alias("lcs_share"), "has_answer")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return template_residue(_table(spark, d, "documents"), "doc_id", "text", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_canonical, p2_found, p2_groups, p3_found, p3_collapsed, p4_found, p4_enrichment, p5_found, p5_frequencies, p6_found, p6_ranked, p7_found, p7_packing, p8_found, p8_paraphrases, p9_found)
    }


_BEST = """
    SELECT tbl, query_id, doc_id, similarity, row_number() OVER (PARTITION BY tbl, query_id ORDER BY similarity DESC, doc_id) AS rank
    FROM (SELECT tbl, query_id, doc_id, max(similarity) AS similarity FROM docsim WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY ALL)
    QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | {
        "p6_found": f"SELECT tbl, query_id, doc_id FROM ({_BEST})",
        "p6_ranked": f"SELECT tbl, query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(similarity, 6) AS similarity FROM ({_BEST})",
        "p7_found": "SELECT container_kind, doc_id FROM documents CROSS JOIN containers WHERE octet_length(encode(text)) + 1 > capacity",
    }
