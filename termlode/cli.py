"""Command line: ``search`` (engine profile), ``batch`` (a table of queries over the tables they name), ``model`` (oracle profile with reports)
and ``clean``.  Wrong flags print the usage and end with exit code 1."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlode.functions.stopwords import as_set, read_words
from termlode.functions.text import clean_text
from termlode.operators import reports, search
from termlode.operators.model import TextOptions, build_model
from termlode.sources.readers import path_exists, read_queries_tsv, read_query_file, read_sqlite, sqlite_table_exists
from termlode.sources.store import ModelStore

log = logging.getLogger("termlode")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage()
        self.exit(1, f"{self.prog}: {message}\n")


def _parser() -> argparse.ArgumentParser:
    top = _Parser(prog="termlode")
    kinds = top.add_subparsers(dest="command", required=True)
    s = kinds.add_parser("search", help="rank documents for a query")
    s.add_argument("--db", required=True, help="SQLite file, or a directory or file of Parquet")
    s.add_argument("--table", default="sample_articles")
    s.add_argument("--entries", type=int, default=0, help="only ids below this; 0: all")
    s.add_argument("--nthreads", type=int, default=4, choices=range(1, 17), metavar="1..16", help="local threads, if no session is there yet")
    s.add_argument("--query_user", default="")
    s.add_argument("--query_filename", default="")
    s.add_argument("--k", type=int, default=10)
    s.add_argument("--models", default="models", help="folder of stored models")
    s.add_argument("--stopwords", help="file with one word per line")
    s.add_argument("--test", type=int, default=0, help="test mode; only logged")
    s.add_argument("--verbose", action="store_true")
    b = kinds.add_parser("batch", help="rank the documents of each table for the queries that name it; tables that don't exist are skipped")
    b.add_argument("--db", required=True, help="SQLite file, or a directory of <table>.parquet")
    b.add_argument("--queries", required=True, help="TSV file with table, query_id and query")
    b.add_argument("--prefix", default="test_tbl_", help="what stands before a table's number")
    b.add_argument("--k", type=int, default=10)
    b.add_argument("--models", default="models")
    b.add_argument("--stopwords")
    m = kinds.add_parser("model", help="rank all documents and print the model's reports")
    m.add_argument("-d", "--db", required=True)
    m.add_argument("-t", "--table", required=True)
    m.add_argument("-s", "--stopwords")
    m.add_argument("-q", "--query", default="")
    m.add_argument("-f", "--query_filename", default="", help="file with the query; goes before -q")
    c = kinds.add_parser("clean", help="normalise a text, a file or a table")
    c.add_argument("text", nargs="?")
    c.add_argument("-f", "--file")
    c.add_argument("-d", "--db")
    c.add_argument("-t", "--table", default="sample_articles")
    c.add_argument("-o", "--out", help="where the cleaned table is written; the source is never changed")
    return top


def _load(spark: SparkSession, where: str, table: str) -> DataFrame:
    return read_sqlite(spark, where, table) if where.endswith((".db", ".sqlite")) else spark.read.parquet(where)


def _search(args: argparse.Namespace, spark: SparkSession) -> int:
    query = read_query_file(args.query_filename) if len(args.query_filename) > 3 else args.query_user
    options = TextOptions(stopwords=as_set(read_words(args.stopwords) if args.stopwords else None))
    log.info("test mode: %d", args.test)
    began = time.monotonic()
    model = ModelStore(args.models).get_or_build(_load(spark, args.db, args.table), "article_id", "article_text", options, args.entries)
    log.info("model: %.3f s", time.monotonic() - began)
    began = time.monotonic()
    ranked = search.search_many(model, search.query_frame(model, {1: query}), args.k)
    for r in search.with_text(model, ranked).orderBy("rank").collect():  # k rows
        print(f"[{r['doc_id']}] {r['similarity']:.6f}  {r['snippet']}")
    log.info("search: %.3f s", time.monotonic() - began)
    if args.verbose:
        reports.top_idf(model).show(truncate=False)
    return 0


def _batch(args: argparse.Namespace, spark: SparkSession) -> int:
    options = TextOptions(stopwords=as_set(read_words(args.stopwords) if args.stopwords else None))
    asked = read_queries_tsv(spark, args.queries).where("query != ''")
    store = ModelStore(args.models)
    for tbl in [r["tbl"] for r in asked.select("tbl").where("tbl IS NOT NULL").distinct().orderBy("tbl").collect()]:  # as many rows as there are tables
        name = f"{args.prefix}{tbl}"
        is_file = args.db.endswith((".db", ".sqlite"))
        if not (sqlite_table_exists(args.db, name) if is_file else path_exists(spark, f"{args.db}/{name}.parquet")):
            print(f"{name}: no such table, skipped")
            continue
        model = store.get_or_build(_load(spark, args.db if is_file else f"{args.db}/{name}.parquet", name), "article_id", "article_text", options)
        ranked = search.search_batch(model, asked.where(F.col("tbl") == tbl).select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query").alias("text")), args.k)
        for r in search.with_text(model, ranked).orderBy("query_id", "rank").toLocalIterator():
            print(f"{name} {r['query_id']} [{r['doc_id']}] {r['similarity']:.6f}  {r['snippet']}")
    return 0


def _model(args: argparse.Namespace, spark: SparkSession) -> int:
    options = TextOptions(profile="oracle", clean=False, stopwords=as_set(read_words(args.stopwords) if args.stopwords else None))
    model = build_model(_load(spark, args.db, args.table), "article_id", "article_text", options, materialise="weights")
    for report in reports.all_reports(model).values():
        report.show(truncate=False)
    search.Session(model).search(1, read_query_file(args.query_filename) if args.query_filename else args.query).show(truncate=False)
    return 0


def _clean(args: argparse.Namespace, spark: SparkSession) -> int:
    given = [x for x in (args.text, args.file, args.db) if x]
    if len(given) != 1:
        raise SystemExit("give a text, -f or -d")
    if args.db:
        if not args.out:
            raise SystemExit("-d needs -o")
        _load(spark, args.db, args.table).withColumn("article_text", clean_text(F.col("article_text"))).write.mode("errorifexists").parquet(args.out)
        return 0
    text = read_query_file(args.file) if args.file else args.text
    print(spark.createDataFrame([(text,)], "t string").select(clean_text(F.col("t"))).first()[0])
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if getattr(args, "verbose", False):
        logging.basicConfig(level=logging.INFO)
    spark = spark or SparkSession.builder.master(f"local[{getattr(args, 'nthreads', 4)}]").appName("termlode").getOrCreate()
    return {"search": _search, "batch": _batch, "model": _model, "clean": _clean}[args.command](args, spark)


if __name__ == "__main__":
    raise SystemExit(main())
