"""Corpora and queries from tables, TSV files, directories, text files and SQLite databases, all as ``(id, text)`` DataFrames."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ARTICLES = "article_id BIGINT, article_text STRING"


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def id_range(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Rows with ids from ``first`` to ``last``, both included; the filter reaches the scan."""
    return df.where(F.col(f"`{key}`").between(first, last))


def ordered_scan(df: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
    """``(id, text)`` of :func:`id_range`, in order of id."""
    return id_range(df, key, first, last).select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).orderBy("id")


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def id_prefix(df: DataFrame, key: str, entries: int) -> DataFrame:
    """Rows with ids below ``entries``; all of them if it is 0."""
    if entries < 0:
        raise ValueError("entries must not be negative")
    return df.where(F.col(f"`{key}`") < entries) if entries else df


def by_ids(df: DataFrame, key: str, text: str, ids: list[int]) -> DataFrame:
    """``(rank, id, text)`` in the order of ``ids``; NULL text where an id is missing."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids, 1)), "rank int, id bigint")
    return wanted.join(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("id").isin(ids)), "id", "left").select("rank", "id", "text")


def read_articles_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``article_id<TAB>article_text`` with a header line; blanks around ids fall away."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema="article_id STRING, article_text STRING")
    return raw.select(F.trim("article_id").cast("bigint").alias("article_id"), "article_text").where("article_id IS NOT NULL")


def read_queries_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(tbl, query_id, query)`` in order of table and query; blank lines fall away."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema="tbl STRING, query_id STRING, query STRING")
    return raw.select(F.trim("tbl").cast("int").alias("tbl"), F.trim("query_id").cast("int").alias("query_id"), F.trim("query").alias("query")).where("query_id IS NOT NULL").orderBy("tbl", "query_id")


def read_directory(spark: SparkSession, base: str, docs: str = "documentos") -> DataFrame:
    """``(doc_id, text)`` of the files ``doc<N>.txt``, numbered from 0 in order of N."""
    at = f"{base}/{docs}"
    number = F.regexp_extract("path", r"doc(\d+)\.txt$", 1)
    # Numbering is over file names only, whose contents are not read for it; the text is joined back.
    names = spark.read.format("binaryFile").load(at).select("path").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), number.alias("n")).where("n != ''")
    order = names.select("name", (F.row_number().over(Window.orderBy(F.col("n").cast("bigint"))) - 1).cast("bigint").alias("doc_id"))
    texts = spark.read.text(at, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return texts.join(order, "name").select("doc_id", "text")


def read_query_file(path: str | Path) -> str:
    """The whole file; raises if it is missing or blank."""
    text = Path(path).read_text(encoding="utf-8")
    if not text.strip():
        raise ValueError("empty query")
    return text


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Ids(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.table = options["path"], options.get("table", "sample_articles")
        self.key, self.text = options.get("idcolumn", "article_id"), options.get("textcolumn", "article_text")
        self.parts = int(options.get("partitions", "8"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f"SELECT min({_quoted(self.key)}), max({_quoted(self.key)}) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Ids(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Ids) -> Iterator[tuple]:
        with self._open() as db:
            yield from db.execute(
                f"SELECT {_quoted(self.key)}, {_quoted(self.text)} FROM {_quoted(self.table)} WHERE {_quoted(self.key)} BETWEEN ? AND ? ORDER BY {_quoted(self.key)}",
                (partition.first, partition.last),
            )


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_articles").option("table", ...).load(path)``: one connection and one range of ids for each partition.
    The file must be readable where the tasks run."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_articles"

    def schema(self) -> str | StructType:
        return f"`{self.options.get('idcolumn', 'article_id')}` BIGINT, `{self.options.get('textcolumn', 'article_text')}` STRING"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options))


def sqlite_table_exists(path: str, table: str) -> bool:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return bool(db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone())


def read_sqlite(spark: SparkSession, path: str, table: str = "sample_articles", partitions: int = 8) -> DataFrame:
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    if not sqlite_table_exists(path, table):
        raise ValueError(f"no table {table!r}")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_articles").option("table", table).option("partitions", partitions).load(path)
