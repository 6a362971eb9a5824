"""Frequency of every distinct term (problem 5): recursive radix spilling with DuckDB at the leaves.

1. Every task counts the terms of its own rows, so what is spilled are (term, occurrences, records) partial counts.
2. Partial counts are spilled to the shared folder, partitioned by the top bits of the term's 64-bit hash.  Adaptive execution sizes the
   writers of a radix by its bytes, so that their number grows with the data.
3. A partition that holds more than ``leaf_rows`` partial rows is read again, added up within each task and spilled by its next bits, again
   and again.  A partition's name is its whole path of radices, so children of different parents stay apart and every level is smaller than
   its parent.  Only the folders' names and sizes come to the driver: at most ``2 ** bits`` for each split partition.
4. Leaves are aggregated in DuckDB, one after the other within a task of about ``leaf_rows`` rows.

A term is wholly inside one leaf, so leaves never have to be merged.  A hot term is no hot key: a task sends one partial row for it, not
one for each occurrence, and each level adds those up once more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlode.llm.words import records, words_of
from termlode.plans.scratch import cut_lineage, scratch_path

PARTIAL = "term string, occurrences bigint, records bigint"
_NAMES = ["term", "occurrences", "records"]


def _partial_counts(batches: Iterator[pa.RecordBatch], flush_terms: int = 200_000) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        terms = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([total[t] for t in terms], pa.int64()), pa.array([held[t] for t in terms], pa.int64())], names=_NAMES
        )

    for batch in batches:
        for text in batch.column(0):
            found = words_of(text.as_py())
            if found:
                total.update(found)
                held.update(set(found))
                total[""] += len(found)
                held[""] += 1
            if len(total) >= flush_terms:
                yield out()
                total.clear()
                held.clear()
    if total:
        yield out()


def partial_term_counts(rows: DataFrame) -> DataFrame:
    """Partial counts of ``rows.text``: several rows per term, few per task."""
    return rows.select("text").mapInArrow(_partial_counts, PARTIAL)


def _added(rows: list[pa.RecordBatch]) -> pa.Table:
    got = pa.Table.from_batches(rows).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
    return got.select(["term", "occurrences_sum", "records_sum"]).rename_columns(_NAMES)


def _add_up(batches: Iterator[pa.RecordBatch], flush_rows: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task, with the terms that it holds several times added up."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= flush_rows:
            got = _added(held)
            if got.num_rows > flush_rows // 2:
                yield from got.to_batches(65_536)
                held, rows = [], 0
            else:
                held = got.to_batches()
                rows = got.num_rows
    if rows:
        yield from _added(held).to_batches(65_536)


def leaf_options(memory: str, spill: str) -> dict:
    """DuckDB's settings for a leaf: it spills to the shared folder if that is mounted, and nowhere (an empty folder name) if it isn't."""
    return {"memory_limit": memory, "threads": 1, "preserve_insertion_order": False, "temp_directory": spill}


def _count_leaves(memory: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for folders, spill in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, folder in enumerate(folders):
                    where, path = fs.FileSystem.from_uri(folder)
                    leaf = ds.dataset(path, filesystem=where, format="parquet").scanner(columns=_NAMES, batch_size=65_536).to_reader()
                    with duckdb.connect(config=leaf_options(memory, f"{spill}/{k}" if spill else "")) as db:
                        db.register("leaf", leaf)
                        yield from db.sql("SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM leaf GROUP BY term").to_arrow_reader(65_536)

    return count


def _tasks(leaves: list[tuple[str, int]], leaf_rows: int, parallel: int) -> list[list[str]]:
    """Leaves of a task: about ``leaf_rows`` rows together, and no fewer tasks than run at once."""
    most = max(1, min(leaf_rows, sum(n for _, n in leaves) // max(1, parallel)))
    out: list[list[str]] = []
    rows = most
    for folder, n in leaves:
        if rows + n > most:
            out.append([])
            rows = 0
        out[-1].append(folder)
        rows += n
    return out


def count_terms(df: DataFrame, key: str, text: str, *, bits: int = 5, leaf_rows: int = 1_000_000, leaf_memory: str = "256MB") -> DataFrame:
    """``(term, occurrences, records)``, plus one row with the empty term that holds the totals: all occurrences, and all records with a word."""
    spark = df.sparkSession
    level = partial_term_counts(records(df, key, text))
    leaves: list[tuple[str, int]] = []
    for depth in range(bits, 65, bits):
        path = scratch_path(spark, f"radix{depth}")
        radix = F.shiftrightunsigned(F.xxhash64("term"), 64 - depth)  # the whole path so far
        level.withColumn("radix", radix).hint("rebalance", "radix").write.option("compression", "zstd").partitionBy("radix").parquet(path)
        sizes = spark.read.schema(f"{PARTIAL}, radix bigint").parquet(path).groupBy("radix").count().collect()  # at most 2 ** bits for each split partition
        last = depth + bits > 64  # the hash is used up: the rows of such a partition are of one term, or of terms with equal hashes
        large = [r["radix"] for r in sizes if r["count"] > leaf_rows and not last]
        split = set(large)
        leaves += [(f"{path}/radix={r['radix']}", r["count"]) for r in sizes if r["radix"] not in split]
        if not large:
            break
        level = spark.read.schema(PARTIAL).parquet(*[f"{path}/radix={k}" for k in large]).mapInArrow(_add_up, PARTIAL)
    if not leaves:
        return spark.createDataFrame([], PARTIAL)
    spill = scratch_path(spark, "duckdb")
    spill = spill.removeprefix("file://") if "://" not in spill or spill.startswith("file://") else ""
    tasks = [(folders, f"{spill}/{k}" if spill else "") for k, folders in enumerate(_tasks(leaves, leaf_rows, spark.sparkContext.defaultParallelism))]
    frame = spark.createDataFrame(tasks, "folders array<string>, spill string").repartition(len(tasks))
    return cut_lineage(frame.mapInArrow(_count_leaves(leaf_memory), PARTIAL), "terms")


def term_frequencies(df: DataFrame, key: str, text: str, *, rare_below: int = 3, common_above: float = 0.1, **radix) -> DataFrame:
    """``(term, occurrences, records, mark)`` over all rows of ``df``.

    ``records`` is the number of records that hold the term; ``mark`` is 'rare' below ``rare_below`` records, 'common' above the share
    ``common_above`` of all records with a word, else NULL.  Repeated rows of a key count once; NULL, empty and wordless texts add
    nothing; an empty table gives no row.  ``radix``: see :func:`count_terms`.
    """
    counts = count_terms(df, key, text, **radix)
    totals = counts.where("term = ''").select(F.col("records").alias("n"))  # one row
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.col("n"), "common")
    return counts.where("term != ''").crossJoin(F.broadcast(totals)).select("term", "occurrences", "records", mark.alias("mark"))
