"""Where intermediate tables live.

A cluster names one shared folder in ``spark.checkpoint.dir``; everything that cuts lineage is written there, so losing an executor
never loses a stage's input.  Only a local session (tests, laptops) that names none gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="termlode-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{scratch_root(spark)}/termlode/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def cut_lineage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once and return it as read back: one evaluation, columnar, and safe against lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session is gone, its own cleaner is responsible then
            return
