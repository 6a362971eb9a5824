"""Access to a directory of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(scan: DataFrame) -> DataFrame:
    """A scan that has fewer splits than there are cores, as with one small file, spread over all of them; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
