"""Articles that keep arriving: the cleaning projection over a stream.

Cleaning is stateless, so a stream needs no watermark and no state; files are taken once each, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termlode.functions.text import clean_text


def cleaned(articles: DataFrame, text: str = "article_text") -> DataFrame:
    """The table or stream with its text column cleaned."""
    return articles.withColumn(text, clean_text(F.col(f"`{text}`")))


def clean_arriving(spark: SparkSession, source: str, target: str, checkpoint: str, text: str = "article_text") -> StreamingQuery:
    """Clean all Parquet files that lie in ``source`` and were not taken before, append them to ``target``, and stop."""
    schema = spark.read.parquet(source).schema
    arriving = spark.readStream.schema(schema).parquet(source)
    return cleaned(arriving, text).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
