from termlode.streaming.ingest import clean_arriving


def test_files_are_cleaned_once(spark, tmp_path):
    source, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))

    def arrive(rows):
        spark.createDataFrame(rows, "article_id bigint, article_text string").coalesce(1).write.mode("append").parquet(source)
        clean_arriving(spark, source, target, checkpoint).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(target).collect())

    assert arrive([(1, "The CAT's tail!"), (2, None)]) == [(1, "the cat tail"), (2, None)]
    assert arrive([(3, "Ünder-way?")]) == [(1, "the cat tail"), (2, None), (3, "under-way")]
