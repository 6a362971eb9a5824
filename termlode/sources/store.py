"""Models on disk: Parquet tables under the fingerprint of their source and options, built once and loaded from then on."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import time
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlode.operators.model import Model, TextOptions, count_terms, model_from_counts, norms_of, picked, weighted

log = logging.getLogger("termlode")
TABLES = ("tf", "vocab", "postings", "doc_norms", "meta")


class ModelStore:
    """``get_or_build`` gives the stored model if every table of it was completely written, else builds and stores it.

    The fingerprint covers the source's files (path, size, time of change), what is done to their rows, the schema, the columns and all text
    options, so that changed data or options, or another selection of the same files, never meet a stale model.  Where the plan is more
    than columns and filters over files, or holds a function that it doesn't spell out, the content itself is hashed.
    """

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    @staticmethod
    def _plain_plan(df: DataFrame) -> list[str] | None:
        """The plan and its files, if they say all about the rows; else None."""
        plan = df._jdf.queryExecution().analyzed()
        files, kinds, todo = [], [], [plan]
        while todo:
            node = todo.pop()
            kinds.append(node.nodeName())
            if node.nodeName() == "LogicalRelation":
                relation = node.relation()
                if "HadoopFsRelation" not in relation.getClass().getName():
                    return None
                # One call for all files of a relation; access times don't count.
                files.append(sorted(re.sub(r"access_time=\d+", "", relation.location().allFiles().mkString("\n")).split("\n")))
            elif node.nodeName() not in ("Project", "Filter", "SubqueryAlias", "Union"):
                return None
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
        said = re.sub(r'"jvmId":"[^"]*"', "", plan.canonicalized().toJSON())  # the session's own mark
        if not plan.deterministic() or re.search(r"UDF|\.udf\.|ScalaUDF|Subquery(?!Alias)", said):
            return None
        return [*files, *kinds, said]

    @staticmethod
    def fingerprint(df: DataFrame, key: str, text: str, options: TextOptions, entries: int) -> str:
        source = ModelStore._plain_plan(df)
        if source is None:
            x, y = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.xxhash64(F.col(f"`{text}`"), F.col(f"`{key}`"))
            source = [tuple(df.agg(F.count("*"), F.bit_xor(x), F.sum(F.pmod(x, F.lit(1_000_003))), F.bit_xor(y), F.sum(F.pmod(y, F.lit(1_000_033)))).collect()[0])]
        said = asdict(options) | {"stopwords": sorted(options.stopwords)}
        return hashlib.sha256(json.dumps([source, df.schema.jsonValue(), key, text, entries, said], sort_keys=True, default=str).encode()).hexdigest()[:24]

    def _exists(self, df: DataFrame, path: str) -> bool:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def get_or_build(self, df: DataFrame, key: str, text: str, options: TextOptions | None = None, entries: int = 0) -> Model:
        options = options or TextOptions()
        spark = df.sparkSession
        at = f"{self.root}/{self.fingerprint(df, key, text, options, entries)}"
        docs = picked(df, key, text)
        if entries:
            docs = docs.where(F.col("doc_id") < entries)
        if not all(self._exists(df, f"{at}/{t}") for t in TABLES):
            # The text is tokenised once; everything else is made from what is stored.
            began = time.monotonic()
            count_terms(docs, "doc_id", options).write.mode("overwrite").parquet(f"{at}/tf")
            model = model_from_counts(docs, spark.read.parquet(f"{at}/tf"), options)
            model.vocab.write.mode("overwrite").parquet(f"{at}/vocab")
            model.vocab = spark.read.parquet(f"{at}/vocab")
            log.info("phase 1, counts and vocabulary: %.3f s", time.monotonic() - began)
            began = time.monotonic()
            # Sorted by term: a search reads only the row groups its terms are in.
            model.postings = weighted(model.tf, model.vocab)
            model.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{at}/postings")
            norms_of(docs, spark.read.parquet(f"{at}/postings")).write.mode("overwrite").parquet(f"{at}/doc_norms")
            model.meta.write.mode("overwrite").parquet(f"{at}/meta")
            log.info("phase 2, weights and norms: %.3f s", time.monotonic() - began)
        stored = {t: spark.read.parquet(f"{at}/{t}") for t in TABLES}
        return Model(docs, stored["tf"], stored["vocab"], stored["postings"], stored["doc_norms"], stored["meta"], options)
