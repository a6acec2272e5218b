"""Content-addressed store of line attributions: what a file's content gave once is joined, only new contents are read.

An entry is keyed by a digest of path and blob.  Each run adds its new entries in folders of its own, split by the first letters of the digest, and writes the
list of their digests last; entries whose list was never written count for nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kenmap.sources import text

_KEYS = "digest string, shelf string, run long"
_LINES = "digest string, author string, n_lines long, shelf string, run long"


def with_digest(tree: DataFrame) -> DataFrame:
    """``tree`` (path, blob) with digest and shelf (its first two letters)."""
    return tree.select("path", "blob", F.sha2(F.concat_ws("\x1f", "path", "blob"), 256).alias("digest")).withColumn("shelf", F.substring("digest", 1, 2))


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def keys(self) -> DataFrame:
        """digest, shelf, run of all entries; of a digest that two runs added the first counts."""
        return self._table("keys", _KEYS).groupBy("digest", "shelf").agg(F.min("run").alias("run"))

    def attributed(self, tree: DataFrame, texts: DataFrame, run: int) -> DataFrame:
        """path, author, n_lines, reused of every file of ``tree`` (path, blob) that has lines; ``texts`` (path, value: its attribution as porcelain) is read for unknown contents only.

        ``run`` is larger than that of every run before.
        """
        wanted = with_digest(tree)
        missing = wanted.join(self.keys(), ["digest", "shelf"], "left_anti")
        counted = text.attribution(texts.join(missing.select("path"), "path", "left_semi")).groupBy("path", "author").agg(F.sum("n_lines").cast("long").alias("n_lines"))
        counted.join(missing, "path").select("digest", "author", "n_lines", "shelf").write.partitionBy("shelf").parquet(f"{self.root}/lines/run={run}")
        missing.select("digest", "shelf").distinct().write.partitionBy("shelf").parquet(f"{self.root}/keys/run={run}")
        known = wanted.join(self.keys(), ["digest", "shelf"])
        return known.join(self._table("lines", _LINES), ["digest", "shelf", "run"]).select("path", "author", "n_lines", (F.col("run") < run).alias("reused"))
