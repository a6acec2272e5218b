"""Where intermediate results go: the folder that the cluster names, which all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The setting spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="kenmap-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to that folder: later steps read it, plans above it stay small, and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in that folder, read again: for the rounds of an iteration.

    A plan above it knows the table's true size, so small states are broadcast, and none of the filters below it; a checkpoint hands both on, and they grow with each round.
    """
    at = f"{folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, column: str, parts: int) -> DataFrame:
    """``df`` as a table in that folder, in ``parts`` buckets by ``column`` and sorted by it: what groups, windows or joins by that column reads it without a shuffle."""
    name = uuid.uuid4().hex
    dealt = df.repartition(parts, column)  # no shuffle where it already lies so
    dealt.write.bucketBy(parts, column).sortBy(column).format("parquet").option("path", f"{folder(df.sparkSession)}/round-{name}").saveAsTable(f"kenmap_{name}")
    return df.sparkSession.table(f"kenmap_{name}")
