"""Streaming ingestion of change events: watermarked windows, and severities that only change when they last."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from kenmap.operators.graphs import steady_step
from kenmap.plans.storage import folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def windowed(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events, people and value of each window and type; events later than ``late`` are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    counted = grouped.agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


def drained(stream: DataFrame, keys: list[str]) -> DataFrame:
    """All that the stream has now.  Each micro-batch writes the windows it changed, with its number; the newest state of each key counts."""
    at = f"{folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{at}/rows")
    return rows.withColumn("newest", F.max("batch").over(Window.partitionBy(*keys))).where("batch = newest").drop("batch", "newest")


class Steady(StatefulProcessor):
    """Hysteresis of one repository's runs: typed state holds what is reported, what waits, and for how many runs; nothing is replayed."""

    def __init__(self, needed: int, margin: float) -> None:
        self.needed, self.margin = needed, margin

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "reported string, pending string, streak int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("run")
        state, out = self.now.get() if self.now.exists() else None, []
        for severity, delta in zip(new["severity"], new["delta"]):
            state = steady_step(state, severity, delta, self.needed, self.margin)
            out.append(state)
        self.now.update(state)
        yield pd.DataFrame({"repo": key[0], "run": new["run"], "reported": [s[0] for s in out], "streak": pd.array([s[2] for s in out], "int64")})

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def steady_severity(runs: DataFrame, needed: int = 3, margin: float = 0.4) -> DataFrame:
    """repo, run, reported, streak of a stream of runs (repo, run, severity, delta) that come in order; the stream needs the RocksDB state store (``STATE_STORE``)."""
    return runs.groupBy("repo").transformWithStateInPandas(Steady(needed, margin), "repo string, run long, reported string, streak long", "Append", "None")


def steadied(runs: DataFrame, slices: int = 3, needed: int = 3, margin: float = 0.4) -> DataFrame:
    """``steady_severity`` of a table of runs: it is laid out as files in the order of runs, and a stream takes one slice after the other, each by a query of its own that goes on from the state of the one before."""
    spark = runs.sparkSession
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ends = runs.agg(F.min("run").alias("low"), F.max("run").alias("high")).first()
        low, high = (0, 0) if ends.low is None else (ends.low, ends.high + 1)
        bounds = [low + (high - low) * i // slices for i in range(slices + 1)]
        for a, b in zip(bounds, bounds[1:]):
            runs.where((F.col("run") >= a) & (F.col("run") < b)).write.mode("append").parquet(f"{at}/in")
            stream = spark.readStream.schema(runs.schema).parquet(f"{at}/in")
            query = steady_severity(stream, needed, margin).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    return spark.read.schema("repo string, run long, reported string, streak long").parquet(f"{at}/out")
