"""Snapshots of results, kept as tables: saved with what they depend on, reused only where that still holds, evicted oldest first."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT_BYTES = 256 * 1024 * 1024
VERSION = "1"


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write(table: DataFrame, root: str, name: str, run: Mapping[str, object]) -> str:
    """Save ``table`` as a snapshot of ``name``; ``run`` holds ref, config and as_of.  The manifest is written last, so half a snapshot is never read."""
    spark, at = table.sparkSession, f"{root}/{name}/{run['ref']}-{str(run['config'])[:12]}"
    table.write.mode("overwrite").parquet(f"{at}/rows")
    spark.createDataFrame([(json.dumps({"version": VERSION, **run}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
    return at


def snapshots(spark: SparkSession, root: str, name: str) -> list[dict]:
    """Manifests of the snapshots of ``name`` with their place, size and age in milliseconds since the epoch; what can't be read is skipped."""
    fs, path = _files(spark, f"{root}/{name}")
    if not fs.exists(path):
        return []
    out = []
    for status in fs.listStatus(path):
        at = status.getPath().toString()
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/manifest/_SUCCESS")):
            continue
        line = spark.read.text(f"{at}/manifest").first()
        try:
            manifest = json.loads(line[0]) if line else None
        except ValueError:
            manifest = None
        if isinstance(manifest, dict):
            out.append(manifest | {"at": at, "bytes": fs.getContentSummary(status.getPath()).getLength(), "written": status.getModificationTime()})
    return out


def refusal(manifest: Mapping[str, object], head: str, config: str, now: datetime, max_age: int | None = None, allow_stale: bool = False) -> str:
    """Why a snapshot can't be reused; empty where it can."""
    if manifest.get("version") != VERSION:
        return "written by another version"
    if manifest.get("config") != config:
        return "the settings changed"
    if manifest.get("truncated"):
        return "the snapshot is incomplete"
    if not manifest.get("ref"):
        return "the snapshot names no commit"
    if max_age is not None and (max_age == 0 or (now - datetime.fromisoformat(str(manifest["as_of"]))).total_seconds() > max_age):
        return "the snapshot is too old"
    return "" if manifest["ref"] == head or allow_stale else "another commit"


def reusable(spark: SparkSession, root: str, name: str, head: str, config: str, now: datetime, max_age: int | None = None, allow_stale: bool = False) -> DataFrame | None:
    """The newest snapshot that may be reused."""
    fit = [m for m in snapshots(spark, root, name) if not refusal(m, head, config, now, max_age, allow_stale)]
    return spark.read.parquet(max(fit, key=lambda m: (m["as_of"], m["at"]))["at"] + "/rows") if fit else None


def evict(spark: SparkSession, root: str, name: str, limit: int = LIMIT_BYTES) -> int:
    """Remove the oldest snapshots of ``name`` until all take at most ``limit`` bytes; how many went."""
    kept = sorted(snapshots(spark, root, name), key=lambda m: (m["written"], m["at"]))
    gone = 0
    while kept and sum(m["bytes"] for m in kept) > limit:
        fs, path = _files(spark, kept.pop(0)["at"])
        fs.delete(path, True)
        gone += 1
    return gone


def clear(spark: SparkSession, root: str, name: str) -> None:
    """Remove all snapshots of ``name`` (and of nothing else)."""
    fs, path = _files(spark, f"{root}/{name}")
    if fs.exists(path):
        fs.delete(path, True)


def replayed(window: DataFrame, stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """path, author, sha, ts of the commits of a window (sha, author, ts): files from the run before (sha, path), and freshly read ones for new commits.

    A commit of the window without files in either table is not silently lost: it makes ``missing`` rows.
    """
    known = stored.select("sha", "path").union(fetched.select("sha", "path").join(stored.select("sha").distinct(), "sha", "left_anti"))
    return window.join(known, "sha", "left").select("path", "author", "sha", "ts", F.col("path").isNull().alias("missing"))


def refreshed(before: DataFrame, again: DataFrame, dirty: DataFrame) -> DataFrame:
    """Rows of the paths in ``dirty`` (path) as computed again, all others as before."""
    return before.join(dirty.select("path").distinct(), "path", "left_anti").unionByName(again.join(dirty.select("path").distinct(), "path", "left_semi"))
