"""Incremental analysis: contributions of a sliding window, of which only the parts that a run changes are computed again.

The store holds the window's events and the contributions made of them in ``parts`` parts by a hash of the path.  A run gets the events since the last one; it
reads and rewrites only the parts that have new events or events that leave the window, and takes all others as they are.  Parts are never overwritten: a run writes
new ones and then a manifest that says which run's files hold each part, so a run that fails leaves the last one whole.

A store may be built upon only where ``reason`` finds nothing against it; otherwise the window is read afresh.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kenmap.plans.catalog import OPERATORS
from kenmap.plans.engine import Engine

VERSION = 1
#: Tasks that write a part.
WRITERS = 4
_EVENTS = "path string, author string, sha long, ts timestamp"


@dataclass(frozen=True)
class Part:
    run: int
    rows: int
    oldest: str


@dataclass(frozen=True)
class Manifest:
    run: int
    ref: str
    as_of: str
    parts: int
    settings: dict[str, object]
    truncated: bool
    #: number of a part: where it is; parts without events are not listed.
    held: dict[int, Part]
    #: parts that the run read and wrote again.
    rewritten: list[int]


def reason(manifest: Manifest | None, settings: Mapping[str, object], known: bool, ancestor: bool) -> str:
    """Why a run can't build on the store; empty where it can.

    ``known``: the commit that the store was made at still exists; ``ancestor``: it lies behind the one to be analysed (``graphs.commit_graph``).
    """
    if manifest is None:
        return "there is no run before"
    if manifest.truncated:
        return "the run before is incomplete"
    if not manifest.ref:
        return "the run before names no commit"
    if not known:
        return "the commit of the run before is gone"
    if not ancestor:
        return "the commit of the run before is not an ancestor"
    lineage = ("follow_renames", "rename_similarity")
    if any(manifest.settings.get(k) != settings.get(k) for k in lineage):
        return "the lineage settings changed"
    return "" if manifest.settings == dict(settings) else "the settings changed"


class Store:
    def __init__(self, spark: SparkSession, root: str, parts: int = 64) -> None:
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def manifest(self) -> Manifest | None:
        """Of the newest run that ended."""
        try:
            rows = self.spark.read.text(f"{self.root}/manifest").orderBy(F.col("run").desc()).limit(1).collect()
        except AnalysisException:
            return None
        if not rows:
            return None
        found = json.loads(rows[0]["value"])
        if found.pop("version") != VERSION:
            return None
        return Manifest(**found | {"held": {int(k): Part(**v) for k, v in found["held"].items()}})

    def _read(self, kind: str, manifest: Manifest, parts: list[int]) -> DataFrame | None:
        """The given parts; each run's files lie in folders of their own, so nothing else is listed or read."""
        places = [f"{self.root}/{kind}/run={manifest.held[p].run}/part={p}" for p in parts if p in manifest.held]
        return self.spark.read.parquet(*places) if places else None

    def events(self) -> DataFrame | None:
        m = self.manifest()
        return m and self._read("events", m, list(m.held))

    def contributions(self) -> DataFrame | None:
        """path, author, commits, credit, last_commit, last_sha, later_commits, cadence_days of the whole window."""
        m = self.manifest()
        return m and self._read("contributions", m, list(m.held))

    def advance(self, fresh: DataFrame, ref: str, as_of: datetime, lookback: timedelta, settings: Mapping[str, object], build: bool = True) -> Manifest:
        """Take in ``fresh`` (path, author, sha, ts) and move the window to the ``lookback`` before ``as_of``; ``build`` False starts anew, and ``fresh`` is the whole window then.

        An event that the store already has counts once.  Events outside the window are dropped.
        """
        before = self.manifest() if build else None
        held = dict(before.held) if before else {}
        since = as_of - lookback
        number = self._next_run()
        placed = fresh.where(F.col("ts").between(F.lit(since), F.lit(as_of))).select("path", "author", "sha", "ts", F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int").alias("part"))
        touched = {r["part"] for r in placed.select("part").distinct().collect()}  # at most ``parts``
        touched |= {p for p, x in held.items() if datetime.fromisoformat(x.oldest) < since}
        again = sorted(touched)
        old = self._read("events", before, again) if before else None
        if old is not None:
            kept = old.where(F.col("ts") >= F.lit(since)).select("path", "author", "sha", "ts")
            placed = placed.unionByName(kept.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int")))
        spread = placed.distinct().repartition(F.col("part"), F.pmod(F.xxhash64("path"), F.lit(self.parts * WRITERS)))
        at = f"{self.root}/events/run={number}"
        spread.write.partitionBy("part").parquet(at)
        written = self.spark.read.schema(f"{_EVENTS}, part int").parquet(at)
        made = Engine(self.spark, OPERATORS, {"events": written.drop("part")}).table("contributions")
        made.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int")).write.partitionBy("part").parquet(f"{self.root}/contributions/run={number}")
        for p in again:
            held.pop(p, None)
        for r in written.groupBy("part").agg(F.count("*").alias("rows"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("oldest")).collect():
            held[r["part"]] = Part(number, r["rows"], r["oldest"])
        found = Manifest(number, ref, as_of.isoformat(" "), self.parts, dict(settings), False, held, again)
        text = json.dumps({"version": VERSION, **asdict(found)}, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.root}/manifest/run={number}")
        return found

    def _next_run(self) -> int:
        """One more than any run that began, ended or not."""
        try:
            last = self.spark.read.parquet(f"{self.root}/events").agg(F.max("run")).first()[0]
        except AnalysisException:
            last = None
        found = self.manifest()
        return max(last or 0, found.run if found else 0) + 1
