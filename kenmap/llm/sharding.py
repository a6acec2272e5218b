"""Sharding by histogram sort, with DataFrame functions only.

Documents are ordered by the key (hash of the text, doc_id), so equal texts stand together, and the order is
cut into shards of near equal bytes.  Splitters are found without sorting: each round lays candidate
boundaries over the key ranges that may still hold a splitter, counts the exact bytes below each boundary
across all partitions, and keeps, for each splitter, the one range between two boundaries that its target
falls into.  A splitter is settled when a boundary meets its target within the tolerance.  A group of equal texts that is
larger than the tolerance has one hash; there the rounds go on over doc_id, so such a group is cut where it
must be.  Once all splitters stand, rows are exchanged once, to (shard, part of the shard), and numbered.

What reaches the driver is one number for each candidate boundary: at most (shards - 1) x ``PROBES`` rows a round.

Defined results: a null text counts 16 bytes and is ordered as the empty text; doc_ids lie within 2**62 of zero; a null doc_id comes first
among equal texts; rows with the same text and doc_id are not told apart by a splitter, and get slots of their own;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.shared import keep

PROBES = 256
NO_ID = -(2**62)
TOP = 2**63 - 1
PART_ROWS = 100_000


@dataclass(frozen=True, order=True)
class Span:
    """Keys that may hold a splitter: hashes [low, high), or, where ``tie`` is set, ids [low, high) of that hash."""

    tie: int | None
    low: int
    high: int

    @property
    def step(self) -> int:
        return -(-(self.high - self.low) // PROBES)

    def test(self) -> str:
        column = "h" if self.tie is None else f"h = {self.tie}L and id"
        return f"{column} >= {self.low}L and {'h' if self.tie is None else 'id'} < {self.high}L"

    def bin(self) -> str:
        return f"({'h' if self.tie is None else 'id'} - {self.low}L) div {self.step}L"


def _sizes(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.expr(f"xxhash64(coalesce(text, '')) & {TOP}L").alias("h"),
        F.expr(f"coalesce(cast(doc_id as bigint), {NO_ID}L)").alias("id"),
    )


def find_splitters(sized: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (hash, id) of the first row of each shard but the first; ``tolerance`` is a share of a shard's bytes."""
    total, least, most = sized.agg(F.sum("size"), F.min("id"), F.max("id")).first()
    if not total:
        return []
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    #: For each open splitter, the span that holds it and the bytes below that span.
    open_: dict[int, tuple[Span, int]] = {i: (Span(None, 0, TOP), 0) for i in range(1, shards)}
    while open_:
        spans = sorted({s for s, _ in open_.values()}, key=lambda s: (s.tie is not None, s.tie or 0, s.low))
        number = "case " + " ".join(f"when {s.test()} then {k * PROBES} + {s.bin()}" for k, s in enumerate(spans)) + " end"
        counts = dict(sized.groupBy(F.expr(number).alias("bin")).agg(F.sum("size")).where("bin is not null").collect())
        for i, (span, below) in list(open_.items()):
            target, at = total * i / shards, spans.index(span) * PROBES
            for k in range(PROBES):
                low, high = span.low + k * span.step, min(span.high, span.low + (k + 1) * span.step)
                after = below + counts.get(at + k, 0)
                if after > target or high >= span.high:
                    break
                below = after
            key = (lambda x: (x, -TOP)) if span.tie is None else (lambda x, t=span.tie: (t, x))
            near, place = min((abs(target - below), low), (abs(target - after), high))
            if near <= slack or high - low <= 1 and span.tie is not None:
                found[i] = key(place)
            elif high - low <= 1:
                open_[i] = (Span(low, least, most + 1), below)
                continue
            else:
                open_[i] = (Span(span.tie, low, high), below)
                continue
            del open_[i]
    return [found[i] for i in sorted(found)]


def _shard_of(splitters: list[tuple[int, int]], first: int = 0) -> str:
    """Number of splitters at or below a row's key, by a balanced tree of comparisons."""
    if not splitters:
        return str(first)
    mid = len(splitters) // 2
    h, i = splitters[mid]
    return f"if(h > {h}L or (h = {h}L and id >= {i}L), {_shard_of(splitters[mid + 1 :], first + mid + 1)}, {_shard_of(splitters[:mid], first)})"


def shard(df: DataFrame, shards: int = 40, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, h for each row of ``df`` (law ``bytes``; grown_shard is null)."""
    sized = keep(_sizes(df))
    placed = sized.withColumn("shard", F.expr(_shard_of(find_splitters(sized, shards, tolerance))))
    parts = max(8, -(-sized.count() // (shards * PART_ROWS)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts).cast("long")))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.selectExpr("shard", "part", "cast(sum(n) over (partition by shard order by part rows between unbounded preceding and current row) - n as bigint) as start")
    numbered = placed.selectExpr("*", "row_number() over (partition by shard, part order by id, h) - 1 as place")
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(df: DataFrame, target: str, shards: int = 40, tolerance: float = 0.001) -> None:
    """Write the rows of ``df`` (doc_id, text and any other columns) under ``target`` by shard, in one exchange of the rows; a column named shard is replaced."""
    splitters = find_splitters(keep(_sizes(df)), shards, tolerance)
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.expr(f"xxhash64(coalesce(text, '')) & {TOP}L").alias("h"), F.expr(f"coalesce(cast(doc_id as bigint), {NO_ID}L)").alias("id"))
    placed = keyed.withColumn("shard", F.expr(_shard_of(splitters))).repartition("shard", F.pmod(F.xxhash64("id"), F.lit(8).cast("long")))
    placed.select(*[F.col(f"row.`{c}`") for c in df.columns if c != "shard"], "shard").write.mode("overwrite").partitionBy("shard").parquet(target)
