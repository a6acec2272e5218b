"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct five-word shingles (64-bit hashes).  Two documents link when
intersection / union >= 0.8.  Then the symmetric difference D of their sets is at most (a + b) / 9 for sizes
a <= b <= 1.25 a, and this is what the join looks for:

* Sizes fall into bands.  Each band fixes a sketch of k words, k a little above the largest D + 1 of the
  band; every token is XOR-ed into the one word that its hash points to.  A token that only one of two
  documents has changes one word, so the number of words that differ is a lower bound of their symmetric difference.
* Pigeonhole: among any D + 1 words that one document fills, one must be equal in both.  So a document
  sends its first D + 1 filled words, in word order, as keys, for the band of every size that a partner of
  its own or smaller size may have.  In the bands up to 64 shingles each token is a word of its own.
* Keys are dealt by hash, packed into one binary row for each batch and part, and matched by sorting in the part.
* Documents that share a key are tried first against the smallest id of that key.  A pair goes on where its sizes and
  its folded parity sketches (two to four bits a token) allow a link, and is verified exactly on whole texts.
  Where a key's documents are then still in several components, all pairs across components are tried
  that sizes and sketches allow, and verified.  So no link between components is lost,
  while copies of copies are never expanded into all pairs.  A key of many documents is split into blocks of about
  ``BLOCK`` documents, and each pair of blocks is a group of its own, so no task takes a whole key.
* Links, and equal sets, are joined into components by alternating large-star and small-star steps.

A document has fewer filled words than D + 1 with a chance below 1e-9 (band widths are chosen so); it then sends all.

Defined results: a null or empty text, or one of white space, has no set (0 shingles) and links with
nothing; rows with one doc_id are one document; a row without doc_id gets no component_id and links
with nothing; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.shared import keep, release, small_batches

WIDTH = 5
KEYS_PER_PART = 1_500_000
#: Documents of a key that are compared in one group, and that one row lists.
BLOCK = 4096
SALTS = 32
U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0xA24BAED4963EE407
_PLACE = mix(np.arange(1, WIDTH + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)) | U(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            inverse = pow(_BASE, -1, 2**64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (_BASE, inverse))
        return self.up, self.down


_POWERS = _Powers()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    raw = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, U)
    gaps = np.concatenate([[True], raw == 32, [True]])
    starts, ends = np.flatnonzero(gaps[:-1] & ~gaps[1:]), np.flatnonzero(~gaps[:-1] & gaps[1:])
    if not len(starts):
        return np.zeros(0, U)
    up, down = _POWERS.get(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[raw] * up[: len(raw)])])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    if len(words) < WIDTH:  # the whole sequence, told apart from longer ones
        return mix(np.array([np.sum(words * _PLACE[: len(words)]) + U(len(words))], U))
    out = words[: len(words) - WIDTH + 1] * _PLACE[0]
    for i in range(1, WIDTH):
        out = out + words[i : len(words) - WIDTH + 1 + i] * _PLACE[i]
    return np.unique(mix(out))


@lru_cache(maxsize=1)
def bands() -> list[int]:
    """The smallest size of each band: each is a quarter larger than the one before."""
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


def most_apart(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) // 9


@lru_cache(maxsize=None)
def words_of(band: int) -> int:
    """Number of sketch words of a band; 0: each token is a word of its own."""
    top = bands()[band + 1] - 1
    return 0 if top <= 64 else most_apart(top, top * 5 // 4) + 1 + top // 20 + 12


def keys(tokens: np.ndarray) -> np.ndarray:
    """The keys under which a document looks for partners, from its sorted tokens."""
    n, out = len(tokens), []
    own = bisect_right(bands(), n) - 1
    for band in range(bisect_right(bands(), -(-4 * n // 5)) - 1, own + 1):
        apart = most_apart(n, n * 5 // 4 if band == own else min(n, bands()[band + 1] - 1))
        k = words_of(band)
        if k:
            at = ((tokens >> U(32)) * U(k)) >> U(32)
            first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            first, stop = first[: apart + 1], first[apart + 1] if len(first) > apart + 1 else n
            word = np.bitwise_xor.reduceat(mix(tokens[:stop]), first)
            out.append(mix(word ^ mix(at[first] * U(0x9E3779B97F4A7C15) + U(band + 1))))
        else:
            out.append(mix(mix(tokens[: apart + 1]) + U(band + 1)))
    return np.concatenate(out) if len(out) > 1 else out[0]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity sketch of 2**m bits, m growing with the size: bit i is the parity of the tokens whose hash points to i."""
    bits = 1 << min(15, max(6, math.ceil(math.log2(2 * len(tokens) + 1))))
    odd = np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same tokens with fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


def _documents(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), same (digest of the set; null for an empty one), bits (its parity sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bits = [sketch(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "same", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, same binary, bits binary")


def _key_parts(docs: DataFrame, parts: int) -> DataFrame:
    """part, ids, counts, keys: for each batch and part the documents with keys there, how many each, and the keys (six bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen, ids, found = set(), [], []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = shingles(text)
                if not len(tokens) or doc_id is None or (own := hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()) in seen:
                    continue  # equal sets are joined by their digests
                seen.add(own)
                ids.append(doc_id)
                found.append(keys(tokens))
            if len(ids) >= 6000:
                yield packed(ids, found)
                seen, ids, found = set(), [], []
        yield packed(ids, found)

    def packed(ids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], []]
        if ids:
            flat, owner = np.concatenate(found), np.repeat(np.arange(len(ids)), [len(k) for k in found])
            part = (((flat >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            flat, owner, part, known = flat[order], owner[order], part[order], np.array(ids, np.int64)
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for lo, hi in zip(edges, edges[1:]):
                who, n = np.unique(owner[lo:hi], return_counts=True)
                six = flat[lo:hi].view(np.uint8).reshape(-1, 8)[:, :6]
                for r, v in zip(rows, (int(part[lo]), known[who].tobytes(), n.astype(np.uint32).tobytes(), six.tobytes())):
                    r.append(v)
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "ids", "counts", "keys"])

    return docs.mapInArrow(run, "part int, ids binary, counts binary, keys binary")


def _groups(parts: DataFrame) -> DataFrame:
    """gid, head, size, chunk, members: the sorted documents of each key that several have, each set of documents once, in rows of at most ``BLOCK``."""

    def run(table: pa.Table) -> pa.Table:
        size = pc.sum(pc.binary_length(table["keys"])).as_py() // 6
        owner, key, at = np.empty(size, np.int64), np.zeros(size, U), 0
        for row in range(table.num_rows):
            ids, counts, raw = (table[c][row].as_py() for c in ("ids", "counts", "keys"))
            stop = at + len(raw) // 6
            owner[at:stop] = np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32))
            key[at:stop].view(np.uint8).reshape(-1, 8)[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            at = stop
        order = np.argsort(key)
        key = key[order]
        owner = owner[order]
        del order
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        wide = np.flatnonzero(np.diff(edges) > 1)
        out = {}
        for lo, hi in zip(edges[wide], edges[wide + 1]):
            members = np.unique(owner[lo:hi])
            if len(members) > 1:
                out[hashlib.blake2b(members.tobytes(), digest_size=16).digest()] = members
        rows = [(gid, int(m[0]), len(m), k, m[at : at + BLOCK]) for gid, m in out.items() for k, at in enumerate(range(0, len(m), BLOCK))]
        kinds = (("gid", pa.binary()), ("head", pa.int64()), ("size", pa.int64()), ("chunk", pa.int32()), ("members", pa.list_(pa.int64())))
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})

    return parts.groupBy("part").applyInArrow(run, "gid binary, head long, size long, chunk int, members array<long>").dropDuplicates(["gid", "chunk"])


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            keep_ = []
            for x, n, y, m in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                size = min(len(x), len(y))
                apart = np.bitwise_count(fold(np.frombuffer(x, np.uint8), size).view(U) ^ fold(np.frombuffer(y, np.uint8), size).view(U)).sum()
                keep_.append(9 * int(apart) <= n + m and 5 * min(n, m) >= 4 * max(n, m))
            yield b.select(["a", "b"]).filter(pa.array(keep_, pa.bool_()))

    left = pairs.join(sketches.selectExpr("doc_id as a", "bits as x", "n as n"), "a")
    return left.join(sketches.selectExpr("doc_id as b", "bits as y", "n as m"), "b").select("a", "b", "x", "n", "y", "m").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, by the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            held: str | None = None  # the text of ``one``; rows of one text mostly follow one another, and an id may have several texts
            one = np.empty(0, U)
            out: list[tuple[int, int]] = []
            for x, y, s, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                if s != held:
                    held, one = s, shingles(s)
                if linked(one, shingles(t)):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    left = pairs.join(docs.withColumnsRenamed({"doc_id": "a", "text": "s"}), "a")
    return left.join(docs.withColumnsRenamed({"doc_id": "b", "text": "t"}), "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node that is reachable) of each node of the edges (a, b)."""
    edges = keep(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = both.join(least, "a").where("b > a").selectExpr("b as a", "m as b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("inline(array(struct(a as a, m as b), struct(b as a, m as b)))").where("a <> b").distinct()
        edges = keep(small)
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state


def _rest_pairs(groups: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of one key in different components that sizes and sketches allow."""
    open_ = groups.select("gid", "size", F.explode("members").alias("doc_id")).join(found.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    wide = open_.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gid")
    open_ = open_.join(wide, "gid").withColumn("blocks", F.expr(f"(size + {BLOCK - 1}) div {BLOCK}")).withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks"))
    # A document goes to the tile of its block with each block; one block alone is one tile.
    tiles = keep(open_.select("gid", "doc_id", "component", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other")).selectExpr("gid", "least(own, other) as t1", "greatest(own, other) as t2", "doc_id", "component", "own"))

    def pairs(table: pa.Table) -> pa.Table:
        tile = (table["t1"][0].as_py(), table["t2"][0].as_py())
        order = np.argsort(table["n"].to_numpy(), kind="stable")
        doc, comp, n, own = (table[c].to_numpy()[order] for c in ("doc_id", "component", "n", "own"))
        raw = table["bits"].to_pylist()
        size = min(map(len, raw))  # sizes within a key differ by little: one folding of the larger sketches suits all
        bits = np.stack([fold(np.frombuffer(raw[i], np.uint8), size) for i in order]).view(U)
        stops = np.searchsorted(n, n * 5 // 4, "right")  # sizes ascend
        out: list[tuple[int, int]] = []
        for i in range(len(doc) - 1):
            apart = np.bitwise_count(bits[i + 1 : stops[i]] ^ bits[i]).sum(axis=1)
            js = i + 1 + np.flatnonzero((9 * apart <= n[i] + n[i + 1 : stops[i]]) & (comp[i + 1 : stops[i]] != comp[i]) & ((own[i + 1 : stops[i]] != own[i]) | (tile[0] == tile[1])))
            out += [(int(doc[i]), int(j)) for j in doc[js]]
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return tiles.join(sketches, "doc_id").groupBy("gid", "t1", "t2").applyInArrow(pairs, "a long, b long").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()


def jaccard_join(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``df`` (doc_id, text)."""
    small_batches(df.sparkSession)
    docs = _documents(df)
    sizes = keep(_sizes(docs))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    groups = keep(_groups(_key_parts(docs, max(8, -(-2 * total // (5 * KEYS_PER_PART))))))
    known = docs.where("doc_id is not null")
    sketches = sizes.where("n > 0 and doc_id is not null").dropDuplicates(["doc_id", "same"]).select("doc_id", "n", "bits")
    stars = groups.select(F.col("head").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct()
    equal = sizes.where("doc_id is not null and same is not null")
    # Sets that several documents have are few; each goes to ``SALTS`` tasks, so that a set of a third of all documents is no task's alone.
    first = equal.groupBy("same").agg(F.min("doc_id").alias("b"), F.count("*").alias("copies")).where("copies > 1").select("same", "b", F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("salt"))
    salted = equal.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id), {SALTS}) as int)"))
    edges = salted.join(first, ["same", "salt"]).select(F.col("doc_id").alias("a"), "b").where("a <> b").union(_verified(keep(_possible(stars, sketches)), known))
    found = components(edges)
    rest = keep(_rest_pairs(groups, found, sketches))
    if not rest.isEmpty():
        found = components(found.withColumnsRenamed({"node": "a", "component": "b"}).union(_verified(rest, known)))
    placed = sizes.join(found.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


#: DuckDB SQL for the rows of ``jaccard_join`` over ``documents``: all pairs that share a shingle, and all that each document reaches.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least_id, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM r GROUP BY a) AS c USING (doc_id)
"""
