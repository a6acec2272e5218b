"""Hard negatives by ball trees, searched by branch and bound.

An anchor's score of a row is their inner product in whole numbers; higher scores come first, ties by smaller vec_id.  Its
positives are its first rows of the same label; for each positive the negatives are its first rows of another label whose score lies in a window below the positive's.

* Each partition packs its rows, in blocks of ``TREE_ROWS``, into ball trees (centre and radius of each node, one subtree for each
  frequent label) that are written once; no row is shuffled for it.
* Anchors are searched in blocks of about ``ANCHORS``, each sent to all tasks: its size is bounded by that constant, not by the table.  A task walks its
  trees with the whole block.  A node with centre c and radius r holds only scores from q.c - |q|r to q.c + |q|r, so an anchor leaves a node
  whose upper bound is strictly below its k-th score so far or whose bounds lie outside its window, and nodes of unwanted labels.
  Nodes with higher upper bounds are entered first, and the k-th scores are carried from tree to tree of a task.
* Each task returns at most k rows an anchor (and positive); the first k of these are the result.  The search is exact.

A block takes two passes over the trees, one for the positives and one for the negatives, so a table of N rows takes 2 N / (50 ``ANCHORS``) passes.

Defined results: rows without vec_id, label or vector, or with a null or non-finite component, take no part; shorter vectors are filled up with
zeros; of rows that share a vec_id the one with the smallest label, then vector, stands for all; an anchor without positives, or a positive without
negatives, has no rows; an empty table gives an empty result; extra columns are not read.  Scores are exact below 2**63.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.shared import keep, small_batches

TREE_ROWS = 4096
LEAF = 128
ANCHORS = 16_384
POSITIVES = 5
NEGATIVES = 3
#: A negative's score is at least LOW % and at most HIGH % of the positive's.
LOW, HIGH = 50, 95
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53


def prepared(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (whole numbers: floor of ``scale`` times each component) of the rows that take part, one for each vec_id."""
    ids = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    ids = ids.where("vec_id is not null and label is not null and e is not null and not exists(e, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = ids.select("vec_id", "label", F.expr(f"transform(e, x -> cast(floor({scale} * x) as bigint))").alias("vector"))
    if not ids.groupBy("vec_id").count().where("count > 1").isEmpty():  # vectors are shuffled only where ids repeat
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")
    return rows


class Tree:
    """Rows in the order of the leaves (by vec_id in each), and nodes (start, stop, children, centre, radius, the only label or None)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        near = vectors.astype(np.float64)
        kinds, counts = np.unique(labels, return_counts=True)
        self.nodes: list[tuple] = []
        many = set(kinds[counts >= LEAF].tolist())
        rare = ~np.isin(labels[order], list(many))
        order = np.concatenate([order[~rare], order[rare]])
        ends = [*np.cumsum([c for k, c in zip(kinds.tolist(), counts.tolist()) if k in many]).tolist(), len(ids)]
        parts = [(a, b) for a, b in zip([0, *ends[:-1]], ends) if b > a]
        self.order = order
        self.labels, self._near = labels, near
        tops = [self._grow(a, b) for a, b in parts]
        self.root = tops[0] if len(tops) == 1 else self._node(0, len(ids), tops)
        self.ids, self.labels, self.vectors = ids[self.order], labels[self.order], vectors[self.order]
        del self.order, self._near

    def _node(self, a: int, b: int, children: list[int]) -> int:
        rows = self._near[self.order[a:b]]
        centre = rows.mean(axis=0)
        kinds = self.labels[self.order[a:b]]
        self.nodes.append((a, b, children, centre, float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())), int(kinds[0]) if (kinds == kinds[0]).all() else None))
        return len(self.nodes) - 1

    def _grow(self, a: int, b: int) -> int:
        """Halves along the line between two rows far apart, down to ``LEAF`` rows or equal ones; no deeper than the logarithm of the rows."""
        rows = self._near[self.order[a:b]]
        if b - a > LEAF:
            one = rows[((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            two = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            if (one != two).any():
                self.order[a:b] = self.order[a:b][np.argsort(rows @ (two - one), kind="stable")]
                half = (a + b) // 2
                return self._node(a, b, [self._grow(a, half), self._grow(half, b)])
        self.order[a:b] = np.sort(self.order[a:b])  # rows come by vec_id
        return self._node(a, b, [])


class Best:
    """The first k (score, id) of each anchor and slot so far."""

    def __init__(self, anchors: int, slots: int, k: int, kind: type) -> None:
        self.none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        self.scores, self.ids = np.full((anchors, slots, k), self.none, kind), np.full((anchors, slots, k), np.iinfo(np.int64).max, np.int64)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return self.scores[rows, :, -1]

    def add(self, slot: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[2]
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, k), rows])
        scores, ids = np.concatenate([self.scores[touched, slot].ravel(), scores]), np.concatenate([self.ids[touched, slot].ravel(), ids])
        order = np.lexsort((ids, -scores if scores.dtype == np.float64 else ~scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.searchsorted(rows, touched)
        take = first[:, None] + np.arange(k)
        self.scores[touched, slot], self.ids[touched, slot] = scores[take], ids[take]


class Block:
    """A block of anchors: ids, labels, vectors, and the window [low, high] of each slot."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.vectors, self.low, self.high, self.k, self.same = ids, labels, vectors, low, high, k, same
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))

    def search(self, tree: Tree, best: Best) -> None:
        near = self.vectors.astype(np.float64)
        wide = near.shape[1]
        if wide < tree.vectors.shape[1]:
            raise ValueError("anchors are as wide as the widest row")
        stack = [(tree.root, np.arange(len(self.ids)))]
        while stack:
            at, rows = stack.pop()
            a, b, children, centre, radius, only = tree.nodes[at]
            if only is not None:
                rows = rows[(self.labels[rows] == only) == self.same]
            middle, reach = near[rows, : len(centre)] @ centre, self.norms[rows] * radius
            reach = reach * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle) * 1e-6)  # bounds are rounded outwards
            alive = ((middle + reach)[:, None] >= np.maximum(self.low[rows], best.kth(rows))) & ((middle - reach)[:, None] <= self.high[rows])
            rows = rows[alive.any(axis=1)]
            if not len(rows):
                continue
            if children:
                # the child whose centre most anchors score highest is on top of the stack
                means = near[rows].mean(axis=0)
                stack += [(c, rows) for c in sorted(children, key=lambda c: means[: len(centre)] @ tree.nodes[c][3])]
                continue
            self._leaf(tree, a, b, rows, best)

    def _leaf(self, tree: Tree, a: int, b: int, rows: np.ndarray, best: Best) -> None:
        kind = best.scores.dtype
        scores = self.vectors[rows, : tree.vectors.shape[1]].astype(kind) @ tree.vectors[a:b].astype(kind).T
        ids, fits = tree.ids[a:b], (tree.labels[a:b] == self.labels[rows][:, None]) == self.same
        if self.same:
            fits &= ids != self.ids[rows][:, None]
        kth = best.kth(rows)
        for slot in range(self.low.shape[1]):
            good = fits & (scores >= np.maximum(self.low[rows, slot], kth[:, slot])[:, None]) & (scores <= self.high[rows, slot][:, None])
            i, j = np.nonzero(good)
            if len(i):
                best.add(slot, rows[i], scores[i, j], ids[j])


def _narrow(values: np.ndarray) -> np.ndarray:
    """In the smallest whole type that holds them."""
    most = int(max(abs(int(values.min())), abs(int(values.max())))) if values.size else 0
    return values.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    sizes = np.asarray(column.value_lengths())
    wide = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def trees(rows: DataFrame) -> DataFrame:
    """The rows of each partition as ball trees: one row a tree (rows, widest vector, largest norm, tree), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            vectors = _matrix(whole.column("vector").combine_chunks())
            tree = Tree(whole.column("vec_id").to_numpy(), whole.column("label").to_numpy(), _narrow(vectors))
            norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([len(vectors)], pa.int64()), pa.array([vectors.shape[1]], pa.int32()), pa.array([norm]), pa.array([pickle.dumps(tree, 5)], pa.binary())], ["n", "width", "norm", "tree"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                room = TREE_ROWS - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if sum(x.num_rows for x in held) == TREE_ROWS:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return keep(rows.select("vec_id", "label", "vector").mapInArrow(run, "n long, width int, norm double, tree binary"))


def searched(forest: DataFrame, block: Block, exact: bool) -> DataFrame:
    """anchor, slot, score, id: the first k rows of each anchor and slot over each task's trees."""
    sent = forest.sparkSession.sparkContext.broadcast(block)  # at most about ANCHORS anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        best = Best(len(own.ids), own.low.shape[1], own.k, np.float64 if exact else np.int64)
        for b in batches:
            for packed in b.column(0):
                own.search(pickle.loads(packed.as_py()), best)
        anchor, slot, place = np.nonzero(best.scores != best.none)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.ids[anchor]), pa.array(slot.astype(np.int32)), pa.array(best.scores[anchor, slot, place].astype(np.int64)), pa.array(best.ids[anchor, slot, place])], ["anchor", "slot", "score", "id"]
        )

    small_batches(forest.sparkSession, 16)  # trees are large rows
    return forest.select("tree").mapInArrow(run, "anchor long, slot int, score long, id long")


def _first(found: DataFrame, keys: str, k: int) -> DataFrame:
    return found.withColumn("rank", F.expr(f"row_number() over (partition by {keys} order by score desc, id)")).where(f"rank <= {k}")


def mine(df: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the rows of ``prepared`` that ``anchors`` names against all."""
    forest = trees(df)
    size = forest.agg(F.max("width").alias("width"), F.max("norm").alias("norm")).first()
    chosen = df.where(anchors)
    blocks = max(1, -(-chosen.count() // ANCHORS)) if size.width else 0
    exact = blocks == 0 or size.norm**2 < EXACT
    kind, made = np.float64 if exact else np.int64, None
    if blocks > 1:
        chosen = keep(chosen)
    for n in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow().combine_chunks()  # bounded by ANCHORS
        if not own.num_rows:
            continue
        ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
        vectors = _narrow(_matrix(own.column("vector").combine_chunks(), size.width))
        low_end, high_end = (-np.inf, np.inf) if exact else (np.iinfo(np.int64).min, np.iinfo(np.int64).max)
        window = np.full((len(ids), 1), low_end, kind), np.full((len(ids), 1), high_end, kind)
        near = keep(_first(searched(forest, Block(ids, labels, vectors, *window, positives, True), exact), "anchor", positives).select("anchor", "rank", "score", "id"))
        # each positive is a slot with a window of its own; where there is none, the window is empty
        held = near.toArrow().combine_chunks()
        order = np.argsort(ids)
        row, slot = order[np.searchsorted(ids[order], held.column("anchor").to_numpy())], held.column("rank").to_numpy() - 1
        score = held.column("score").to_numpy()
        least, most = np.full((len(ids), positives), high_end, kind), np.full((len(ids), positives), low_end, kind)
        least[row, slot], most[row, slot] = -((-low * score) // 100), (high * score) // 100
        far = searched(forest, Block(ids, labels, vectors, least, most, negatives, False), exact)
        pairs = near.selectExpr("anchor as p_anchor", "rank - 1 as p_slot", "score as positive_score", "id as positive_id")
        found = _first(far, "anchor, slot", negatives).join(pairs, F.expr("anchor = p_anchor and slot = p_slot"))
        found = found.selectExpr("anchor as anchor_id", "positive_id", "rank", "id as negative_id", "positive_score", "score as negative_score")
        if blocks > 1:
            found = keep(found)  # the broadcast of a block is needed no more
        made = found if made is None else made.union(found)
    return made if made is not None else df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


#: For DuckDB, of the query over ``embeddings``.
ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM rows AS a JOIN rows AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM scored WHERE alike),
far AS (
  SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INT) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM near AS p JOIN scored AS n ON p.anchor_id = n.anchor_id AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score WHERE p.r <= 5)
SELECT * FROM far WHERE rank <= 3"""
