"""Token ids packed by best-fit decreasing and written as fixed-width matrices.

Each task tokenises its documents and gathers their pieces in a buffer of bounded size.  A full buffer is
packed by best-fit decreasing: pieces in descending length, each into the fullest sequence that still
holds it.  A segment tree over capacities, which stores for each remaining capacity how many open sequences
have it, finds that sequence in logarithmic time.  Documents longer than a sequence are split losslessly
first.  Sequences leave the task as rows of one matrix: ids padded to the capacity, the cumulative segment
lengths, and positions that restart at each piece.  Ids and positions are binary rows of little-endian
unsigned 16-bit numbers where the vocabulary and the capacity fit them, else of 32-bit numbers (column
``item_bytes``), ready to be mapped as one matrix.  No row is shuffled, so ids never cross the network.

Defined results: an empty document (or a null text) is its closing id alone; a document's pieces may lie in
different sequences and are put together again by (doc_id, start); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.shared import small_batches
from kenmap.llm.token_ids import SLICE, token_ids

BUFFER_PIECES = 20_000

SCHEMA = "sequence_id string, n_tokens int, doc_ids array<long>, starts array<long>, cu_lengths array<int>, item_bytes int, input_ids binary, position_ids binary"


class CapacityTree:
    """Open sequences by remaining capacity; a segment tree of counts answers 'smallest capacity of at least n'."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = self.size + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the fullest open sequence with room for ``least``; it is open no longer."""
        node = self.size + least
        while not self.count[node]:
            while node & 1:  # a right child: nothing further right below this parent
                node >>= 1
                if node <= 1:
                    return None
            if node <= 1:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the pieces of each sequence, in placing order."""
    tree, sequences = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (found := tree.take(lengths[i])) is None:
            room, at = capacity, len(sequences)
            sequences.append([])
        else:
            room, at = found
        sequences[at].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], at)
    return sequences


def packed_rows(df: DataFrame, path: str, capacity: int = 2048, closing_id: int = 0, pad_id: int = 0, buffer_pieces: int = BUFFER_PIECES) -> DataFrame:
    """One row for each sequence: its id matrix row, cumulative segment lengths and position resets, and which pieces it holds.

    ``sequence_id`` is unique within one result (task number and count).
    """

    def matrices(task: int, made: int, pieces: list[tuple[int, int, np.ndarray]], kind: np.dtype) -> pa.RecordBatch:
        packed = best_fit_decreasing([len(p[2]) for p in pieces], capacity)
        ids = np.full((len(packed), capacity), pad_id, kind)
        places = np.zeros((len(packed), capacity), kind)
        counting = np.arange(capacity, dtype=kind)
        cols: list[list] = [[], [], [], [], []]
        for row, members in enumerate(packed):
            ends = [0]
            for i in members:
                part = pieces[i][2]
                ids[row, ends[-1] : ends[-1] + len(part)] = part
                places[row, ends[-1] : ends[-1] + len(part)] = counting[: len(part)]
                ends.append(ends[-1] + len(part))
            for c, v in zip(cols, (f"{task}-{made + row}", ends[-1], [pieces[i][0] for i in members], [pieces[i][1] for i in members], ends)):
                c.append(v)
        cols += [[kind.itemsize] * len(packed), [row.tobytes() for row in ids], [row.tobytes() for row in places]]
        kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
        names = ["sequence_id", "n_tokens", "doc_ids", "starts", "cu_lengths", "item_bytes", "input_ids", "position_ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task, made, pieces = token_ids(path), TaskContext.get().partitionId(), 0, []
        kind = np.dtype("<u2" if max(own.top, capacity) <= 2**16 else "<u4")
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            for doc_id, raw in zip(b.column(0).to_pylist(), own.raw(b.column(1).cast(pa.binary()).to_pylist())):
                ids = np.append(np.frombuffer(raw, "=u4"), np.uint32(closing_id)).astype(kind)
                pieces += [(doc_id, at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]
                if len(pieces) >= buffer_pieces:
                    for out in cut(task, made, pieces, kind):
                        made += out.num_rows
                        yield out
                    pieces = []
        if pieces:
            yield from cut(task, made, pieces, kind)

    def cut(task: int, made: int, pieces: list, kind: np.dtype) -> Iterator[pa.RecordBatch]:
        whole = matrices(task, made, pieces, kind)
        for at in range(0, whole.num_rows, 512):
            yield whole.slice(at, 512)

    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_packed(df: DataFrame, target: str, path: str, capacity: int = 2048) -> None:
    """Write the matrices as Parquet under ``target`` (fixed-width id rows, cumulative lengths, position resets)."""
    packed_rows(df, path, capacity).write.mode("overwrite").parquet(target)
