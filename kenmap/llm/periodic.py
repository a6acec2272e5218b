"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
``max(MIN_WORDS, MIN_POWER * q)`` words that no neighbouring word extends.  For each text:

* A run repeats every window of ``WINDOW`` of its words, so only stretches under windows that occur twice in the text
  are looked at (by 64-bit hashes of all windows; a collision only adds a stretch).  What follows is exact.
* A suffix automaton of the stretch, with the end of the first occurrence in each state, gives its Lempel-Ziv
  factors: the longest prefix of the rest that also starts earlier, or a new word.
* Main's algorithm finds the runs that touch the start of a factor: the common prefixes and suffixes on
  both sides of it, by Z arrays, say for every period how far its repetition reaches.  Their reach to the left is at most
  two factors before and one behind, so all factors together take linear time.
* The runs that lie strictly inside a factor are copied from the factor's earlier occurrence.

Memory is about 60 bytes a word of the longest stretch, and a dictionary for each branching state.

Defined results: a null or empty text, or one of white space, has no words and no runs; repeated rows give repeated
results; rows without doc_id are kept; an empty table stays empty; extra columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.shared import small_batches

MIN_WORDS = 24
MIN_POWER = 3
#: A run of L words and period q repeats L - q words q words later, and L - q is at least two thirds of L.
WINDOW = MIN_WORDS - MIN_WORDS // MIN_POWER
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class SuffixAutomaton:
    """The automaton of all stretches of ``words`` (small whole numbers).

    ``ends[v]`` is where the first occurrence of the stretches of state v ends.  A state's first transition is in ``word`` and ``target``; further ones are in ``more``.
    """

    def __init__(self, words: list[int]) -> None:
        size = 2 * len(words) + 2
        self.word, self.target, self.ends, self.more = array("q", [-1]) * size, array("q", [0]) * size, array("q", [0]) * size, {}
        length, link = array("q", [0]) * size, array("q", [-1]) * size
        word, target, ends, more = self.word, self.target, self.ends, self.more
        count, last = 1, 0
        for i, c in enumerate(words):
            now, p, found = count, last, -1
            count += 1
            length[now], ends[now] = length[last] + 1, i
            while p >= 0:
                if word[p] == c:
                    found = target[p]
                    break
                if word[p] < 0:
                    word[p], target[p] = c, now
                else:
                    others = more.get(p)
                    if others is None:
                        more[p] = {c: now}
                    elif c in others:
                        found = others[c]
                        break
                    else:
                        others[c] = now
                p = link[p]
            if p < 0:
                link[now] = 0
            elif length[p] + 1 == length[found]:
                link[now] = found
            else:
                copy = count
                count += 1
                length[copy], link[copy], ends[copy] = length[p] + 1, link[found], ends[found]
                word[copy], target[copy] = word[found], target[found]
                if found in more:
                    more[copy] = dict(more[found])
                while p >= 0:
                    if word[p] == c:
                        if target[p] != found:
                            break
                        target[p] = copy
                    elif p in more and more[p].get(c) == found:
                        more[p][c] = copy
                    else:
                        break
                    p = link[p]
                link[found] = link[now] = copy
            last = now

    def next(self, state: int, c: int) -> int:
        return self.target[state] if self.word[state] == c else self.more[state][c]


def factors(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1) of each Lempel-Ziv factor; the earlier occurrence may overlap the factor."""
    known, start, n = SuffixAutomaton(words), 0, len(words)
    while start < n:
        state, end = 0, start
        while end < n:
            further = known.next(state, words[end])
            if known.ends[further] >= end:
                break
            state, end = further, end + 1
        if end == start:
            yield start, start + 1, -1
            start += 1
        else:
            yield start, end, known.ends[state] - (end - start) + 1
            start = end


def z_array(s: list[int]) -> np.ndarray:
    """How many words from each place on equal the beginning of ``s``."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return np.array(z, np.int64)


def _touching(words: list[int], low: int, at: int, high: int, least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs with ``low`` < start <= at <= end < high, or that the text ends there; periods may be multiples of the smallest one."""
    left, right = words[low:at], words[at:high]
    n, m = len(left), len(right)
    top = (n + m) // power
    back = left[::-1]
    found = []
    after = np.arange(1, min(m, top) + 1)  # a whole period stands behind ``at``
    if len(after):
        ahead = np.append(z_array(right), 0)[after]
        behind = z_array([*back, -1, *right[::-1], *back])[n + 1 + m - after]
        found.append((at - np.minimum(behind, n), at + after + ahead, after))
    before = np.arange(1, min(n, top) + 1)  # or before it
    if len(before):
        ahead = z_array([*right, -1, *left, *right])[m + 1 + n - before]
        behind = np.append(z_array(back), 0)[before]
        found.append((at - before - behind, at + np.minimum(ahead, m), before))
    out = []
    for start, end, period in found:
        good = (end - start >= np.maximum(least, power * period)) & ((start > low) | (low == 0)) & ((end < high) | (high == len(words)))
        out += zip(start[good].tolist(), end[good].tolist(), period[good].tolist())
    return out


def maximal_runs(words: list[int], least: int = MIN_WORDS, power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``power`` (2 or more) periods, by start, then period."""
    runs: dict[tuple[int, int], int] = {}
    by_start: dict[int, list[int]] = {}
    before, n = 0, len(words)
    for start, end, earlier in [*factors(words), (n, n, -1)]:  # the end of the text counts as a factor: runs may touch it
        low, high = max(0, start - 2 * before - (end - start) - 1), min(n, end + 1)
        if high - low >= least:
            for b, e, q in _touching(words, low, start, high, least, power):
                if e > end:  # the next factor's
                    continue
                if (b, e) not in runs:
                    by_start.setdefault(b, []).append(e)
                runs[b, e] = min(q, runs.get((b, e), q))
        if end - start > least and earlier >= 0:
            shift = start - earlier
            for b in range(start + 1, end - least):
                for e in list(by_start.get(b - shift, ())):
                    if e + shift < end and (b, e + shift) not in runs:
                        runs[b, e + shift] = runs[b - shift, e]
                        by_start.setdefault(b, []).append(e + shift)
        before = end - start
    return sorted((b, e - b, q) for (b, e), q in runs.items())


def _repeated(words: list[bytes]) -> list[tuple[int, int]]:
    """The stretches under windows of ``WINDOW`` words that occur more than once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return []
    h, width = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        h = (h[: len(h) - step] * _ODD + h[step:]) ^ np.uint64(width)
        h ^= h >> np.uint64(29)
        width += step
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    if not len(twice):
        return []
    cuts = np.flatnonzero(np.diff(twice) > WINDOW) + 1
    return [(int(g[0]), int(g[-1]) + WINDOW) for g in np.split(twice, cuts)]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a text's words, by start, then period."""
    out = []
    for start, end in _repeated(words):
        if end - start >= MIN_WORDS:
            codes: dict[bytes, int] = {}
            coded = [codes.setdefault(w, len(codes)) for w in words[start:end]]
            out += [(start + b, length, q) for b, length, q in maximal_runs(coded)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(df: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period), collapsed (the words kept, joined by one space).

    One row for each row of ``df``, without a shuffle.  ``edit`` (of doc_id and words) gives the words to be looked at, where they are not the text's own.
    """
    small_batches(df.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            n, runs, kept = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()  # bytes part at the six ASCII white-space characters
                if edit is not None:
                    words = edit(doc_id, words)
                found = runs_of(words)
                n.append(len(words))
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in found])
                kept.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: doc_id, n_runs, the run of the greatest power (start, length, period, exponent_milli) and the digests of all runs and of the collapsed text."""
    best = found.withColumn("best", F.expr("if(size(runs) = 0, null, aggregate(runs, runs[0], (a, r) -> if(r.length * a.period > a.length * r.period, r, a)))"))
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return best.selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "best.start as start", "best.length as length", "best.period as period", "1000 * best.length div best.period as exponent_milli",
        f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256",
    )
