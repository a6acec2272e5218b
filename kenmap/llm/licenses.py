"""License scans by a positional index of rare words.

``PHRASES`` are the base: places where a phrase's words stand consecutively.  ``TEMPLATES`` are passages that may be edited a
little: one stands at place o of a text where at least ``SHARE`` of its words stand in place (word i at o + i, give or take
``SLACK`` words), and each of its mandatory key phrases stands consecutively between o - ``SLACK`` and o + its length + ``SLACK``.

* A first pass counts, over all documents, in how many each licence word occurs; only such words are counted, so the result is as small as
  the templates.
* Of each template the index holds the positions of its words of highest inverse document frequency: one more than may be missing,
  so whatever stands somewhere has at least one indexed word in place there (of a phrase: its rarest word).
* A file's rarest licence words are looked up; each occurrence gives, by its relative position in the template, the places where
  the template may stand.  There the words in place are counted and the key phrases verified.  Of places whose passages overlap
  the one with most words in place (then the first) counts.

Defined results: a null or empty text has no words and no places (score 0); labels are distinct and sorted; repeated rows give repeated results; rows
without doc_id are kept; an empty table stays empty; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.shared import small_batches

SHARE = 0.8
SLACK = 3
#: label: phrase. Fixed values.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: (label, passage, mandatory key phrases): the notices of well-known licences. Fixed values.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("artistic", "licensed under the artistic license 2 0", ("artistic license",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("public domain", "cc0")),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
)
#: A-Z become a-z; what is neither 0-9, a-z nor beyond ASCII becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PLACES = "array<struct<label: string, start: bigint, length: bigint, share: double, base: boolean>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    least: int
    slack: int
    base: bool


def templates(phrases: dict[str, str] = PHRASES, passages: tuple = TEMPLATES, share: float = SHARE, slack: int = SLACK) -> list[Template]:
    """Phrases are passages whose every word must stand exactly in place."""
    cut = lambda s: tuple(s.encode().split())
    exact = [Template(label, cut(p), (), len(cut(p)), 0, True) for label, p in phrases.items()]
    return exact + [Template(label, cut(p), tuple(map(cut, keys)), math.ceil(share * len(cut(p))), slack, False) for label, p, keys in passages]


def frequencies(df: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of ``vocabulary`` occurs; at most that many rows leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = df.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}  # as many as the templates have words


class Index:
    """``postings[word]``: (template, position) of each indexed word; the rarest words of a template are those in the fewest documents (ties by word and position)."""

    def __init__(self, known: list[Template], often: dict[bytes, int]) -> None:
        self.templates, self.postings = known, {}
        for t, x in enumerate(known):
            rare = sorted(range(len(x.words)), key=lambda i: (often.get(x.words[i], 0), x.words[i], i))
            for i in rare[: len(x.words) - x.least + 1]:
                self.postings.setdefault(x.words[i], []).append((t, i))

    def places(self, words: list[bytes]) -> list[tuple[str, int, int, float, bool]]:
        """(label, start, length, share of words in place, base) of all passages and phrases in a text, by start."""
        if self.postings.keys().isdisjoint(words):
            return []
        at: dict[bytes, list[int]] = {}
        may: dict[int, list[tuple[int, int]]] = {}
        for p, w in enumerate(words):
            if w in self.postings:
                at.setdefault(w, []).append(p)
        for w in at:
            for t, i in self.postings[w]:
                may.setdefault(t, []).append((i, w))
        out = []
        for t, posted in may.items():
            x = self.templates[t]
            n, s = len(x.words), x.slack
            shifts = np.arange(-s, s + 1)
            starts = np.unique(np.concatenate([(np.array(at[w], np.int64)[:, None] - i + shifts).ravel() for i, w in posted]))
            starts = starts[(starts > -n) & (starts < len(words))]
            share = self._in_place(words, x, starts)
            good = share >= x.least
            found = zip(starts[good].tolist(), share[good].tolist()) if x.base else _best(starts[good], share[good], n)
            for start, count in found:
                out.append((x.label, max(0, start), min(len(words), start + n) - max(0, start), count / n, x.base))
        return sorted(out, key=lambda o: (o[1], o[0], o[2], o[4], o[3]))

    @staticmethod
    def _in_place(words: list[bytes], x: Template, starts: np.ndarray) -> np.ndarray:
        """How many of the template's words stand in place at each of ``starts``; 0 where a key phrase is missing."""
        n, s, low = len(x.words), x.slack, int(starts[0]) - x.slack if len(starts) else 0
        size = (int(starts[-1]) + n + s - low + 1) if len(starts) else 0
        inside = {w: np.zeros(size + 1, bool) for w in (*x.words, *(w for key in x.keys for w in key))}
        for p in range(max(0, low), min(len(words), low + size)):
            if (w := words[p]) in inside:
                inside[w][p - low + 1] = True
        sums = {w: np.cumsum(inside[w], dtype=np.int32) for w in set(x.words)}  # occurrences before a place
        count = np.zeros(len(starts), np.int64)
        for i, w in enumerate(x.words):
            near = starts + i - low
            count += sums[w][np.minimum(near + s + 1, size)] > sums[w][np.maximum(near - s, 0)]
        for key in x.keys:
            k = len(key)
            found = np.ones(max(0, size - k + 1), bool)
            for j, w in enumerate(key):
                found &= inside[w][1 + j : 1 + j + len(found)]
            before = np.append(0, np.cumsum(found, dtype=np.int32))
            first, last = np.clip(starts - s - low, 0, len(found)), np.clip(starts + n + s - k - low + 1, 0, len(found))
            count[before[np.maximum(last, first)] <= before[first]] = 0
        return count


def _best(starts: np.ndarray, count: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Of each chain of overlapping places the one with most words in place, then the first."""
    if len(starts):
        for chain in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) >= n) + 1):
            best = chain[np.argmax(count[chain])]
            yield int(starts[best]), int(count[best])


def scan(df: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, places (label, start, length, share, base): one row for each row of ``df``; only the counts of licence words are shuffled."""
    known = templates() if known is None else known
    small_batches(df.sparkSession, 500)
    index = Index(known, frequencies(df, frozenset(w for x in known for w in x.words)))
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, places = [], []
            for text in b.column(1).cast(pa.binary()):
                words = words_of(text.as_py())
                n.append(len(words))
                places.append([dict(zip(("label", "start", "length", "share", "base"), p)) for p in index.places(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, kind)], ["doc_id", "n_words", "places"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, places {_PLACES}")


def digest(found: DataFrame) -> DataFrame:
    """Of ``scan``: counts and ends of the base places, the labels of base and of all places, and the largest share of words in place as score."""
    base = "filter(places, p -> p.base)"
    labels = "array_join(array_sort(array_distinct(transform({0}, p -> p.label))), ',')"
    return found.selectExpr(
        "doc_id", "n_words", f"cast(size({base}) as bigint) as n_base", f"array_min(transform({base}, p -> p.start)) as first_word", f"array_max(transform({base}, p -> p.start)) as last_word",
        f"{labels.format(base)} as base_labels", f"{labels.format('places')} as labels", "coalesce(array_max(transform(places, p -> p.share)), 0e0) as score",
    )
