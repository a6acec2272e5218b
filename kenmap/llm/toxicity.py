"""Toxic passages by maximum-scoring segments.

Model, learnt from a bounded sample of labelled documents (``SAMPLE`` of each label, chosen by a hash of
doc_id).  Copies must not count as independent evidence: of the rows with one label that share their least
shingle hash each weighs one part of their number, so all rows and their labels stay.  A term's score is the
lower confidence bound of its log-odds of *token* shares between toxic and other documents under a Dirichlet
prior (``PRIOR`` pseudo-tokens a term); its error counts a document's tokens together, so one document that
repeats a word does not look like many.  A term is taken where its likelihood ratio, divided by the same
clustering, exceeds ``FAMILY`` times the logarithm of the number of terms that could pass (those of at least
``LEAST`` weighted toxic documents).  Terms are whole words and word beginnings of ``STEMS`` characters (written
with a star), because in languages with many word forms a label shows in a stem whose single forms are rare.
Of several terms that fit a token the largest bound counts.  A token that is no term scores the log-odds of
such tokens, a little below zero.

Scan: a linear pass over a document's token scores finds all maximal scoring segments, each of which no
extension or cut improves (only tokens above zero can start one, so the pass steps from term to term).

Calibration: in other text the largest segment score of n tokens follows an extreme-value law with
P(S >= x) = 1 - exp(-K n exp(-lambda x)); lambda solves the equation of the token scores' moment
generating function, K is fitted to the sample's non-toxic documents.  A segment is significant where that
probability is at most ``SIGNIFICANT``.  All segments of a document are aggregated by the law of sums of the
r best: with T = sum (lambda S_i - ln(K n)) the evidence is the largest, over r, of T - (r-1) ln T + ln r! +
ln (r-1)! - (r-1) ln 2.  A document's score is a logistic function of that evidence, fitted on evidence that
each half of the sample gets from a model learnt on the other half (copies stay in one half).

Defined results: a null or empty text has no segment and gets the score of a text without terms; without
labelled documents of both kinds every score is 0; label rows without a value are not used, of several rows
for one document the larger counts; a row without doc_id is scored like any other, and is not held out;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.bpe import Memo
from kenmap.llm.jaccard import shingles
from kenmap.llm.shared import keep, release, small_batches

SAMPLE = 20_000
PRIOR = 0.5
LEAST = 3
FAMILY = 2.0
#: Lower bounds of log-odds are so many errors below them, and at least ``MIN_ODDS``.
CONFIDENCE, MIN_ODDS = 1.96, 1.0
#: Distinct terms that a task gathers before it hands them on.
GATHERED = 50_000
SIGNIFICANT = 0.01
#: Evidence counts up to here.
TOP = 60.0
THRESHOLD = 0.7
STEMS = range(4, 9)
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "…“”‘’«»¡¿–—"


def fitting(word: str) -> list[str]:
    """The terms that a word (without marks around it, so no word ends in a star) can be."""
    return [word, *(word[:k] + "*" for k in STEMS if k <= len(word))] if word else []


def heads_of(terms: dict[str, float]) -> frozenset[str]:
    """The first letters of all terms, as many as the shortest beginning has: every term that fits a token shares them."""
    return frozenset(t[: STEMS[0]] for t in terms)


def term_of(terms: dict[str, float], heads: frozenset[str], chunk: str) -> str | None:
    """The term of the largest score that fits a token."""
    word = chunk.strip(MARKS)
    if word[: STEMS[0]] not in heads:
        return None
    return max((t for t in fitting(word) if t in terms), key=terms.__getitem__, default=None)


@dataclass
class Model:
    """Terms and their scores, and the calibration; ``other`` is what any other token scores."""

    terms: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    rate: float = 1.0
    size: float = 1.0
    slope: float = 0.0
    bias: float = -60.0

    def __post_init__(self) -> None:
        terms, heads = self.terms, heads_of(self.terms)  # not self: a cycle would outlive the task
        self.heads = heads
        self.memo = Memo(lambda chunk: terms.get(term_of(terms, heads, chunk), 0.0), 30_000)

    def term(self, chunk: str) -> str | None:
        """The term that counts for a token."""
        return term_of(self.terms, self.heads, chunk)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "heads")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal segments: first token, token behind the last, score."""
        scores = list(map(self.memo.__getitem__, (text or "").lower().split()))
        hits = [(i, s) for i, s in enumerate(scores) if s]
        return len(scores), maximal_segments(hits, self.other)

    def evidence(self, tokens: int, scores: list[float]) -> float:
        """Minus the logarithm of how many sets of segments as good as these other text of this length has."""
        rare, best, total = math.log(self.size * max(tokens, 1)), None, 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            total += self.rate * score - rare
            if r == 1:
                best = total
            elif total > r:
                best = max(best, total - (r - 1) * math.log(2 * total) + math.lgamma(r + 1) + math.lgamma(r))
        return -rare if best is None else best

    def chance(self, tokens: int, score: float) -> float:
        return -math.expm1(-math.exp(min(50.0, -self.evidence(tokens, [score]))))

    def probability(self, evidence: float) -> float:
        x = self.slope * min(TOP, evidence) + self.bias
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    def score(self, text: str | None) -> float:
        tokens, found = self.segments(text)
        return self.probability(self.evidence(tokens, [x for *_, x in found]))


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, from the (place, score) of the tokens above zero; each token between them scores ``other`` < 0.

    Candidates are kept with the total before and after them, and the nearest earlier one that begins lower.  A new one is merged with that
    candidate if it also ends lower.  Candidates that a search passes are passed by every later one through that link, and each is merged away at most once, so the scan is linear in the hits.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, link
    total, at = 0.0, 0
    for place, score in hits:
        before = total + other * (place - at)
        total, at = before + score, place + 1
        start, low, j = place, before, len(kept) - 1
        while j >= 0 and kept[j][2] >= low:
            j = kept[j][4]
        while j >= 0 and kept[j][3] < total:
            start, _, low, _, link = kept[j]
            del kept[j:]
            j = link
        kept.append((start, at, low, total, j))
    return [(s, e, after - before) for s, e, before, after, _ in kept]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _sample(labels: DataFrame, per_label: int) -> DataFrame:
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    mixed = known.withColumn("order", F.xxhash64("doc_id"))
    return mixed.where("toxic = 1").orderBy("order", "doc_id").limit(per_label).union(mixed.where("toxic = 0").orderBy("order", "doc_id").limit(per_label)).drop("order")


def _marked(texts: DataFrame) -> DataFrame:
    """The sample: text, toxic, fold (0 or 1), weight; copies share their weight and their fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            least = [int(s[0] >> np.uint64(1)) if len(s) else 0 for s in map(shingles, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], ["text", "toxic", "same"])

    sample = keep(texts.mapInArrow(run, "text string, toxic int, same long"))
    copies = F.broadcast(sample.groupBy("toxic", "same").agg(F.count("*").alias("n")))  # at most 2 x SAMPLE rows of three numbers, but for repeated rows of ``docs``
    return sample.join(copies, ["toxic", "same"]).selectExpr("text", "toxic", "cast(pmod(xxhash64(same), 2) as int) as fold", "1D / n as weight")


def _term_sums(sample: DataFrame) -> DataFrame:
    """term, and by label l and fold f: n{l}{f} weighted documents, y{l}{f} weighted tokens, q{l}{f} squares of a document's weighted tokens.

    The null term stands for all tokens.
    """
    keys = [f"{c}{label}{fold}" for label in (0, 1) for fold in (0, 1) for c in "nyq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[str | None, list[float]] = {}
        forms = Memo(fitting, 10_000)

        def out() -> pa.RecordBatch:
            cols = list(zip(*sums.values())) if sums else [()] * len(keys)
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array(c, pa.float64()) for c in cols)], ["term", *keys])

        for b in batches:
            for text, label, fold, weight in zip(*(c.to_pylist() for c in b.columns)):
                seen: Counter = Counter()
                for word, n in Counter(x.strip(MARKS) for x in text.lower().split()).items():
                    seen[None] += n
                    for term in forms[word]:
                        seen[term] += n
                at = 3 * (2 * label + fold)
                for term, n in seen.items():
                    own = sums.get(term)
                    if own is None:
                        own = sums[term] = [0.0] * len(keys)
                    own[at] += weight
                    own[at + 1] += weight * n
                    own[at + 2] += (weight * n) ** 2
                if len(sums) >= GATHERED:
                    yield out()
                    sums.clear()
        yield out()

    total = sample.select("text", "toxic", "fold", "weight").mapInArrow(run, "term string, " + ", ".join(f"{k} double" for k in keys))
    return total.groupBy("term").agg(*(F.round(F.sum(k), 6).alias(k) for k in keys))


def term_scores(sums: DataFrame, folds: tuple[int, ...]) -> dict[str, float]:
    """The terms that these folds of the sample tell apart, and their scores; as many as the bounded sample proves."""
    added = sums.selectExpr("term", *(" + ".join(f"{c}{label}{f}" for f in folds) + f" as {c}{label}" for label in (0, 1) for c in "nyq"))
    every = added.where("term is null").first()
    if every is None or not every["n1"] or not every["n0"]:
        return {}
    size1, size0 = every["y1"], every["y0"]
    tried = added.where(f"term is not null and n1 >= {LEAST}")
    least = FAMILY * math.log(max(2, tried.count()))
    odds = f"ln((y1 + {PRIOR}) / ({size1 + 1} - y1)) - ln((y0 + {PRIOR}) / ({size0 + 1} - y0))"
    error = f"sqrt((q1 + {PRIOR}) / pow(y1 + {PRIOR}, 2) + (q0 + {PRIOR}) / pow(y0 + {PRIOR}, 2))"
    share = f"((y1 + y0) / {size1 + size0})"
    ratio = f"2 * (y1 * ln(y1 / {size1} / {share}) + if(y0 > 0, y0 * ln(y0 / {size0} / {share}), 0)) / greatest(1, (q1 + q0) / (y1 + y0))"
    bounded = tried.selectExpr("term", f"{odds} - {CONFIDENCE} * {error} as score", f"{ratio} as ratio").where(f"ratio >= {least} and score >= {MIN_ODDS}")
    return dict(sorted((r["term"], r["score"]) for r in bounded.collect()))


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Model:
    """The model from the labelled rows of ``docs`` that are not held out."""
    small_batches(docs.sparkSession)
    chosen = F.broadcast(_sample(labels, per_label))  # at most 2 x per_label pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = _marked(texts)
    sums = keep(_term_sums(sample))
    # The model itself, and one for each half of the sample, learnt on the other half.
    models = [Model(term_scores(sums, folds)) for folds in ((0, 1), (1,), (0,))]
    if not models[0].terms:
        return Model()
    uses: dict[int, dict] = {k: {} for k in range(len(models))}
    for r in _uses(sample, models).collect():  # at most one row a term and model
        uses[r["model"]][r["term"]] = (r["u1"], r["u0"])
    for k, model in enumerate(models):
        all1, all0 = (max(1, sum(u[i] for u in uses[k].values())) for i in (0, 1))
        none1, none0 = uses[k].get(None, (0, 0))
        model.other = min(-0.001, math.log((none1 / all1 + 1e-9) / (none0 / all0 + 1e-9)))
        model.rate = _rate([(s, (uses[k][t][1] + 0.5) / (all0 + 1)) for t, s in model.terms.items() if t in uses[k]], model.other)
    quiet = dict(_quiet(sample, models).collect())
    for k, model in enumerate(models):
        model.size = quiet.get(k) or 1.0
    seen = _evidence(sample, models).collect()  # three numbers a document of the sample
    models[0].slope, models[0].bias = _logistic(*(np.array([float(r[c]) for r in seen]) for c in ("evidence", "toxic", "weight")))
    return models[0]


def _learns(k: int, fold: int) -> bool:
    """Whether model ``k`` (0: the whole sample's, else the model for half k - 1) is learnt from this fold."""
    return k - 1 != fold


def _uses(sample: DataFrame, models: list[Model]) -> DataFrame:
    """model, term (null: none), u1, u0: weighted tokens of toxic and of other documents for which the term counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tokens: dict[tuple, float] = {}
        finders = [Memo(m.term, 15_000) for m in models]
        for b in batches:
            for text, label, fold, weight in zip(*(c.to_pylist() for c in b.columns)):
                words = [x for x in text.lower().split() if x.strip(MARKS)]
                for k, term_of in enumerate(finders):
                    if _learns(k, fold):
                        for t, n in Counter(map(term_of.__getitem__, words)).items():
                            tokens[k, t, label] = tokens.get((k, t, label), 0.0) + weight * n
        terms = sorted({(k, t) for k, t, _ in tokens}, key=lambda x: (x[0], x[1] or ""))
        cols = (pa.array([k for k, _ in terms], pa.int32()), pa.array([t for _, t in terms], pa.string()), *(pa.array([tokens.get((k, t, y), 0.0) for k, t in terms], pa.float64()) for y in (1, 0)))
        yield pa.RecordBatch.from_arrays(list(cols), ["model", "term", "u1", "u0"])

    return sample.select("text", "toxic", "fold", "weight").mapInArrow(run, "model int, term string, u1 double, u0 double").groupBy("model", "term").agg(F.round(F.sum("u1"), 6).alias("u1"), F.round(F.sum("u0"), 6).alias("u0"))


def _quiet(sample: DataFrame, models: list[Model]) -> DataFrame:
    """model, size: the K that the non-toxic documents show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            out = []
            for text, fold, weight in zip(*(c.to_pylist() for c in b.columns)):
                for k, model in enumerate(models):
                    if _learns(k, fold):
                        tokens, found = model.segments(text)
                        out.append((k, weight, weight * max(tokens, 1) * math.exp(-model.rate * max((x for *_, x in found), default=0.0))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.float64()))], ["model", "w", "x"])

    return sample.where("toxic = 0").select("text", "fold", "weight").mapInArrow(run, "model int, w double, x double").groupBy("model").agg(F.expr("round(sum(w) / greatest(1e-9, sum(x)), 12)").alias("size"))


def _evidence(sample: DataFrame, models: list[Model]) -> DataFrame:
    """toxic, weight, evidence of each document of the sample, by the model that has not learnt from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            out = []
            for text, fold in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                tokens, found = models[fold + 1].segments(text)
                out.append(min(TOP, models[fold + 1].evidence(tokens, [x for *_, x in found])))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array(out, pa.float64())], ["toxic", "weight", "evidence"])

    return sample.select("text", "toxic", "fold", "weight").mapInArrow(run, "toxic int, weight double, evidence double")


def _rate(scores: list[tuple[float, float]], other: float) -> float:
    """The positive solution x of the sum of p exp(x s) = 1 over token scores s with their shares p in other text."""
    rest = 1 - sum(p for _, p in scores)
    low, high = 0.0, 1.0
    above = lambda x: sum(p * math.exp(min(600.0, x * s)) for s, p in scores) + rest * math.exp(x * other) > 1
    while not above(high) and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return max(high, 0.01)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and bias by Newton steps with a small ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6]) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            out = pa.array(list(map(model.score, b.column(1).to_pylist())), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), out], ["doc_id", "held_out", "score"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def passages(df: DataFrame, model: Model, significant: float = SIGNIFICANT) -> DataFrame:
    """doc_id, first, behind (token places), score, chance of every significant passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, found = model.segments(text)
                out += [(doc_id, s, e, x, p) for s, e, x in found if (p := model.chance(n, x)) <= significant]
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "first", "behind", "score", "chance"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first long, behind long, score double, chance double")


def without_toxic(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores below ``threshold``."""
    fields = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at = fields.fieldNames().index("text")
        for b in batches:
            yield b.filter(pa.array([model.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, fields)
