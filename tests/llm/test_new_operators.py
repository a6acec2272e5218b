"""Hard negatives, license scans and periodic runs against brute force, on small and awkward tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kenmap.llm import hard_negatives, licenses, periodic, queries
from tests.llm.test_llm import awkward, table

# periodic runs


def plain_runs(words, least=24, power=3):
    """All maximal stretches of each period, smallest periods first."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(rng, letters, longest):
    words = [rng.randrange(letters) for _ in range(rng.randint(0, longest))]
    for _ in range(rng.randint(0, 3)):
        if len(words) > 4:
            a, p = rng.randrange(len(words)), rng.randint(1, 8)
            for i in range(a, min(len(words), a + rng.randint(5, 60))):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least, power", [(2, 2), (6, 3), (8, 2), (24, 3)])
def test_runs_equal_all_maximal_stretches(least, power):
    rng = random.Random(least)
    for _ in range(1500):
        words = repetitive(rng, rng.choice([1, 2, 2, 3, 4]), 70)
        assert periodic.maximal_runs(words, least, power) == plain_runs(words, least, power)


def test_windows_that_repeat_hold_every_run():
    rng = random.Random(3)
    for _ in range(1500):
        words = [b"%d" % x for x in repetitive(rng, rng.choice([2, 30]), 200)]
        assert periodic.runs_of(words) == plain_runs(words)


def test_factors_cover_the_text_and_stand_earlier():
    rng = random.Random(4)
    for _ in range(300):
        words, at = repetitive(rng, 3, 60), 0
        for start, end, earlier in periodic.factors(words):
            assert start == at and (earlier < 0 or (earlier < start and words[earlier : earlier + end - start] == words[start:end]))
            longer = words[start : end + 1] if end < len(words) else None
            if longer and earlier >= 0:
                assert not any(words[i : i + len(longer)] == longer for i in range(start))
            at = end
        assert at == len(words)


def expected_runs(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in repetitive(rng, rng.choice([3, 50]), 150))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (None, "x " * 40), (1003, "É\x85é\x1c " * 30), (1003, "É\x85é\x1c " * 30)]
    table(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected_runs(*r) for r in rows), key=repr)


def test_very_long_periodic_text(spark):
    text = "a b c d e f g " * 40_000
    row = periodic.periodic_runs(table(spark, [(1, text)])).first()
    assert [tuple(r) for r in row.runs] == [(0, 280_000, 7)] and row.collapsed == "a b c d e f g"


# licenses


def plain_places(words, known):
    """Every place of every template, tried one by one."""
    out = set()
    for x in known:
        n, places = len(x.words), []
        for o in range(-n, len(words)):
            count = sum(any(0 <= p < len(words) and words[p] == w for p in range(o + i - x.slack, o + i + x.slack + 1)) for i, w in enumerate(x.words))
            keys = all(any(p >= 0 and tuple(words[p : p + len(k)]) == k for p in range(o - x.slack, o + n + x.slack - len(k) + 1)) for k in x.keys)
            if count >= x.least and keys:
                places.append((o, count))
        if x.base:
            out |= {(x.label, o) for o, _ in places}
        else:
            out |= {(x.label, chain_start) for chain_start in chains(places, n)}
    return out


def chains(places, n):
    chain = []
    for o, count in [*places, (10**9, 0)]:
        if chain and o - chain[-1][0] >= n:
            yield max(0, min(chain, key=lambda c: (-c[1], c[0]))[0])
            chain = []
        chain.append((o, count))


def test_licenses_equal_all_places():
    rng, known = random.Random(6), licenses.templates()
    often = {w: rng.randint(1, 100) for x in known for w in x.words}
    index = licenses.Index(known, often)
    for _ in range(250):
        words = []
        for _ in range(rng.randint(0, 4)):
            passage = list(rng.choice(known).words)
            for _ in range(rng.randint(0, 3)):
                change = rng.random()
                at = rng.randrange(len(passage))
                if change < 0.4:
                    passage[at] = b"other"
                elif change < 0.7 and len(passage) > 1:
                    del passage[at]
                else:
                    passage.insert(at, rng.choice([b"new", b"license", b"the"]))
            words += passage + [rng.choice([b"word", b"license", b"gnu", b"by"]) for _ in range(rng.randint(0, 6))]
        assert {(label, start) for label, start, _, _, _ in index.places(words)} == plain_places(words, known)


def test_license_digest(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "This is licensed under the GNU General Public License, version 3. All rights reserved.", None, "", "Released under the MIT Licence", "Released under the MIT License.", "all RIGHTS\nreserved all rights reserved", "Lizenz Ünder"]
    rows = [*enumerate(texts), (None, "cc by"), (5, "Released under the MIT License.")]
    got = sorted(map(tuple, licenses.digest(licenses.scan(table(spark, rows, clash=True))).collect()), key=repr)
    want = [
        (0, 7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc", 1.0), (1, 14, 2, 6, 11, "gpl,reserved", "gpl,reserved", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
        (4, 5, 0, None, None, "", "", 0.0), (5, 5, 0, None, None, "", "mit", 1.0), (5, 5, 0, None, None, "", "mit", 1.0), (6, 6, 2, 0, 3, "reserved", "reserved", 1.0), (7, 2, 0, None, None, "", "", 0.0), (None, 2, 1, 0, 0, "cc-by", "cc-by", 1.0),
    ]
    assert got == sorted(want, key=repr)


def test_license_counts_cover_all_documents(spark):
    rows = [(i, "gnu gnu license" if i % 2 else "apache GNU") for i in range(40)]
    assert licenses.frequencies(table(spark, rows).repartition(7), frozenset([b"gnu", b"license", b"apache", b"mit"])) == {b"gnu": 40, b"license": 20, b"apache": 20}


def test_long_text_of_license_words(spark):
    row = licenses.digest(licenses.scan(table(spark, [(1, "apache license " * 100_000 + "released under the mit license")]))).first()
    assert row.n_words == 200_005 and "mit" in row.labels


# hard negatives


def plain_negatives(rows, k=5, m=3):
    """As the contract has it, one anchor after the other."""
    clean = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        clean[vec_id] = min(clean.get(vec_id, (label, whole)), (label, whole))
    out = set()
    for a, (label, v) in clean.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, (other, w) in clean.items() if b != a)
        for score, p, _ in [s for s in scored if s[2] == label][:k]:
            window = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:m]
            out |= {(a, p, r + 1, n, -score, -s) for r, (s, n, _) in enumerate(window)}
    return out


def vectors(rng, n, wide=8, labels=3, ties=False):
    near = lambda: float(rng.integers(-2, 3)) / 4 if ties else float(rng.normal()) / 3
    return [(i, int(rng.integers(labels)), [near() for _ in range(wide)]) for i in range(n)]


@pytest.mark.parametrize("ties, labels, wide", [(False, 3, 8), (True, 2, 3), (True, 400, 2), (False, 1, 4)])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, ties, labels, wide):
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", 150)
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rows = vectors(np.random.default_rng(wide), 700, wide, labels, ties)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    rows = [(i, k, [float(np.float32(x)) for x in v]) for i, k, v in rows]
    got = [tuple(r) for r in hard_negatives.mine(hard_negatives.prepared(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_negatives(rows)


def test_hard_negatives_in_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rows = vectors(np.random.default_rng(1), 600, 4, 2, True)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert {tuple(r) for r in hard_negatives.mine(hard_negatives.prepared(df)).collect()} == plain_negatives(rows)


def test_hard_negatives_of_awkward_rows(spark):
    rows = vectors(np.random.default_rng(2), 300, 4, 2, True)
    odd = [(None, 1, [1.0] * 4), (50, 0, [9.0, 0.0, 0.0, 0.0]), (50, 0, [0.25, 0.25, 0.0, 0.0]), (7, None, [1.0] * 4), (8, 1, None), (9, 1, [1.0, float("nan"), 0.0, 0.0]), (10, 1, [float("inf")] * 4), (11, 1, [None, 1.0, 1.0, 1.0]), (12, 1, []), (13, 1, [2.0]), (100, 0, [0.0] * 4), (150, 1, [0.5] * 4), (151, 0, [0.5] * 4)]
    rows = [r for r in rows if r[0] not in {o[0] for o in odd}] + odd + odd[-1:]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"rank": F.lit("x"), "score": F.lit(1), "anchor": F.lit(2), "width": F.lit(3)})
    assert {tuple(r) for r in hard_negatives.mine(hard_negatives.prepared(df)).collect()} == plain_negatives(rows)
    assert hard_negatives.mine(hard_negatives.prepared(df.limit(0))).count() == 0
    large = spark.createDataFrame([(i, i % 2, [1e6 + i, 2.0]) for i in range(120)], "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in hard_negatives.mine(hard_negatives.prepared(large)).collect()} == plain_negatives([tuple(r) for r in large.collect()])


def test_trees_leave_nodes_out(monkeypatch):
    """Bounds hold for every row below a node, and a search enters few leaves where rows are clustered."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(hard_negatives, "LEAF", 32)
    centres = rng.normal(size=(20, 6)) * 2000
    whole = np.rint(centres[rng.integers(20, size=3000)] + rng.normal(size=(3000, 6)) * 20).astype(np.int64)
    tree = hard_negatives.Tree(np.arange(3000), np.zeros(3000, np.int64), whole)
    for a, b, children, centre, radius, _ in tree.nodes:
        assert np.sqrt(((tree.vectors[a:b] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-6
        assert not children or [a, b] == [tree.nodes[children[0]][0], tree.nodes[children[-1]][1]]
    entered = []
    monkeypatch.setattr(hard_negatives.Block, "_leaf", lambda self, t, a, b, rows, best, f=hard_negatives.Block._leaf: (entered.append(b - a), f(self, t, a, b, rows, best)))
    one = hard_negatives.Block(np.array([0]), np.array([0]), whole[:1], np.full((1, 1), -np.inf), np.full((1, 1), np.inf), 5, True)
    best = hard_negatives.Best(1, 1, 5, np.float64)
    one.search(tree, best)
    scores = sorted(((-int(s), i) for i, s in enumerate(whole @ whole[0]) if i), key=lambda s: s)[:5]
    assert [(-int(s), int(i)) for s, i in zip(best.scores[0, 0], best.ids[0, 0])] == scores and sum(entered) < 1500


def test_new_operators_take_awkward_tables(spark):
    df = awkward(spark)
    assert periodic.digest(periodic.periodic_runs(df)).count() == df.count() == licenses.digest(licenses.scan(df)).count()
    assert periodic.digest(periodic.periodic_runs(df.limit(0))).count() == licenses.digest(licenses.scan(df.limit(0))).count() == 0


def test_segments_of_sparse_hits_take_linear_time():
    import time

    from kenmap.llm import toxicity

    began = time.process_time()
    found = toxicity.maximal_segments([(50 * i, 1.0) for i in range(200_000)], -1.0)
    assert len(found) == 200_000 and time.process_time() - began < 20


def test_many_addresses_in_one_text(spark):
    from kenmap.llm import pii

    n = 30_000
    text = "\n".join(f"a{i}@x{i % 3}.org é" for i in range(n))
    row = pii.report(table(spark, [(1, text)])).first()
    assert row.n_email == n
    clean = pii.sanitise(table(spark, [(1, text)])).first().text
    assert clean == "\n".join(["[EMAIL] é"] * n)


def test_wider_classes_are_protected_where_values_are_rare(spark):
    from kenmap.llm import pii

    rng = random.Random(7)
    filler = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(15))
    rows = [(i, f"{filler()} projectname {filler()} u{i}@corp.example.org") if i < 25 else (i, f"{filler()} number {i}") for i in range(800)]
    rows += [(1000 + i, f"{filler()} other u{i}@mail{i}.example.net") for i in range(6)]
    spans = {r.doc_id: r.spans for r in pii.report(table(spark, rows)).collect()}
    for i, text in rows:
        at = text.find("projectname")
        assert (f"term:{at}:{at + 11}" in spans[i]) == (at >= 0), i  # the domain's 25 texts give the project away
        assert spans[i].count("term") <= (at >= 0)  # and nothing else
    held = pii._shared_entities(pii._found(table(spark, rows)))
    assert {(r.rung, r.entity, r.n_entity) for r in held.collect()} == {(1, "email~corp.example.org", 25), (2, "email", 31)}
