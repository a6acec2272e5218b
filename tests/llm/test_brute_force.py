"""Operators that SQL can't express, against plain Python written from their definitions."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kenmap.llm import binary_output, bpe, imatch, jaccard, packing, pii, sharding, toxicity

WORD = public_tokenizers.path("word_bpe_49k.json")


def spark_hash(*values):
    """Spark's xxhash64: texts, whole numbers (long unless given as ('i', n)) and lists of them, each seeding the next."""
    seed = 42
    for v in values:
        if isinstance(v, list):
            for x in v:
                seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
        else:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def prose(rng, words, vocabulary):
    return " ".join(f"w{min(int(rng.expovariate(0.02)), vocabulary)}" for _ in range(words))


def codes(terms, band):
    low = 2**56 - 1
    subsets = defaultdict(list)
    for h in terms & band:
        r = spark_hash(h, ("i", 7))
        y = (r & 16383) | 16384
        level = (y & -y).bit_length() - 1
        number = level * 8 + ((r >> 20) & 7)
        subsets[number].append(number << 56 | (h & low))
    out = []
    for number in sorted(subsets):
        own = 0
        for code in sorted(subsets[number]):
            own = spark_hash(own, code)
        out.append(number << 56 | (own & low))
    return out + ([120 << 56 | (spark_hash(sorted(terms)) & low)] if terms else [])


def likeness(f, g):
    if f == g:
        return 1.0
    one, two = ([c for c in x if c >> 56 < 120] for x in (f, g))
    both, numbers = set(one) & set(two), {c >> 56 for c in one + two}
    best = 0.0
    for level in range(0, 13, 2):
        n = sum(x >> 3 >= level for x in numbers)
        if n and n >= min(6, len(numbers)):
            best = max(best, sum(c >> 59 >= level for c in both) / n)
    return best


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(0, 150), 400) for _ in range(150)]
    texts[7] = texts[6]
    texts[9] = texts[8][:-20] + " Tail, Ünd END"
    ids = sorted(rng.sample(range(10_000), len(texts)))
    terms = lambda t: {spark_hash(x) for x in re.split(r"[^\w]+|_", t.lower()) if x}
    counts = Counter(h for t in texts for h in terms(t))
    low, high = max(2, 0.0001 * len(texts)), max(0.01 * len(texts), 3)
    band = {h for h, n in counts.items() if low <= n <= high}
    rows = {r["doc_id"]: r for r in imatch.fingerprints(docs_of(spark, list(zip(ids, texts)))).collect()}
    string = lambda cs: "-".join(f"{c:x}" for c in cs)
    for i, text in enumerate(texts):
        k, after = len(text) // 4, texts[(i + 1) % len(texts)]
        own, edited, following = (codes(terms(t), band) for t in (text, text[: len(text) - k] + after[:k], after))
        r = rows[ids[i]]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (string(own), string(edited))
        assert r["near_edited"] == pytest.approx(likeness(own, edited)) and r["near_next"] == pytest.approx(likeness(own, following))


def plain_terms(rows, stems=range(4, 9)):
    """(text, label) rows: the terms and scores that the definition gives."""
    marks = toxicity.MARKS
    keys = [(y, min((int(s) for s in jaccard.shingles(t)), default=0) >> 1) for t, y in rows]
    weight = Counter(keys)
    n, size, docs, tokens, squares = Counter(), Counter(), Counter(), Counter(), Counter()
    for (text, y), key in zip(rows, keys):
        w, seen = 1 / weight[key], Counter()
        for x in text.lower().split():
            x = x.strip(marks)
            size[y] += w
            for t in [x, *(x[:k] + "*" for k in stems if len(x) >= k)] if x else []:
                seen[t] += 1
        n[y] += w
        for t, c in seen.items():
            docs[t, y] += w
            tokens[t, y] += w * c
            squares[t, y] += (w * c) ** 2
    tried = {t for t, y in docs if docs[t, 1] >= 3 - 1e-6}
    out = {}
    for t in tried:
        y1, y0 = tokens[t, 1], tokens[t, 0]
        odds = math.log((y1 + 0.5) / (size[1] + 1 - y1)) - math.log((y0 + 0.5) / (size[0] + 1 - y0))
        error = math.sqrt((squares[t, 1] + 0.5) / (y1 + 0.5) ** 2 + (squares[t, 0] + 0.5) / (y0 + 0.5) ** 2)
        share = (y1 + y0) / (size[1] + size[0])
        ratio = 2 * (y1 * math.log(y1 / size[1] / share) + (y0 * math.log(y0 / size[0] / share) if y0 else 0)) / max(1, (squares[t, 1] + squares[t, 0]) / (y1 + y0))
        if ratio >= 2 * math.log(max(2, len(tried))) and odds - 1.96 * error >= 1:
            out[t] = odds - 1.96 * error
    return out


def split_best(scores, lo, hi):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    best = max(((round(sum(scores[i:j]), 9), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
    if not best or best[0] <= 0:
        return []
    return [*split_best(scores, lo, best[3]), best[0], *split_best(scores, best[4], hi)]


def test_toxic_terms_and_scores_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        words = prose(rng, 40, 300).split()
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["Grob!", "übel", "schlimm" + rng.choice("abcdefgh") + str(rng.randint(0, 999))])
        rows.append((i, " ".join(words)))
    rows += [(600 + i, rows[4][1]) for i in range(30)]  # copies of one toxic text weigh as one
    labels = [(i, int(i % 4 == 0 if i < 600 else 1)) for i, _ in rows]
    model = toxicity.train(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = [(t, y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 3 != 1]
    want = plain_terms(known)
    assert model.terms.keys() == want.keys() and "schlimm*" in want and all(model.terms[t] == pytest.approx(want[t]) for t in want)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, rows), model).collect()}
    for i, text in rows[::7]:
        tokens = text.lower().split()
        scores = [max((model.terms[t] for t in toxicity.fitting(x.strip(toxicity.MARKS)) if t in model.terms), default=model.other) for x in tokens]
        rare, evidence = math.log(model.size * len(tokens)), []
        for r, _ in enumerate(found := sorted(split_best(scores, 0, len(scores)), reverse=True), 1):
            total = sum(model.rate * s - rare for s in found[:r])
            if r == 1 or total > r:
                evidence.append(total if r == 1 else total - (r - 1) * math.log(2 * total) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
        x = model.slope * min(60, max(evidence, default=-rare)) + model.bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-x)), rel=1e-6)


def test_disclosing_terms_equal_brute_force(spark):
    rng = random.Random(9)
    names = [f"name{chr(97 + i)}" for i in range(8)]
    mails = [f"m{i}@x.org" for i in range(8)]
    rows = []
    for i in range(300):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + rng.choice("abcdefgh") for _ in range(12)]
        if i % 6 == 0:
            k = rng.randrange(8)
            words[rng.randrange(12)], words[0] = mails[k], names[k] if rng.random() < 0.95 else names[(k + 1) % 8]
        rows.append((i, " ".join(words) + f" {i}"))
    words = lambda t: {x.lower() for x in re.findall(r"[^\W\d_]{3,}", t)}
    inside = lambda t: {x.lower() for m in [re.sub(r"\S+@\S+", " | ", t)] for x in re.findall(r"[^\W\d_]{3,}", m)}
    entity = {i: m[0] for i, t in rows if (m := re.search(r"m\d@x\.org", t))}
    total, n_entity, n_term, both = len(rows), Counter(entity.values()), Counter(w for _, t in rows for w in words(t)), Counter()
    for i, t in rows:
        if i in entity:
            both.update((entity[i], w) for w in inside(t))
    given = {(e, w) for (e, w), n in both.items() if n >= 3 and n_entity[e] >= 3 and math.log(total * n / (max(n, n_term[w]) * n_entity[e])) >= 0.9 * math.log(total / n_entity[e])}
    assert given
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs_of(spark, rows)).collect()}
    for i, t in rows:
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", t) if i in entity and (entity[i], m[0].lower()) in given and not re.search(r"\S*@\S*", t).start() <= m.start() < re.search(r"\S*@\S*", t).end()]
        assert [s for s in spans[i].split(",") if s.startswith("term")] == want


def test_shards_equal_brute_force_and_are_written_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(-50, 10**6), prose(rng, rng.randint(0, 60), 90)) for _ in range(3000)] + [(i, "hot") for i in range(900)] + [(None, None)]
    df = docs_of(spark, rows).withColumns({"shard": F.lit("own"), "h": F.lit(1), "id": F.lit(2)})
    got = sharding.shard(df, shards=7).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    keys = {(i, zlib.crc32((t or "").encode())): (spark_hash(t or "") & 2**63 - 1, -(2**62) if i is None else i) for i, t in rows}
    order = sorted((keys[r["doc_id"], r["text_crc32"]], r["shard"]) for r in got)
    assert [s for _, s in order] == sorted(s for _, s in order)  # shards are ranges of (hash, id)
    total, below = sum(size(t) for _, t in rows), 0
    for s in range(6):
        below += sum(r["size"] for r in got if r["shard"] == s)
        assert abs(below - total * (s + 1) / 7) <= 0.001 * total / 7 + max(size(t) for _, t in rows)
    sharding.write_shards(df, str(tmp_path / "out"), shards=7)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == ["doc_id", "h", "id", "shard", "text"]
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
    assert {(r["shard"], r["count"]) for r in back.groupBy("shard").count().collect()} == set(Counter(r["shard"] for r in got).items())


def test_every_piece_goes_where_the_squares_become_smallest():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 80))), reverse=True)
        gaps, want = [], []
        for n in lengths:
            squares = lambda i: sum(c * c for g, c in Counter([*gaps[:i], gaps[i] - n, *gaps[i + 1 :]]).items() if g)
            fits = [i for i, g in enumerate(gaps) if g >= n]
            at = min(fits, key=lambda i: (squares(i), gaps[i]), default=None)
            want.append(gaps[at] if at is not None else 40)
            if at is None:
                gaps.append(40 - n)
            else:
                gaps[at] -= n
        _, offset = packing.pack_group(np.array(lengths), 40)
        assert [40 - o for o in offset.tolist()] == want


def test_ids_and_matrices_survive_a_table(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 80), 5000)) for i in range(300)] + [(300, None), (301, "é😀 mixed Case's 12")]
    library = Tokenizer.from_file(WORD)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    ids = bpe.bpe_encode(docs_of(spark, rows), WORD)
    assert {r["doc_id"]: list(r["ids"]) for r in ids.collect()} == want
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(ids, WORD).collect()}
    assert back == {i: library.decode(x, skip_special_tokens=False) for i, x in want.items()}
    binary_output.write_packed(docs_of(spark, rows).repartition(3), str(tmp_path / "m"), WORD, 128)
    found = defaultdict(dict)
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        row = struct.unpack("<128H", r["input_ids"])
        assert sum(row[r["n_tokens"] :]) == 0
        for doc, start, lo, hi in zip(r["doc_ids"], r["starts"], r["cu_lengths"], r["cu_lengths"][1:]):
            found[doc][start] = list(row[lo:hi])
    assert {d: [x for k in sorted(p) for x in p[k]] for d, p in found.items()} == {i: [*x, 0] for i, x in want.items()}
