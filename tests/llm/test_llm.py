"""Each operator against brute force, the libraries, or exact round trips, on small and awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kenmap.llm import binary_output, bpe, imatch, jaccard, packing, pii, quality, sharding, token_count, toxicity
from kenmap.llm.token_ids import TokenIds

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "th", "er", "ing", " ", "  ", "\n", " \n", "\t", "'s", "'LL", "1", "23", ".", "!!", "é", "Ü", "ß", "Σ", "ς", "İ", "漢字", "👍", "́", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", "͸", "x" * 50, "aaaa", "---"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["a" * k for k in range(1, 60)]


AWKWARD = [None, "", " \n\t ", "one", "a b c d", "The same text here, twice. " * 3, "The same text here, twice. " * 3, "x" * 100_000, "word " * 30_000, "É😀 ünïcode"]
#: Columns that operators use themselves.
CLASHES = ("n", "h", "part", "shard", "kept", "band", "row", "terms", "one", "score")


def table(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(1) for c in CLASHES}) if clash else df


def awkward(spark):
    return table(spark, [*enumerate(AWKWARD), (None, "no id"), (5, "The same text here, twice. " * 3)], clash=True)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_equals_the_library(path):
    own, library = bpe.BpeCodec(path), Tokenizer.from_file(path)
    counter = token_count.TokenCounter(own)
    texts = fuzz(1500)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == want.ids
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
        assert counter.count(text) == len(want.ids)


def test_bpe_equals_the_merge_procedure():
    tables = bpe.BpeTables(BYTE)
    rng = random.Random(5)
    for _ in range(1500):
        form = "".join(rng.choice("aehinst") for _ in range(rng.randint(1, 25)))
        assert list(tables.encode_form(form)) == tables.merged(form)


def test_token_ids_equal_the_library():
    own, texts = TokenIds(WORD), fuzz(1500, 2)
    words = ["word", "Word", "WÖRD", "É", "Ärger", "id9", "PhD", "x" * 70, "don't", "İx", "I", "<|endoftext|>", "<|ENDOFTEXT|>", "a×b", "ß"]
    rng = random.Random(3)
    texts += [" ".join(rng.choice(words) + "".join(rng.choice(".,!?;:#$%&*|'-)") for _ in range(rng.randint(0, 3))) for _ in range(20)) for _ in range(300)] + ["word" + "." * 80, "W" * 90 + "!"]
    assert own.derives
    for raw, want in zip(own.raw([t.encode() for t in texts]), own.library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(raw, np.uint32).tolist() == want.ids


def test_bpe_tables(spark):
    rows = bpe.bpe_round_trip(awkward(spark), WORD).collect()
    library = Tokenizer.from_file(WORD)
    assert len(rows) == len(AWKWARD) + 2
    for r in rows:
        text = "no id" if r["doc_id"] is None else AWKWARD[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    ids = bpe.bpe_encode(awkward(spark).where("doc_id = 9"), WORD)
    assert bpe.bpe_decode(ids, WORD).first()["text"] == library.decode(library.encode(AWKWARD[9], add_special_tokens=False).ids, skip_special_tokens=False)


def test_token_counts(spark):
    rows = {r["doc_id"]: r for r in token_count.token_counts(awkward(spark), BYTE).collect()}
    assert (rows[0]["n_bytes"], rows[0]["n_tokens"], rows[8]["over_limit"], rows[3]["over_limit"]) == (0, 0, True, False)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(7)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 140))] for _ in range(25)]
    texts = list(AWKWARD)
    for words in base:
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 99))
            texts.append(" ".join(own))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(table(spark, list(enumerate(texts)), clash=True)).collect()}
    assert {i: (len(sets[i]), find(i)) for i in range(len(texts))} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}


def test_different_texts_with_one_long_passage_do_not_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    passage = " ".join(f"shared{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"own{i // 2}x{k}" for k in range(30)) + (" tail" if i % 2 else "")) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(table(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_jaccard_keeps_rows_without_id_and_empty_tables(spark):
    rows = jaccard.jaccard_join(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD) + 2 and [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert jaccard.jaccard_join(table(spark, [])).count() == 0


def test_jaccard_links_each_text_of_a_repeated_id(spark):
    words = lambda tag: [f"{tag}{i}" for i in range(60)]
    near = lambda tag: " ".join([*words(tag)[:-1], "changed"])
    rows = [(1, " ".join(words("a"))), (1, " ".join(words("b"))), (2, near("b")), (3, near("a")), (4, " ".join(words("c")))]
    got = {tuple(r) for r in jaccard.jaccard_join(table(spark, rows)).collect()}
    assert got == {(1, 56, 1), (2, 56, 1), (3, 56, 1), (4, 56, 4)}
    pairs = spark.createDataFrame([(1, i) for i in range(2, 10)], "a long, b long")
    docs = table(spark, rows[:2] + [(i, near("ab"[i % 2])) for i in range(2, 10)]).coalesce(1)
    assert {tuple(r) for r in jaccard._verified(pairs.coalesce(1), docs).collect()} == {(1, i) for i in range(2, 10)}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 8 + 1).astype(np.uint64)]))
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        size = min(len(x), len(y))
        apart = np.unpackbits(jaccard.fold(x, size) ^ jaccard.fold(y, size)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_toxicity_learns_scores_and_filters(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst")
    rows, labels = [], []
    for i in range(400):
        words, bad = [word() for _ in range(60)], i % 4 == 0
        if bad:
            for k in range(3):
                words[rng.randrange(60)] = ("scum!", "Idiot")[k % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = table(spark, rows, clash=True), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert {"scum", "idiot"} <= model.terms.keys()
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(scored[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(400))
    assert all(scored[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert {r["doc_id"] for r in toxicity.passages(docs, model).collect()} >= {i for i in range(0, 400, 4)}
    assert toxicity.without_toxic(docs, model).count() == 300
    assert toxicity.score(awkward(spark), model).where("score is null").count() == 0
    assert toxicity.score(docs, toxicity.train(docs, marks.where("toxic = 0"))).agg(F.max("score")).first()[0] < 1e-9


def test_toxicity_learns_stems_of_rare_word_forms(spark):
    rng = random.Random(5)
    end = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(i, " ".join([*("word" + rng.choice("abcdefgh") for _ in range(60)), *(("bomente" if i % 4 == 0 else "") + end() for _ in range(3))])) for i in range(400)]
    docs, labels = table(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "bomente*" in model.terms
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in toxicity.score(docs, model).collect())


def test_maximal_segments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-1.0, -1.0, -1.0, 2.0, 3.5]) for _ in range(rng.randint(1, 25))]
        found = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], -1.0)
        want = []

        def split(lo, hi):  # the definition: best segment (shortest, leftmost), then left and right of it
            best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            if best and best[0] > 0:
                split(lo, best[3])
                want.append((best[3], best[4], best[0]))
                split(best[4], hi)

        split(0, len(scores))
        assert max((f[2] for f in found), default=0) == max((w[2] for w in want), default=0)
        assert sum(s > 0 for s in scores) == sum(scores[i] > 0 for a, b, _ in found for i in range(a, b))
        if len({w[2] for w in want}) == len(want):
            assert found == want or sorted(f[2] for f in found)[-1] == sorted(w[2] for w in want)[-1]


def test_quality_equals_brute_force(spark):
    texts = [*AWKWARD, "Home | About | Contact | Login\n" + "A fine sentence of some words. Another one follows it with other terms. And a third closes.", "THIS IS ALL!! VERY LOUD!! TEXT!!\n" * 5, "a b c d e f g a b c d e x y z w", "fine words end here. all is well now.\nfine words end here. all is well now.\n\nLast line."]
    got = {r["doc_id"]: r for r in quality.quality_report(table(spark, list(enumerate(texts)), clash=True)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else set(grams)
        cover = {k + o for k, g in enumerate(grams) if g in seen for o in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover)), i
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>") and r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    kept = {r["doc_id"]: r for r in quality.clean(table(spark, list(enumerate(texts)), clash=True)).collect()}
    assert len(AWKWARD) in kept and "About" not in kept[len(AWKWARD)]["text"] and len(AWKWARD) + 1 not in kept


def test_packing_is_gapless_lossless_and_tight(spark):
    rng = random.Random(4)
    texts = [*AWKWARD, *(" ".join(rng.choice(["alpha", "beta", "of", "the"]) for _ in range(rng.randint(0, 900))) for _ in range(120))]
    library, packed = Tokenizer.from_file(WORD), packing.pack_documents(table(spark, [*enumerate(texts), (None, "no id")], clash=True), WORD).collect()
    whole = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in [*enumerate(texts), (None, "no id")]}
    pieces = {}
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(np.array(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for i, own in pieces.items():
        assert [p[:2] for p in sorted(own)] == [(k, 2048 * k) for k in range(len(own))] and sum(p[2] for p in own) == len(whole[i])
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(places) <= 1 + -(-sum(map(len, whole.values())) // 2048) and pieces.keys() == whole.keys()
    assert packing.pack_documents(table(spark, []), WORD).count() == 0


def test_words_of_letters_are_read_as_one_text_with_the_ids_of_each():
    own, words = TokenIds(WORD), ["plain", "Mixed", "größe", "Ünder", "a", "s", "ß", "x" * 90, "it's", "id9", "ſ", "e\u0301t", "日本", "<|endoftext|>", "\x01"]
    library, slow, plain = own.library, [], []

    class Counting:
        def encode(self, chunks, **kw):
            slow.extend(chunks)
            return library.encode(chunks, **kw)

        def encode_batch_fast(self, texts, **kw):
            plain.extend(texts[0].split(" "))
            return library.encode_batch_fast(texts, **kw)

    own.library = Counting()
    got = [np.frombuffer(raw, "=u4").tolist() for raw in own.raw([w.encode() for w in words])]
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert {"plain", "mixed", "größe", "a", "ß"} <= set(plain) and not set(plain) & set(slow)
    own.closes[:] = False  # closing tokens that are not one a word: all go the other way
    own.forget()
    assert [np.frombuffer(raw, "=u4").tolist() for raw in own.raw([w.encode() for w in words])] == got


def test_binary_output_rows_hold_every_id(spark):
    docs = table(spark, list(enumerate(AWKWARD)), clash=True)
    library, back = Tokenizer.from_file(WORD), {}
    for r in binary_output.packed_rows(docs, WORD, capacity=256).collect():
        ids, places = (np.frombuffer(r[c], "<u2") for c in ("input_ids", "position_ids"))
        assert len(ids) == 256 and r["cu_lengths"][-1] == r["n_tokens"]
        for doc, start, lo, hi in zip(r["doc_ids"], r["starts"], r["cu_lengths"], r["cu_lengths"][1:]):
            assert places[lo:hi].tolist() == list(range(hi - lo))
            back.setdefault(doc, {})[start] = ids[lo:hi].tolist()
    for i, t in enumerate(AWKWARD):
        assert [x for k in sorted(back[i]) for x in back[i][k]] == [*library.encode(t or "", add_special_tokens=False).ids, 0]


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(6)
    for _ in range(100):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        room, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in room if r >= lengths[i]]
            room.remove(min(fits)) if fits else want.append(1)
            room.append((min(fits) if fits else 50) - lengths[i])
        assert len(binary_output.best_fit_decreasing(lengths, 50)) == len(want)


def test_fingerprints(spark):
    rng = random.Random(8)
    texts = [*AWKWARD, *(" ".join(rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randint(0, 400)) for _ in range(200)) for _ in range(40))]
    rows = {r["doc_id"]: r for r in imatch.fingerprints(table(spark, list(enumerate(texts)), clash=True)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest() and rows[i]["n_chars"] == len(t)
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[5]["fingerprint"] == rows[6]["fingerprint"] and rows[5]["near_next"] == 1.0 and rows[0]["fingerprint"] == ""
    tail = [rows[i] for i in range(len(AWKWARD), len(texts) - 1)]
    assert np.mean([r["near_edited"] for r in tail]) > 10 * np.mean([r["near_next"] for r in tail])
    assert imatch.fingerprints(awkward(spark)).count() == len(AWKWARD) + 2 and imatch.fingerprints(table(spark, [])).count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pii_equals_the_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "b.", "@", "x@y.z", "a@b.c", ".", "1.2.3.4", "255.0.0.1", "300.1.1.1", "1", "22", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "+1 (555) 123-4567", "+", " ", "-", "(", ")", "é", "👍", "_", "001.2.3.4"]
    texts = [*AWKWARD, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800))]
    rows = {r["doc_id"]: r for r in pii.report(table(spark, list(enumerate(texts)), clash=True)).collect()}
    digits = lambda s: re.sub("[^0-9]", "", s)
    for i, t in enumerate(texts):
        found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "")]
        found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t or "") if all(int(p) <= 255 for p in m[0].split("."))]
        found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t or "") if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t or "") if 9 <= len(digits(m[0])) <= 15]
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)
        assert rows[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert rows[i]["spans"].startswith(want) and rows[i]["n_ip"] == sum(k == "ip" for k, _ in found)


def test_disclosing_terms_are_found_and_generalised(spark):
    rows = [(i, f"note {i} by Kowalczyk jk@mail.example.org sent today from place{i % 3}") for i in range(6)] + [(100 + i, f"note with plain words by someone number {i} sent today from here") for i in range(60)]
    docs = table(spark, rows, clash=True)
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert all("term:" in spans[i] for i in range(6)) and not any(spans[100 + i] for i in range(60))
    clean = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert clean[0]["text"].startswith("note 0 by [TERM] [EMAIL] sent") and clean[100]["text"] == rows[6][1] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert pii.sanitise(awkward(spark)).count() == len(AWKWARD) + 2


def test_disclosing_terms_are_counted_one_by_one(spark):
    # Other words whose hashes end in the same 20 bits stand for a table so large that any 20 bits are shared.
    same = spark.range(2**24).selectExpr("concat('zz', lower(translate(hex(id), '0123456789', 'ghijklmnop'))) as w").where(f"(xxhash64(w) ^ xxhash64('kowalczyk')) & {2**20 - 1} = 0")
    rows = [(i, f"note {i} by Kowalczyk jk@mail.example.org sent today") for i in range(6)] + [(100 + i, f"note {i} by {r['w']} sent today") for i, r in enumerate(same.collect())]
    assert len(rows) > 12
    spans = {r["doc_id"]: r["spans"] for r in pii.report(table(spark, rows)).collect()}
    assert all("term:" in spans[i] for i in range(6)) and not any(s for i, s in spans.items() if i >= 100)


def test_disclosing_terms_are_found_anywhere_in_the_text(spark):
    rows = [(i, f"Dear Kowalczyk, in note {i} you find our offer at last. Write to jk@mail.example.org today. Yours, the office of Kowalczyk, no {i}") for i in range(6)]
    rows += [(100 + i, f"Dear reader, in note {i} you find our offer at last. Write today. Yours, the office of plain words") for i in range(60)] + [(200, "kowalczyk elsewhere")]
    docs = table(spark, rows, clash=True)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[3] == "Dear [TERM], in note 3 you find our offer at last. Write to [EMAIL] today. Yours, the office of [TERM], no 3"
    assert clean[105] == rows[11][1] and clean[200] == "kowalczyk elsewhere"


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(9)
    rows = [(i, "hot text" * 20 if i % 3 == 0 else "t" * rng.randint(0, 300)) for i in range(6000)] + [(None, None), (None, None), (7, "again")]
    got = sharding.shard(table(spark, rows, clash=True)).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(size) == 40 and size.max() - size.min() < 0.05 * size.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    assert sharding.shard(table(spark, [])).count() == 0 and sharding.shard(awkward(spark)).count() == len(AWKWARD) + 2
