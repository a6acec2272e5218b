"""Personal data by patterns and by information-theoretic sanitisation, with DataFrame functions only.

Patterns give the protected entities: e-mail and IP addresses, card and phone numbers, with code-point
places.  Places come from the text's parts between matches, so no position function is needed.  The
expressions are possessive and begin only where a run of their characters begins, which changes no match and
keeps them linear on very long runs.

Sanitisation then looks for terms (words of three letters or more outside the spans, whose ends also end words) that
give an entity away.  Over all documents it counts entities, terms, and terms that stand in the text of an entity.  The
information content of an entity c is IC = ln(N / df(c)); a term t discloses ln(N df(t, c) / (df(t) df(c))) of
it, the pointwise mutual information.  Where that reaches the share ``ALPHA`` of IC, and at least ``SUPPORT[0]``
different texts hold both, t is disclosing, and each of its occurrences in a text that holds c is a span of kind
``term``.  What is protected is the value itself where ``SUPPORT[0]`` different texts hold it; else its domain or
number prefix where ``SUPPORT[1]`` do; else its kind where ``SUPPORT[2]`` do.  For these wider classes df(t, c) / df(t) is
taken at the lower end of its Wilson interval (``SURE`` standard errors), since chance would pass rare words otherwise.
Document frequencies are counted by the term itself, before they are shuffled.

Places of matches, and the text between spans, come from running sums in blocks of the square root of their number, so a text
of n matches takes n times that root in small steps and copies nothing twice; texts are cut as bytes.

Sanitised texts hold the kind in brackets where a span was: entities are generalised to their kind, terms to
``[TERM]``.

Defined results: a null or empty text has no spans and stays as it is; spans of different kinds may overlap
and are replaced together, under the kind that begins first; equal rows get equal results; a row without doc_id is
treated like any other; an empty table gives an empty result; ``sanitise`` keeps extra columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.shared import keep
from kenmap.llm.sqltext import let

ALPHA = 0.9
#: Different texts that make a value, a domain or number prefix, and a kind an entity to be protected.
SUPPORT = (3, 10, 30)
SURE = 1.96
WORD = r"\p{L}{3,}"


def _lit(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: kind: (cheap test, expression, test of a match m)
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = let("d", _DIGITS, "aggregate(sequence(0, length(d) - 1), 0, (a, i) -> a + " + let("x", "cast(substring(d, length(d) - i, 1) as int)", "if(i % 2 = 0, x, if(x > 4, 2 * x - 9, 2 * x))") + ") % 10 = 0")
KINDS = {
    "email": ("contains(text, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": ("text rlike '[0-9]'", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "forall(split(m, '[.]'), p -> coalesce(try_cast(ltrim('0', p) as int), if(ltrim('0', p) = '', 0, 256)) <= 255)"),
    "card": ("text rlike '[0-9]'", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", _LUHN),
    "phone": ("contains(text, '+')", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15"),
}
_SPANS = "array<struct<kind:string,start:int,stop:int,value:string,first:int>>"


def _before(values: str, zero: str, fold: str, body: str) -> str:
    """``body`` for an array with a function before(i): ``fold`` (of a and x) over the elements of ``values`` before place i."""
    block = "aggregate(slice(vs, cast(j * k as int) + 1, k), {0}, (a, x) -> {1})".format(zero, fold)
    ahead = "aggregate(slice(bs, 1, cast(j as int)), {0}, (a, x) -> {1})".format(zero, fold)
    inside = "aggregate(slice(vs, cast(floor(({i}) / k) as int) * k + 1, cast(({i}) % k as int)), os[cast(floor(({i}) / k) as int)], (a, x) -> {fold})"
    steps = "sequence(0, cast(floor(size(vs) / k) as int))"
    out = body.replace("before(i)", inside.format(i="i", fold=fold)).replace("before(n)", inside.format(i="size(vs)", fold=fold))
    return let("vs", values, let("k", "cast(ceil(sqrt(size(vs) + 1)) as int)", let("bs", f"transform({steps}, j -> {block})", let("os", f"transform({steps}, j -> {ahead})", out))))


def placed(text: str, regex: str) -> str:
    """Matches of ``regex`` in ``text`` with their places in code points and in bytes: array of (m, at, first)."""
    # one long number holds both lengths of a match and of what stands before it
    lengths = "transform(ms, (m, i) -> shiftleft(cast(length(parts[i]) + length(m) as bigint), 32) + octet_length(parts[i]) + octet_length(m))"
    at = let("z", "before(i)", "struct(m as m, cast(shiftright(z, 32) as int) + length(parts[i]) as at, cast(z & 4294967295L as int) + octet_length(parts[i]) as first)")
    none = "cast(array() as array<struct<m:string,at:int,first:int>>)"
    found = _before(lengths, "0L", "a + x", f"transform(ms, (m, i) -> {at})")
    return let("ms", f"regexp_extract_all({text}, {_lit(regex)}, 0)", f"if(size(ms) = 0, {none}, {let('parts', f'split({text}, {_lit(regex)}, -1)', found)})")


def replaced(text: str, spans: str, mark: str, rest: str) -> str:
    """``text`` with ``mark`` (of a span s) where a span begins outside all before it, and ``rest`` (of s and the end z of those) where it only reaches beyond them."""
    ends = "transform(ss, s -> s.first + octet_length(s.value))"
    piece = let("z", "before(i)", f"if(s.first >= z, concat(cast(substring(raw, z + 1, s.first - z) as string), {mark}), if(s.first + octet_length(s.value) > z, {rest}, ''))")
    whole = f"concat(array_join(transform(ss, (s, i) -> {piece}), ''), cast(substring(raw, before(n) + 1) as string))"
    order = f"array_sort(transform({spans}, s -> struct(s.first as first, s.stop as stop, s.kind as kind, s.value as value)))"
    return let("raw", f"cast({text} as binary)", let("ss", order, _before(ends, "0", "greatest(a, x)", whole)))


def _kind(kind: str) -> str:
    test, regex, valid = KINDS[kind]
    return f"if({test}, transform(filter({placed('text', regex)}, s -> {let('m', 's.m', valid)}), s -> struct('{kind}' as kind, s.at as start, s.at + length(s.m) as stop, s.m as value, s.first as first)), cast(array() as {_SPANS}))"


def base_spans(df: DataFrame) -> DataFrame:
    """``df`` (with a column text that is never null) and ``__base``: its spans by kind as listed in ``KINDS``, then start."""
    return df.withColumn("__base", F.expr("concat(" + ", ".join(map(_kind, KINDS)) + ")"))


def _terms(text: str) -> str:
    """The words of a text outside the spans ``base`` with their places: array of (m, at, first)."""
    blank = "repeat(' ', octet_length(s.value))"  # values are ASCII
    return let("bare", replaced(text, "base", blank, "repeat(' ', s.first + octet_length(s.value) - z)"), placed("bare", WORD))


def _found(df: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), base, text (null where base is empty); written once."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return keep(base_spans(docs).select("doc_id", F.expr("xxhash64(text) as h"), F.col("__base").alias("base"), F.expr("if(size(__base) = 0, null, text) as text")))


#: kind: the class of a value v that is wider than the value itself.
_WIDER = {"email": "substring_index(v, '@', -1)", "ip": "regexp_extract(v, '^[0-9]+[.][0-9]+', 0)", "card": "substring(regexp_replace(v, '[^0-9]', ''), 1, 6)", "phone": "substring(regexp_replace(v, '[^0-9]', ''), 1, 4)"}


def _shared_entities(found: DataFrame, support: tuple[int, int, int] = SUPPORT) -> DataFrame:
    """h, entity, rung (0: value, 1: wider class, 2: kind), n_entity: for each value in a text the narrowest of its classes that enough different texts hold."""
    wider = "case s.kind " + " ".join(f"when '{k}' then {let('v', 'lower(s.value)', x)}" for k, x in _WIDER.items()) + " end"
    names = "array(struct(0 as rung, concat(s.kind, '=', lower(s.value)) as entity), struct(1 as rung, concat(s.kind, '~', {0}) as entity), struct(2 as rung, s.kind as entity))".format(wider)
    held = found.where("size(base) > 0").select("h", F.explode("base").alias("s")).select("h", F.expr("concat(s.kind, '=', lower(s.value)) as value"), F.explode(F.expr(names)).alias("c")).select("h", "value", "c.rung", "c.entity").distinct()
    held = keep(held)
    enough = " or ".join(f"rung = {r} and n_entity >= {n}" for r, n in enumerate(support))
    often = keep(held.select("h", "rung", "entity").distinct().groupBy("rung", "entity").agg(F.count("*").alias("n_entity")).where(enough))
    # kinds have most texts and are at most as many as ``KINDS``
    classes = held.where("rung < 2").join(often.where("rung < 2"), ["rung", "entity"]).unionByName(held.where("rung = 2").join(F.broadcast(often.where("rung = 2")), ["rung", "entity"]))
    lowest = classes.groupBy("h", "value").agg(F.min(F.struct("rung", "entity", "n_entity")).alias("c"))
    return keep(lowest.select("h", "c.rung", "c.entity", "c.n_entity").distinct())


def disclosing(df: DataFrame, found: DataFrame, held: DataFrame, alpha: float = ALPHA, support: int = SUPPORT[0]) -> DataFrame:
    """entity, term of the pairs in which the term gives the entity away; ``held`` is of ``_shared_entities``."""
    texts = found.where("size(base) > 0").join(held.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    terms = texts.select("h", F.explode(F.expr(f"array_distinct(transform({_terms('text')}, w -> lower(w.m)))")).alias("term"))
    often = keep(held.join(terms, "h").groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("n_entity").alias("n_entity"), F.first("rung").alias("rung")).where(f"both >= {support}"))
    if often.isEmpty():
        return often.select("entity", "term")
    total = max(2, found.count())
    words = f"array_distinct(transform(regexp_extract_all(coalesce(text, ''), {_lit(WORD)}, 0), w -> lower(w)))"
    counted = df.select(F.explode(F.expr(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(f"n_term >= {support}")
    z = SURE * SURE
    pairs = often.join(counted, "term").where(f"n_entity < {total}").withColumn("n", F.expr("greatest(both, n_term)")).withColumn("p", F.expr("both / n"))
    pairs = pairs.withColumn("share", F.expr(f"if(rung = 0, p, (p + {z / 2} / n - {SURE} * sqrt(p * (1 - p) / n + {z / 4} / (n * n))) / (1 + {z} / n))"))
    return pairs.where(f"ln({total} * share / n_entity) >= {alpha} * ln({total} / n_entity)").select("entity", "term")


def _term_spans(df: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, h, terms: spans of kind term of the documents that have any."""
    held = _shared_entities(found)
    if held.isEmpty():
        return found.where("false").select("doc_id", "h", F.expr(f"cast(array() as {_SPANS}) as terms"))
    given = keep(held.join(disclosing(df, found, held), "entity").select("h", "term").distinct())
    texts = found.where("size(base) > 0").join(given.select("h").distinct(), "h", "left_semi").dropDuplicates(["doc_id", "h"])
    words = texts.select("doc_id", "h", F.explode(F.expr(_terms("text"))).alias("w")).selectExpr("doc_id", "h", "lower(w.m) as term", "w.at as start", "w.at + length(w.m) as stop", "w.m as value", "w.first as first")
    spans = words.join(given, ["h", "term"]).select("doc_id", "h", F.expr("struct('term' as kind, start, stop, value, first) as span"))
    return spans.groupBy("doc_id", "h").agg(F.expr("array_sort(collect_list(span)) as terms"))


def _joined(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` (doc_id, h, ...) with the term spans of the same text of the same document."""
    right = terms.withColumnsRenamed({"doc_id": "__d", "h": "__h"})
    return rows.join(right, F.expr("h = __h and doc_id <=> __d"), "left").drop("__d", "__h").withColumn("terms", F.expr(f"coalesce(terms, cast(array() as {_SPANS}))"))


def _string(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``df``."""
    found = _found(df)
    rows = _joined(found.select("doc_id", "h", "base"), _term_spans(df, found))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.expr(f"sha2({_string('base')}, 256) as base_sha256"), F.expr(f"{_string('concat(base, terms)')} as spans"))


def sanitise(df: DataFrame) -> DataFrame:
    """The rows and columns of ``df``, spans of ``text`` replaced by their kind in brackets (and ``n_chars`` set to the new length, where there is one)."""
    found = _found(df)
    terms = _term_spans(df, found)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(text, '') as text"))
    rows = base_spans(_joined(rows.withColumn("h", F.expr("xxhash64(text)")), terms))
    clean = replaced("row.text", "concat(__base, terms)", "'[' || upper(s.kind) || ']'", "''")
    rows = rows.withColumn("__clean", F.expr(f"if(size(__base) + size(terms) = 0, row.text, {clean})"))
    changed = {"text": F.col("__clean")} | ({"n_chars": F.length("__clean").cast(df.schema["n_chars"].dataType)} if "n_chars" in df.columns else {})
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in df.columns])
