"""Line-first cleaning with DataFrame functions only.

Each line that holds a word is judged by itself:

* navigation: two bars or more in it, and a bar for every eight words at least;
* punctuation: three symbols of ``#*$%&|<>`` or more, and more than one for ten words; ten words or more without any sentence
  mark; or three words or more in capitals only;
* boilerplate: it has at most ``SHORT_LINE`` words and holds one of the phrases of ``BOILERPLATE`` as whole words.

Failing lines are removed.  A document is then rejected when the removed lines hold more than half of its
text, or when the base rules fail: fewer than ten words, or more than a fifth of its words in five-word
windows that occur again in the text.

Repeated windows are found by a 64-bit hash of each window inside the document's own row: only documents in
which the number of distinct hashes is below the number of windows sort them.  Nothing is shuffled.

Defined results: a null or empty text has zero counts, fails the base rule and is not kept; lines without a
word (empty lines) are neither judged nor counted; repeated rows give repeated results; extra columns pass
through ``clean`` and are not read by ``quality_report``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.sqltext import WORD_GAP, WS, count_of, let, trimmed, words

SYMBOLS = "#*$%&|<>"
#: Full stops, exclamation and question marks of the scripts that separate words by spaces, and of Chinese and Japanese.
SENTENCE_MARKS = ".!?…。！？।॥؟۔։።"
#: Phrases of page furniture, in lower case: English, German, French, Spanish.
BOILERPLATE = (
    "click here", "read more", "sign in", "log in", "sign up", "subscribe to", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "share this", "skip to content", "back to top", "add to cart",
    "hier klicken", "mehr lesen", "jetzt anmelden", "zum inhalt springen", "nach oben", "in den warenkorb", "cookies akzeptieren", "alle rechte vorbehalten",
    "cliquez ici", "lire la suite", "se connecter", "mentions légales", "politique de confidentialité", "retour en haut", "ajouter au panier", "tous droits réservés",
    "haga clic aquí", "leer más", "iniciar sesión", "aviso legal", "política de privacidad", "volver arriba", "añadir al carrito", "todos los derechos reservados",
)
SHORT_LINE = 12
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MAX_LOST_PERCENT = 50

#: Words in five-word windows that occur twice or more, from the window hashes h: starts of such windows in ascending order, each adding what the one before did not cover.
_REPEATED = let(
    "s",
    "sort_array(transform(h, (x, i) -> struct(x as x, i as i)))",
    "aggregate(sort_array(transform(filter(s, (e, j) -> (j > 0 and s[j - 1].x = e.x) or (j + 1 < size(s) and s[j + 1].x = e.x)), e -> e.i)), "
    "struct(-5 as p, 0 as n), (a, x) -> struct(x as p, a.n + least(5, x - a.p) as n), a -> a.n)",
)
_WINDOWS = "if(size(w) < 5, cast(array() as array<bigint>), transform(sequence(1, size(w) - 4), i -> xxhash64(slice(w, i, 5))))"
#: What a phrase that stands as whole words matches.
_PHRASES = r"(^|[^\\p{L}\\p{N}])(" + "|".join(BOILERPLATE) + r")($|[^\\p{L}\\p{N}])"
_FIRST = [f"contains(k.lo, '{p}')" for p in BOILERPLATE]
#: Live lines, each judged: (line, length, fails).
_JUDGED = (
    "transform(live, l -> "
    + let(
        "k",
        let("tl", trimmed("l"), f"struct(tl as t, lower(tl) as lo, size(split(tl, {WORD_GAP})) as n)"),
        "struct(l as line, length(k.t) as size, "
        + let("bars", count_of("|", "k.t"), "bars >= 2 and bars * 8 >= k.n")
        + " or "
        + let("marks", count_of(SYMBOLS, "k.t"), "marks >= 3 and marks * 10 > k.n")
        + f" or (k.n >= 10 and {count_of(SENTENCE_MARKS, 'k.t')} = 0) or (k.n >= 3 and k.t <> k.lo and k.t = upper(k.t))"
        + f" or (k.n <= {SHORT_LINE} and ({' or '.join(_FIRST)}) and k.lo rlike '{_PHRASES}') as fails)",
    )
    + ")"
)


def _judged(text: str) -> str:
    live = f"filter(split({text}, '\\n'), l -> {trimmed('l')} <> '')"
    return let("live", live, f"struct(size(live) - size(array_distinct(live)) as n_dup_lines, {_JUDGED} as lines)")


def _report(text: str) -> str:
    """One struct of all that the rules need of a text."""
    repeated = let("h", _WINDOWS, f"if(size(array_distinct(h)) = size(h), 0, {_REPEATED})")
    return let("w", words(text), f"struct(size(w) as n_words, {repeated} as n_repeat_words)")


def _judge(df: DataFrame) -> DataFrame:
    """``df`` with the structs __words and __lines; each is an attribute of its own, so nothing is computed twice."""
    return df.withColumns({"__words": F.expr(_report("coalesce(text, '')")), "__lines": F.expr(_judged("coalesce(text, '')"))})


_BASE_FAILED = f"(__words.n_words < {MIN_WORDS} or 100 * __words.n_repeat_words > {MAX_REPEATED_PERCENT} * __words.n_words)"


def _lost(judged: str) -> str:
    """Whether the failing lines hold too much of the text."""
    return f"aggregate({judged}.lines, struct(0L as f, 0L as a), (s, l) -> struct(s.f + if(l.fails, l.size, 0) as f, s.a + l.size as a), s -> 100 * s.f > {MAX_LOST_PERCENT} * s.a)"


def quality_report(df: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of ``df``."""
    text = "coalesce(text, '')"
    return _judge(df.select("doc_id", "text")).select(
        F.col("doc_id"),
        F.expr("cast(__words.n_words as bigint) as n_words"),
        F.expr(f"cast(length(translate({text}, {WS}, '')) as bigint) as word_chars"),
        F.expr(f"cast({count_of(SYMBOLS, text)} as bigint) as n_symbols"),
        F.expr("cast(__lines.n_dup_lines as bigint) as n_dup_lines"),
        F.expr("cast(__words.n_repeat_words as bigint) as n_repeat_words"),
        F.expr(f"{_BASE_FAILED} as base_failed"),
        F.expr(f"not {_BASE_FAILED} and not {_lost('__lines')} as kept"),
    )


def clean(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that the rules keep, all columns, with the failing lines taken out of ``text`` (and ``n_chars`` set to its length, where there is one)."""
    base = f"(v.n_words < {MIN_WORDS} or 100 * v.n_repeat_words > {MAX_REPEATED_PERCENT} * v.n_words)"
    kept_lines = "array_join(transform(filter(j.lines, l -> not l.fails), l -> l.line), '\\n')"
    left = let("j", _judged("t"), f"if({_lost('j')}, cast(array() as array<struct<text:string>>), array(struct(if(exists(j.lines, l -> l.fails), {kept_lines}, t) as text)))")
    verdict = let("t", "coalesce(text, '')", let("v", _report("t"), f"if({base}, cast(array() as array<struct<text:string>>), {left})"))
    # A generator is evaluated once a row: as a filter and a column the optimizer would write the verdict into both.
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.expr(f"inline({verdict})"))
    changed = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(df.schema["n_chars"].dataType)} if "n_chars" in df.columns else {})
    return held.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in df.columns])


#: DuckDB SQL for the rows of ``quality_report`` over ``documents``.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS ws FROM documents),
w AS (
  SELECT doc_id, t, ws, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: trim(x, ws) <> '') AS live
  FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS o FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
l AS (SELECT doc_id, trim(line, ws) AS k, len(string_split_regex(trim(line, ws), '[\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, ws, unnest(live) AS line FROM w)),
f AS (
  SELECT doc_id, sum(length(k)) AS all_chars, sum(CASE WHEN (length(k) - length(replace(k, '|', '')) >= 2 AND 8 * (length(k) - length(replace(k, '|', ''))) >= n)
      OR (length(regexp_replace(k, '[^#*$%&|<>]', '', 'g')) >= 3 AND length(regexp_replace(k, '[^#*$%&|<>]', '', 'g')) * 10 > n)
      OR (n >= 10 AND NOT regexp_matches(k, '[.!?…。！？।॥؟۔։።]'))
      OR (n >= 3 AND k <> lower(k) AND k = upper(k))
      OR (n <= 12 AND regexp_matches(lower(k), '(^|[^\p{L}\p{N}])(__PHRASES__)($|[^\p{L}\p{N}])')) THEN length(k) ELSE 0 END) AS lost
  FROM l GROUP BY doc_id),
c AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(live) - len(list_distinct(live)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(f.lost, 0) AS lost, coalesce(f.all_chars, 0) AS all_chars
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN f ON w.doc_id = f.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * all_chars AS kept
FROM c
""".replace("__PHRASES__", "|".join(BOILERPLATE))
