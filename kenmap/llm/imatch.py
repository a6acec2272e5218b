"""I-Match fingerprints with DataFrame functions only.

Terms are the lower-cased runs of letters and digits, told apart by 64-bit hashes.  A first pass counts, over
all documents and term by term, in how many each occurs; the counts are added up before they are shuffled.
The band keeps terms that occur in at least ``MIN_DOCUMENTS`` documents and in a share of all documents between
``MIN_SHARE`` and ``MAX_SHARE``.  As each of its terms takes a share of ``MIN_SHARE`` of the documents, the band holds at most
(mean distinct terms of a document) / ``MIN_SHARE`` terms, however many documents there are.  It goes to the
tasks as one hash table (an array of buckets) that is a constant of the plan, so it is never copied into a row.

A document's fingerprint keeps its distinct terms in that band, sorts them, and hashes randomised lexicon
subsets: each term of the lexicon belongs to one of 15 x 8 subsets at random, subsets of level l holding a
share of 2**-(l+1) / 8 of the lexicon.  Large subsets tell copies from near copies; small ones, in which a
long document has a term or two, survive edits.  A last subset holds all terms of the document, in the band or not, so that
every document that has a term has a fingerprint.  A fingerprint is the list of its non-empty subsets, each
with the hash of its sorted terms.  The likeness of two is 1 where they are equal, else the largest share, over the levels l, of equal
subsets among the non-empty ones of the band at level l or above, of which there must be six (or all there are).

Defined results: a null text is the empty text; a text without terms has the empty fingerprint, which is like
itself (1) and like nothing else (0); documents are neighbours in ascending doc_id, a null doc_id first,
after the last comes the first; where a doc_id repeats, the next document is that of the next larger doc_id
(of several texts there, the smallest start), and each repeated row gives a result of its own; one document alone is its own next.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.llm.shared import keep
from kenmap.llm.sqltext import let

#: Levels of eight subsets each; the number of the subset of all terms follows theirs.
LEVELS = 15
WHOLE = 8 * LEVELS
#: The band: a term's documents, as a share of all; and the least number of them.
MIN_SHARE, MAX_SHARE, MIN_DOCUMENTS = 0.0001, 0.01, 2
BUCKET_ROWS, MOST_BUCKETS = 100_000, 1000
#: Mean terms in a bucket of the band's table, at most.
BUCKET_TERMS = 8
NULL_ID = -(2**63) + 1


def _term_hashes(text: str) -> str:
    """Distinct 64-bit hashes of the terms of a text."""
    return f"array_distinct(transform(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> ''), x -> xxhash64(x)))"


def band_table(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row: ``band``, a hash table of the terms whose document frequency is in the band; a term lies in the bucket of its last bits."""
    total = docs.count()
    low, high = max(min_documents, min_share * total), max(max_share * total, min_documents + 1)
    counted = docs.select(F.explode(F.expr(_term_hashes("text"))).alias("h")).groupBy("h").count()
    inside = keep(counted.where(F.col("count").between(low, high)).select("h"))
    buckets = 1 << max(0, inside.count() // BUCKET_TERMS).bit_length()
    filled = inside.groupBy(F.expr(f"h & {buckets - 1}L").alias("id")).agg(F.sort_array(F.collect_list("h")).alias("hs"))
    every = docs.sparkSession.range(buckets).join(filled, "id", "left").selectExpr("id", "coalesce(hs, cast(array() as array<bigint>)) as hs")
    return keep(every.agg(F.expr("transform(sort_array(collect_list(struct(id, hs))), b -> b.hs) as band")))


def _codes(text: str, band: str) -> str:
    """Sorted array of longs: number of the subset in the top byte, hash of its terms below; ``band`` names the table."""
    level = let("y", "(r & 16383) | 16384", "bit_count(y ^ (y - 1)) - 1")
    coded = f"transform(t, h -> {let('r', 'xxhash64(h, 7)', f'shiftleft(cast({level} * 8 + (shiftrightunsigned(r, 20) & 7) as bigint), 56) | (h & {2**56 - 1}L)')})"
    hashed = "shiftleft(a.s, 56) | (a.h & 72057594037927935L)"
    # One pass over the sorted codes: the hash of a subset is finished when the next subset begins.
    folded = (
        f"aggregate(sort_array({coded}), struct(-1L as s, 0L as h, cast(array() as array<bigint>) as o), (a, c) -> "
        f"if(shiftright(c, 56) = a.s, struct(a.s as s, xxhash64(a.h, c) as h, a.o as o), struct(shiftright(c, 56) as s, xxhash64(0L, c) as h, if(a.s < 0, a.o, concat(a.o, array({hashed}))) as o)), "
        f"a -> if(a.s < 0, a.o, concat(a.o, array({hashed}))))"
    )
    whole = f"if(size(g) = 0, cast(array() as array<bigint>), array(shiftleft({WHOLE}L, 56) | (xxhash64(sort_array(g)) & {2**56 - 1}L)))"
    inside = f"filter(g, h -> array_contains({band}[cast(h & (size({band}) - 1) as int)], h))"
    return let("g", _term_hashes(text), let("t", inside, f"concat({folded}, {whole})"))


def _likeness(f: str, g: str) -> str:
    shares = (
        "transform(sequence(0, 12, 2), l -> "
        + let("n", "size(filter(s, x -> shiftright(x, 3) >= l))", "if(n >= least(6, size(s)) and n > 0, size(filter(m, c -> shiftright(c, 59) >= l)) / n, 0D)")
        + ")"
    )
    of_band = lambda codes: f"filter({codes}, c -> shiftrightunsigned(c, 56) < {WHOLE})"
    both = let("m", of_band(f"array_intersect({f}, {g})"), let("s", f"array_distinct(transform({of_band(f'concat({f}, {g})')}, c -> shiftright(c, 56)))", f"array_max({shares})"))
    return f"case when {f} = {g} then 1D else cast({both} as double) end"


def _string(codes: str) -> str:
    return f"array_join(transform({codes}, c -> lower(hex(c))), '-')"


def next_documents(docs: DataFrame) -> DataFrame:
    """key, next_key, quarter for each distinct key of ``docs`` (key, text), in ascending order, without sorting all in one task."""
    sizes = keep(docs.groupBy("key").agg(F.max(F.length("text")).alias("n")))
    rows, least = sizes.agg(F.count("*"), F.min("key")).first()
    if not rows:
        return sizes.selectExpr("key", "key as next_key", "0 as quarter")
    # Bounds at quantiles of the ids that occur, so dense runs in a sparse range are cut too; they need not be exact.
    parts = min(MOST_BUCKETS, rows // BUCKET_ROWS + 8)
    bounds = sorted({int(x) for x in sizes.stat.approxQuantile("key", [k / parts for k in range(1, parts)], 0.2 / parts)})
    placed = sizes.withColumn("bucket", F.expr(f"size(filter(array({', '.join(f'{x}L' for x in bounds)}), x -> x <= key))"))
    heads = placed.groupBy("bucket").agg(F.min("key").alias("head")).selectExpr("bucket", f"coalesce(lead(head) over (order by bucket), {least}L) as head")
    within = placed.withColumn("after", F.expr("lead(key) over (partition by bucket order by key)"))
    return within.join(heads, "bucket").selectExpr("key", "coalesce(after, head) as next_key", "cast(floor(n / 4) as int) as quarter")


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``df``."""
    docs = df.select(F.expr(f"coalesce(cast(doc_id as bigint), {NULL_ID}L) as key"), F.expr("coalesce(text, '') as text"))
    spark, band = df.sparkSession, f"kenmap_band_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {band} ARRAY<ARRAY<BIGINT>>")
    spark.sql(f"SET VARIABLE {band} = (SELECT band FROM {{made}})", made=band_table(docs))
    # ``^ 0L`` hides where the keys come from: else a condition on them is pushed into one of the two reads of the texts, which then share no exchange.
    order = keep(next_documents(docs)).select(F.expr("key ^ 0L as own"), F.expr("next_key ^ 0L as next_key"), "quarter")
    after = docs.join(order, docs["key"] == order["next_key"]).select("own", F.expr("substring(text, 1, quarter) as start"), F.expr(_codes("text", band)).alias("codes"))
    after = after.groupBy("own").agg(F.min("start").alias("start"), F.min_by("codes", "start").alias("next_codes"))
    own = docs.join(after, docs["key"] == after["own"])
    own = own.withColumn("n", F.length("text"))
    own = own.withColumn("edited", F.expr("concat(substring(text, 1, n - cast(floor(n / 4) as int)), substring(start, 1, cast(floor(n / 4) as int)))"))
    coded = own.select("key", "n", F.sha2("edited", 256).alias("edited_sha256"), F.expr(_codes("text", band)).alias("codes"), F.expr(_codes("edited", band)).alias("edited_codes"), "next_codes")
    spark.sql(f"DROP TEMPORARY VARIABLE {band}")  # the plans hold its value
    return coded.select(
        F.expr(f"nullif(key, {NULL_ID}L) as doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        F.expr(_string("codes")).alias("fingerprint"),
        F.expr(_string("edited_codes")).alias("edited_fingerprint"),
        F.expr(_likeness("codes", "edited_codes")).alias("near_edited"),
        F.expr(_likeness("codes", "next_codes")).alias("near_next"),
    )
