import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kenmap.llm import packing, queries


def test_stages_shrink_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == names, name
        assert 0 < docs.count() <= left
        left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == left
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_stages_take_awkward_tables(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 50, "en", "s", 250), (2, "word " * 50, "en", "s", 250), (None, "Some words that are fine for all of the rules, and so on here.", None, None, None)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() >= 0


def test_near_duplicates_keep_different_texts_of_one_id(spark, sf):
    base, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(1, base), (1, other), (2, base + " end"), (3, "short one"), (3, "short one"), (None, base), (None, base), (4, "")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    found = sorted((r["doc_id"] or 0, r["text"]) for r in kept)
    assert len(found) == 6 and found.count((3, "short one")) == 1 and (1, other) in found and found.count((0, base)) == 2
    assert sum(t.startswith(base) for i, t in found if i) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf).select(cols).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_for_each_operator(n):
    assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1


def test_packing_leaves_no_memo_in_the_workers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def held(batches):
        from kenmap.llm.token_ids import token_ids

        own = token_ids(queries.WORD_BPE)
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(own.young) + len(own.old)], pa.int64())], ["held"])

    def most():
        return spark.range(0, 64, 1, 8).selectExpr("id as held").mapInArrow(held, "held long").agg({"held": "max"}).head()[0]

    packing.token_pieces(docs, queries.WORD_BPE).count()
    assert most() > 0  # op7 keeps it from task to task
    corpus_pipeline.best_fit(spark, docs.repartition(16), sf).count()
    assert most() == 0
