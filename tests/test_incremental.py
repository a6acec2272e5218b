"""Incremental runs against one run over the whole window."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kenmap.plans.catalog import OPERATORS
from kenmap.plans.engine import Engine
from kenmap.sinks import attribution, incremental

DAY = timedelta(days=1)
START = datetime(2026, 1, 1)


def history(seed, n, paths, days):
    rng = random.Random(seed)
    return sorted({(f"d/p{rng.randrange(paths)}", f"a{rng.randrange(5)}", k, START + rng.randrange(days) * DAY) for k in range(n)}, key=lambda e: e[3])


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, author string, sha long, ts timestamp")


def whole(spark, rows, end, window):
    events = frame(spark, [r for r in rows if end - window <= r[3] <= end])
    return {tuple(r) for r in Engine(spark, OPERATORS, {"events": events}).table("contributions").collect()}


def got(store):
    found = store.contributions()
    columns = ["path", "author", "commits", "credit", "last_commit", "last_sha", "later_commits", "cadence_days"]
    return {tuple(r) for r in found.select(*columns).collect()}


def test_runs_equal_the_whole_window_and_rewrite_only_what_changes(spark, tmp_path):
    rows, window = history(1, 400, 60, 100), 90 * DAY
    store = incremental.Store(spark, str(tmp_path / "store"), parts=16)
    first, second = START + 89 * DAY, START + 91 * DAY
    one = store.advance(frame(spark, [r for r in rows if r[3] <= first]), "c1", first, window, {})
    assert got(store) == whole(spark, rows, first, window) and one.rewritten == sorted(one.held)
    two = store.advance(frame(spark, [r for r in rows if first < r[3] <= second]), "c2", second, window, {})
    assert got(store) == whole(spark, rows, second, window)
    assert 0 < len(two.rewritten) < len(two.held)
    # a part that is not rewritten lies where the first run wrote it, and its rows are not read again
    assert {p for p, x in two.held.items() if x.run == one.run} == set(two.held) - set(two.rewritten)
    read = sum(one.held[p].rows for p in two.rewritten if p in one.held)
    assert read < 0.8 * sum(x.rows for x in one.held.values())
    assert store.manifest() == two


def test_events_leave_the_window_and_repeats_count_once(spark, tmp_path):
    rows, window = history(2, 150, 10, 60), 20 * DAY
    store = incremental.Store(spark, str(tmp_path / "store"), parts=4)
    for day in (19, 25, 40, 59):
        end = START + day * DAY
        store.advance(frame(spark, [r for r in rows if r[3] <= end][-80:]), f"c{day}", end, window, {})  # repeats what it has already had
    assert got(store) == whole(spark, rows, START + 59 * DAY, window)
    far = store.advance(frame(spark, []), "later", START + 500 * DAY, window, {})
    assert far.held == {} and store.contributions() is None


def test_a_run_that_fails_leaves_the_last_one_whole(spark, tmp_path, monkeypatch):
    rows, window = history(3, 60, 8, 30), 30 * DAY
    store = incremental.Store(spark, str(tmp_path / "store"), parts=4)
    assert store.manifest() is None and store.events() is None
    store.advance(frame(spark, rows[:40]), "c1", START + 29 * DAY, window, {})
    before = got(store)
    with monkeypatch.context() as m:
        m.setattr(incremental.Engine, "table", lambda self, name: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.advance(frame(spark, rows[40:]), "c2", START + 29 * DAY, window, {})
    assert got(store) == before and store.manifest().run == 1
    assert store.advance(frame(spark, rows[40:]), "c2", START + 29 * DAY, window, {}).run == 3
    assert got(store) == whole(spark, rows, START + 29 * DAY, window)


def test_reasons_against_the_run_before(spark):
    settings = {"follow_renames": True, "rename_similarity": 50, "mailmap": True}
    m = incremental.Manifest(1, "abc", "2026-01-01 00:00:00", 4, settings, False, {}, [])
    assert incremental.reason(m, settings, True, True) == ""
    assert incremental.reason(None, settings, True, True) == "there is no run before"
    assert incremental.reason(replace(m, truncated=True), settings, True, True) == "the run before is incomplete"
    assert incremental.reason(replace(m, ref=""), settings, True, True) == "the run before names no commit"
    assert incremental.reason(m, settings, False, True) == "the commit of the run before is gone"
    assert incremental.reason(m, settings, True, False) == "the commit of the run before is not an ancestor"
    assert incremental.reason(m, settings | {"rename_similarity": 60}, True, True) == "the lineage settings changed"
    assert incremental.reason(m, settings | {"mailmap": False}, True, True) == "the settings changed"


def test_new_events_are_all_that_is_read_of_the_source(spark, sf):
    from kenmap.plans import catalog

    fresh = catalog.engine(spark, sf).table("events_all").where(F.col("ts") > F.lit(datetime(2001, 6, 1)))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(o_orderdate" in plan


def test_attribution_is_read_once_for_each_content(spark, tmp_path):
    store = attribution.Store(spark, str(tmp_path / "lines"))
    porcelain = lambda *people: "\n".join(f"{k:040x} 1 1 1\nauthor-mail <{p}>\n\tline" for k, p in enumerate(people))
    tree = lambda *rows: spark.createDataFrame(rows, "path string, blob string")
    texts = lambda **rows: spark.createDataFrame(list(rows.items()), "path string, value string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    one = store.attributed(tree(("a", "1"), ("b", "1"), ("e", "1")), texts(a=porcelain("X", "y", "x"), b=porcelain("y"), e=""), 1)
    assert rows(one) == {("a", "x", 2, False), ("a", "y", 1, False), ("b", "y", 1, False)}
    # a is not read again, whatever its text says now; b has changed; c is new; a content that comes back is known
    two = store.attributed(tree(("a", "1"), ("b", "2"), ("c", "1")), texts(a=porcelain("nobody"), b=porcelain("z", "z"), c=porcelain("x")), 2)
    assert rows(two) == {("a", "x", 2, True), ("a", "y", 1, True), ("b", "z", 2, False), ("c", "x", 1, False)}
    assert rows(store.attributed(tree(("b", "1"), ("e", "1")), texts(b=porcelain("nobody"), e=porcelain("nobody")), 3)) == {("b", "y", 1, True)}
    # entries without their list of digests are not there
    spark.createDataFrame([("d" * 64, "ghost", 1, "dd")], "digest string, author string, n_lines long, shelf string").write.partitionBy("shelf").parquet(str(tmp_path / "lines/lines/run=4"))
    assert store.keys().where("shelf = 'dd' and digest like 'ddd%'").count() == 0
