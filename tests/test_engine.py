import math
import re
from datetime import datetime, timedelta

import pytest

from kenmap.params import Params
from kenmap.plans import catalog, checks
from kenmap.plans.engine import Engine, in_dialect, statement
from kenmap.sources import adapter

NOW = datetime(2026, 5, 28, 12)
PARAMS = Params(as_of="2026-05-28 12:00:00")
SCHEMAS = {
    "events_all": "path string, author string, sha string, ts timestamp",
    "tracked": "path string", "exclude_rules": "pattern string, rx string",
    "blame_lines": "path string, author string, n_lines double", "blame_then": "path string, author string, n_lines double", "review_counts": "path string, author string, n bigint",
    "criticality": "ord int, rx string, rule_rx string, weight double", "commits": "sha string, author string, ts timestamp, parents int, subject string", "extra_bots": "author string",
}


def facts(spark, events, **more):
    rows = {"events_all": events, "tracked": sorted({(e[0],) for e in events}), **more}
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}


def days(n):
    return NOW - timedelta(days=n)


def owners(spark, events, name="scored", params=PARAMS, **more):
    rows = Engine(spark, catalog.OPERATORS, facts(spark, events, **more), params).table(name).collect()
    return {(r["path"], r["author"]): r for r in rows}


def test_macros_nest():
    assert in_dialect("SELECT @days(@str(a), 'x, (y')", 1) == "SELECT ((epoch_us(cast(a as varchar)) - epoch_us('x, (y')) / 8.64e10)"


@pytest.mark.parametrize("age,expected", [(0, 1.0), (90, 0.5), (180, 0.25)])
def test_recency(spark, age, expected):
    assert owners(spark, [("a", "x", "1", days(age))])["a", "x"]["recency"] == pytest.approx(expected)


def test_contributions_count_later_events_and_cadence(spark):
    events = [("a", "x", "1", days(40)), ("a", "y", "2", days(30)), ("a", "x", "3", days(20)), ("a", "y", "4", days(10))]
    got = owners(spark, events, "contributions")
    assert (got["a", "x"]["commits"], got["a", "x"]["later_commits"], got["a", "x"]["last_sha"], got["a", "x"]["cadence_days"]) == (2, 1, "3", 10.0)
    assert got["a", "y"]["later_commits"] == 0


def test_signals_are_available_by_path(spark):
    events = [("a", "x", "1", days(5)), ("a", "y", "2", days(6)), ("b", "x", "3", days(5))]
    got = owners(spark, events, blame_lines=[("a", "x", 10.0)])
    assert got["a", "y"]["blame"] == 0.0 and got["b", "x"]["blame"] is None and got["a", "x"]["blame"] == 1.0


def test_score_is_the_mean_of_what_is_available(spark):
    r = owners(spark, [("a", "x", "1", days(0))])["a", "x"]
    assert r["score"] == pytest.approx((0.3 * 1 + 0.2 * 0.25) / 0.5) and r["quality"] == pytest.approx(0.5)


@pytest.mark.parametrize("age,status", [(180, "stable"), (181, "inactive")])
def test_freshness_boundary(spark, age, status):
    assert owners(spark, [("a", "x", "1", days(age))])["a", "x"]["status"] == status


def test_superseded_comes_before_age(spark):
    events = [("a", "x", "1", days(30)), *[("a", "y", str(i + 2), days(20 - i)) for i in range(3)]]
    assert owners(spark, events)["a", "x"]["status"] == "superseded"


def test_evidence_gives_the_scores_again(spark):
    events = [("a", "x", "1", days(5)), ("a", "y", "2", days(60)), ("b", "y", "3", days(15))]
    more = {"blame_lines": [("a", "x", 3.0), ("a", "y", 1.0)], "blame_then": [("a", "x", 4.0)], "review_counts": [("b", "y", 2)]}
    scored, again = owners(spark, events, **more), owners(spark, events, "rescored", **more)
    assert all(scored[k]["score"] == pytest.approx(again[k]["score"]) for k in scored) and len(scored) == len(again)


@pytest.mark.parametrize("scores,effective,truck", [([1.0], 1, (1, 1, 1)), ([0.5, 0.5], 2, (1, 2, 2)), ([0.25] * 4, 4, (2, 3, 4))])
def test_concentration(spark, scores, effective, truck):
    ranked = spark.createDataFrame([("p", f"u{i}", s, i + 1) for i, s in enumerate(scores)], "path string, author string, score double, rank int")
    r = Engine(spark, catalog.OPERATORS, {"ranked": ranked}, PARAMS).table("concentration").first()
    assert r["effective_owners"] == pytest.approx(effective) and (r["truck_50"], r["truck_75"], r["truck_90"]) == truck
    assert r["entropy"] == pytest.approx(math.log(effective))


def test_every_report_matches_another_engine(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in adapter.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    own = catalog.engine(spark, sf)  # one engine: its pinned steps are made once
    for name in (*checks.TEXTS, "new_findings", "audit", "drift_entries", "team_drift", "resolved"):
        got = catalog.rounded(own.table(name), name)
        cols = sorted(got.columns)
        want = con.execute(catalog.ORACLES[name])
        at = [[d[0] for d in want.description].index(c) for c in cols]
        form = lambda rows: sorted(tuple("" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
        left = form([[float(r[c]) if isinstance(r[c], (int, float)) and not isinstance(r[c], bool) else r[c] for c in cols] for r in got.collect()])
        right = form([[float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r] for r in ([row[i] for i in at] for row in want.fetchall())])
        assert left == right, name


def test_reports_have_their_schema(spark, sf):
    engine = catalog.engine(spark, sf)
    for name in catalog.QUERIES:
        assert [c for c, _ in catalog._columns(name)] == engine.table(name).columns


def test_statement_is_self_contained():
    assert not re.search(r"[{][a-z_]", statement(adapter.OPERATORS | catalog.OPERATORS, "owners", Params()))
