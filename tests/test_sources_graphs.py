import random
from datetime import datetime

import pytest

from kenmap.operators import graphs
from kenmap.operators.lineage import directory_moves, lineage
from kenmap.sources import text
from kenmap.streaming import ingest

R, F_ = text.RECORD, text.FIELD
SHA = "a" * 40


def test_history_reads_records_and_drops_bad_ones(spark):
    good = f"{R}{SHA}{F_}Ann\tANN@x.org{F_}2026-05-01T12:00:00+00:00{F_}p1 p2{F_}subject{F_}body\nCo-authored-by: Bob B <bob@x.org>\nCo-authored-by: Bobby <BOB@x.org>{F_}M\ta.py\nR090\told.py\tnew.py\n"
    bad = f"{R}zz{F_}Ann\tann@x.org{F_}2026-05-01T12:00:00+00:00{F_}{F_}s{F_}b{F_}M\ta.py"
    commits, files = text.history(spark.createDataFrame([(good + bad,)], "value string"))
    row = commits.first()
    assert commits.count() == 1 and (row["author"], row["parents"]) == ("ann@x.org", 2)
    assert {(f["status"], f["similarity"], f["old_path"], f["path"]) for f in files.collect()} == {("M", 100, None, "a.py"), ("R", 90, "old.py", "new.py")}
    trailers = text.coauthors(commits)
    assert [(t["name"], t["email"]) for t in trailers.collect()] == [("Bob B", "bob@x.org")]
    mailmap = spark.createDataFrame([("bob@x.org", "robert@x.org")], "raw_email string, canonical string")
    assert {c["author"] for c in text.credits(commits, trailers, mailmap).collect()} == {"ann@x.org", "robert@x.org"}


def test_attribution_counts_lines(spark):
    other = "b" * 40
    porcelain = f"{SHA} 1 1 2\nauthor-mail <Ann@x.org>\n\tline one\n{SHA} 2 2\n\tline two\n{other} 3 3 1\nauthor-mail <bob@x.org>\n\tline three"
    rows = text.attribution(spark.createDataFrame([("p", porcelain)], "path string, value string")).collect()
    assert {(r["author"], r["n_lines"]) for r in rows} == {("ann@x.org", 2), ("bob@x.org", 1)}


def test_rules_keep_order_sections_and_ownerless_rules(spark):
    rows = text.rules(spark, "# head\n* @all\n^[Docs][2] @writers\n/docs/\n/a\\ b/ @x @y # note\n/free/", sections=True).collect()
    assert [(r["line_no"], r["pattern"], r["owners"]) for r in rows] == [(2, "*", "@all"), (4, "/docs/", "@writers"), (5, "/a b/", "@x,@y"), (6, "/free/", "@writers")]
    assert rows[1]["optional"] and rows[1]["approvals"] == 2


def test_lineage_survives_swaps_and_copies(spark):
    at = lambda d: datetime(2026, 1, d)
    commits = spark.createDataFrame([("r", "1", at(1)), ("r", "2", at(2)), ("r", "3", at(3))], "repo string, sha string, ts timestamp")
    files = spark.createDataFrame([("r", "1", "A", None, None, "a"), ("r", "1", "A", None, None, "b"), ("r", "2", "R", 90, "a", "b"), ("r", "2", "R", 80, "b", "a"), ("r", "3", "C", 70, "a", "c")], "repo string, sha string, status string, similarity int, old_path string, path string")
    rows = {r["path"]: r for r in lineage(commits, files).collect()}
    assert rows["b"]["confidence"] == 0.9 and rows["a"]["confidence"] == 0.8 and list(rows["a"]["priors"]) == ["b"]
    assert rows["c"]["copied_from"] == rows["a"]["logical_id"] and rows["c"]["logical_id"] != rows["a"]["logical_id"]


def test_lineage_deals_one_repository_to_many_folds(spark, monkeypatch):
    from kenmap.operators import lineage as module

    monkeypatch.setattr(module, "GROUP_ROWS", 10)
    at = lambda d: datetime(2026, 1, d)
    commits = spark.createDataFrame([("r", "1", at(1)), ("r", "2", at(2))], "repo string, sha string, ts timestamp")
    whole = [("r", "1", "A", None, None, f"x/{n}") for n in "abc"] + [("r", "2", "R", s, f"x/{n}", f"y/{n}") for n, s in (("a", 90), ("b", 60))]  # x/c stays: no directory moved
    files = spark.createDataFrame(whole + [("r", "1", "A", None, None, f"d{i}/f") for i in range(60)], "repo string, sha string, status string, similarity int, old_path string, path string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = lineage(commits, files).selectExpr("*", "spark_partition_id() AS task").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len({r["task"] for r in found}) > 1 and len(found) == 63
    assert {r["path"]: r["confidence"] for r in found if r["path"][:2] in ("x/", "y/")} == {"x/c": 1.0, "y/a": 0.9, "y/b": 0.6}


def test_directory_moves_need_all_living_files():
    moves = [("x/a", "y/a", 100), ("x/b", "y/b", 100)]
    assert directory_moves(moves, ["x/a", "x/b"]) == [("x", "y")] and directory_moves(moves, ["x/a", "x/b", "x/c"]) == []


def test_small_graphs():
    path = [("a", "b"), ("b", "c"), ("c", "d")]
    assert graphs.articulation(path) == {"b", "c"} and graphs.articulation([("a", "b"), ("b", "c"), ("c", "a")]) == set()
    assert graphs.shortest_path(path, "a", "d") == ["a", "b", "c", "d"] and graphs.shortest_path(path, "a", "z") == []
    assert graphs.betweenness(path)["b"] == graphs.betweenness(path)["c"] > 0
    groups = graphs.communities({("a", "b"): 2.0, ("b", "c"): 2.0, ("a", "c"): 2.0, ("x", "y"): 2.0, ("c", "x"): 0.1})
    assert groups["a"] == groups["b"] == groups["c"] != groups["x"] == groups["y"]
    assert graphs.topological_ranks([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "abcxy") == ({"c": 0, "b": 1, "a": 2}, ["x", "y"])
    assert graphs.onboarding_reviewers([("p", ["u", "v"]), ("q", ["u", "v"])]) == [("p", "u"), ("q", "v")]


def test_markers_and_their_errors():
    ok = "# BEGIN MANUAL\na\n# END MANUAL\nb\n# BEGIN GENERATED\nc\n# END GENERATED"
    assert text.marked_lines(ok) == {2: "manual", 6: "generated"}
    for bad in ("# END MANUAL", "# BEGIN MANUAL", "# BEGIN MANUAL\n# BEGIN MANUAL\n# END MANUAL", "# BEGIN MANUAL\n# END GENERATED", ok + "\n# BEGIN MANUAL\n# END MANUAL"):
        with pytest.raises(ValueError):
            text.marked_lines(bad)


def test_attributes_and_owners_files():
    rows = text.attributes("# none\n*.js linguist-generated -text linguist-vendored=false\n", "web")
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [("web", 2, "linguist-generated", True), ("web", 2, "text", False), ("web", 2, "linguist-vendored", False)]
    assert text.owners_file("# @no\nreviewers: @a @b\nplain\nc@x.org # main") == ["@a", "c@x.org"]


def test_modified_counts(spark):
    log = f"{SHA}\nM\ta\nA\tb\n{'b' * 40}\n{'c' * 40}\nM a\nM\tc"
    assert {r["sha"][0]: r["modified"] for r in text.modified_counts(spark.createDataFrame([(log,)], "value string")).collect()} == {"a": 1, "b": 0, "c": 2}


def test_python_imports(spark):
    files = [("p/__init__.py", ""), ("p/a.py", "import p.b as x, os\nfrom . import c\n"), ("p/b.py", "from .q import d\nfrom p.q.d import e"), ("p/c.py", "from ..z import y"), ("p/q/__init__.py", "from . import d"), ("p/q/d.py", "from ..a import f"), ("notes.md", "import p.a")]
    got = {(r["dependent"], r["dependency"]) for r in text.python_imports(spark.createDataFrame(files, "path string, value string")).collect()}
    assert got == {("p/a.py", "p/b.py"), ("p/a.py", "p/c.py"), ("p/a.py", "p/__init__.py"), ("p/b.py", "p/q/__init__.py"), ("p/b.py", "p/q/d.py"), ("p/q/__init__.py", "p/q/d.py"), ("p/q/d.py", "p/a.py")}


def test_imports_are_read_by_syntax_not_by_lines(spark):
    source = '"""\nimport p.no\n"""\nx = "import p.no"\nfrom p import (\n    a,  # first\n    b as c,\n)\nimport p.q, \\\n    p.r\nif x:\n    from . import s\nfrom p.t import *\nfrom ...z import y\n'
    files = [("p/main.py", source), ("p/broken.py", "import p.a\ndef ("), ("p/empty.py", None), *((f"p/{n}.py", "") for n in ("a", "b", "q", "r", "s", "t", "no"))]
    got = {tuple(r) for r in text.python_imports(spark.createDataFrame(files, "path string, value string")).collect()}
    assert got == {("p/main.py", f"p/{n}.py") for n in ("a", "b", "q", "r", "s", "t")}


def test_topology_names_parents_and_affiliations(spark):
    pairs = [("a", "b", 2.0), ("b", "c", 2.0), ("a", "c", 2.0), ("x", "y", 2.0), ("y", "z", 2.0), ("x", "z", 2.0), ("c", "x", 1.0), ("c", "y", 1.2)]
    weights = {(a, b): w for a, b, w in pairs}
    groups = graphs.communities(weights)
    assert graphs.affiliations(weights, groups) == {("c", groups["x"])} and graphs.stability(weights) == (1.0, 0.0)
    rows = graphs.topology(spark.createDataFrame(pairs, "a string, b string, weight double"), spark.createDataFrame([("team", "X"), ("team", "@y"), ("team", "z"), ("other", "q")], "slug string, login string")).collect()
    assert {(r["name"], r["members"], r["affiliated"], r["closest_team"]) for r in rows} == {("inferred-1", "a,b,c", "", "other"), ("team", "x,y,z", "c", "team")}


def test_directory_move_takes_the_least_similarity_and_the_living_files(spark):
    at = lambda d: datetime(2026, 1, d)
    commits = spark.createDataFrame([("r", str(i), at(i)) for i in (1, 2)], "repo string, sha string, ts timestamp")
    files = spark.createDataFrame([("r", "1", "A", None, None, "x/k/a"), ("r", "1", "A", None, None, "x/k/b"), ("r", "2", "R", 90, "x/k/a", "y/k/a"), ("r", "2", "R", 70, "x/k/b", "y/k/b"), ("r", "2", "R", 100, "x/k/dead", "y/k/dead")], "repo string, sha string, status string, similarity int, old_path string, path string")
    assert {r["path"]: r["confidence"] for r in lineage(commits, files).collect()} == {"y/k/a": 0.7, "y/k/b": 0.7, "y/k/dead": 1.0}  # a file that nobody knew starts anew


def test_steady_severity_goes_on_from_its_state(spark):
    rng = random.Random(4)
    rows = [(r, i, rng.choice(["low", "low", "high", "mid"]), rng.choice([0.1, 0.2, 0.5])) for r in ("r", "s") for i in range(40)]
    df = spark.createDataFrame(rows, "repo string, run long, severity string, delta double")
    got = {(r["repo"], r["run"]): (r["reported"], r["streak"]) for r in ingest.steadied(df, slices=2).collect()}
    for repo in ("r", "s"):
        want = graphs.hysteresis([(s, d) for name, _, s, d in rows if name == repo])
        assert [got[repo, i] for i in range(40)] == [(reported, streak) for reported, _, streak in want]
    assert {(r["repo"], r["run"]): (r["reported"], r["streak"]) for r in graphs.steady(df).collect()} == got
    assert spark.conf.get(ingest.STATE_STORE, None) is None or "RocksDB" not in spark.conf.get(ingest.STATE_STORE)


def test_hysteresis_waits_and_jumps():
    runs = [("low", 0.1), ("high", 0.1), ("high", 0.1), ("high", 0.1), ("low", 0.9)]
    assert [r[0] for r in graphs.hysteresis(runs)] == ["low", "low", "low", "high", "low"]


def test_stream_windows(spark, sf):
    rows = ingest.drained(ingest.windowed(ingest.event_stream(spark, sf)), ["start", "event_type"])
    assert rows.agg({"events": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_modules_as_many_as_the_files_are_not_broadcast(spark):
    files = spark.createDataFrame([("a.py", "import b"), ("b.py", "")], "path string, value string")
    found = text.python_imports(files)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("a.py", "b.py")]
