import json
from datetime import UTC, datetime

import pytest

from kenmap.operators import graphs
from kenmap.operators.identity import Identities, Record, certain_groups, redacted, shown_names
from kenmap.params import Params
from kenmap.sinks import documents, state
from kenmap.sources import api, settings, text


def raw(spark, *pages):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in pages], "value string")


def test_pull_pages_keep_the_window(spark):
    node = lambda n, updated, closed=None, who="a", path="p": {"number": n, "createdAt": "2026-01-01T00:00:00Z", "updatedAt": updated, "closedAt": closed, "changedLines": 3, "reviews": {"nodes": [{"author": {"login": who}}, {"author": None}]}, "files": {"nodes": [{"path": path}, {"path": "q"}]}}
    nodes = [node(1, "2026-05-02T00:00:00Z", "2026-05-01T00:00:00Z"), node(2, "2026-05-03T00:00:00Z"), node(3, "2026-06-02T00:00:00Z", "2026-06-02T00:00:00Z"), node(4, "2026-05-03T00:00:00Z", "2026-01-02T00:00:00Z"), node(5, "2026-01-03T00:00:00Z"), node(6, None)]
    pulls = api.pull_pages(raw(spark, {"repository": {"pullRequests": {"nodes": nodes}}}, "no json", {}), "2026-04-01", "2026-06-01")
    assert {r["number"] for r in pulls.collect()} == {1, 2}
    assert {tuple(r) for r in api.review_counts(pulls).collect()} == {("p", "a", 2), ("q", "a", 2)}
    assert {r["number"] for r in api.pull_pages(raw(spark, {"repository": {"pullRequests": {"nodes": nodes}}}), None, "2026-06-01").collect()} == {1, 2, 4, 5}


def test_platform_pages(spark):
    files = [{"filename": "a", "status": "added"}, {"filename": "b", "status": "removed"}, {"filename": "a", "status": "modified"}]
    assert [r["path"] for r in api.pull_files(raw(spark, files)).collect()] == ["a"]
    found, people = api.teams(raw(spark, [{"slug": "t", "parent": {"slug": "p"}, "members": [{"login": "x"}]}, {"slug": "p"}, {"slug": ""}]))
    assert {tuple(r) for r in found.collect()} == {("t", "p", True), ("p", None, False)} and [tuple(r) for r in people.collect()] == [("t", "x")]
    assert [r["login"] for r in api.members(raw(spark, [{"login": "m"}, {}])).collect()] == ["m"]
    assert [tuple(r) for r in api.rule_errors(raw(spark, {"errors": [{"line": 3, "kind": "k", "message": "m"}]})).collect()] == [(3, "k", "m")]
    rule, none = [{"type": "pull_request", "parameters": {"require_code_owner_review": True}}], [{"type": "x"}]
    ask = lambda r, p: api.review_required(raw(spark, r), raw(spark, p)).first()["review"]
    assert (ask(rule, {}), ask(none, {"required_pull_request_reviews": {"require_code_owner_reviews": True}}), ask(none, {}), ask("gone", {})) == ("required", "required", "disabled", "unknown")
    owners = spark.createDataFrame([("@A",), ("@b",), ("@c",), ("@d",)], "owner string")
    assert dict(map(tuple, api.access(owners, raw(spark, {"owner": "@a", "permission": "push"}, {"owner": "@b", "permission": "pull"}, {"owner": "@c"})).collect())) == {"@A": "write", "@b": "read", "@c": "invisible", "@d": "unknown"}


def test_pages_end_with_the_budget():
    pages = {None: ([1, 2], "x"), "x": ([3], "y"), "y": ([4], None)}
    budget = api.Budget(2)
    assert api.paged(pages.get, budget) == [1, 2, 3] and budget.gaps == {"api_budget"} and api.paged(pages.get, api.Budget(9)) == [1, 2, 3, 4]
    assert api.paged(lambda c: None, api.Budget(9)) is None and api.paged(pages.get, api.Budget(9), limit=3) == [1, 2, 3]


def test_commit_graph_and_nodes():
    parents = {"m": ["x", "y"], "x": ["b"], "y": ["b"], "b": ["a"]}
    assert graphs.merge_bases(parents, "x", "y") == ["b"] and graphs.merge_bases(parents, "m", "b") == ["b"] and graphs.merge_bases(parents, "x", "q") == []
    nodes = ["person:@ann", "path:src", "team:core"]
    assert [graphs.resolve_node(n, nodes) for n in ("ann", "src/", "core", "none")] == ["person:@ann", "path:src", "team:core", None]
    assert graphs.for_display([("p1", "f", "r"), ("p2", "f", "r")], {"p1": "person-1", "p2": None}) == [("person-1", "f", "r")]


def test_only_generated_files_are_overwritten():
    for fine in (None, "", documents.rule_file([("*", "@a")]), "# BEGIN MANUAL\n* @a\n# END MANUAL"):
        documents.safe_to_overwrite(fine)
    with pytest.raises(ValueError):
        documents.safe_to_overwrite("* @me")


def test_settings():
    assert settings.load('threshold = 0.5\nas_of = "2026-01-01 00:00:00"\nhalf_life = 30').half_life == 30.0
    for bad in ("nothing = 1", 'threshold = "x"', "threshold = 2.0", "top_n = true"):
        with pytest.raises(ValueError):
            settings.load(bad)
    assert settings.digest(Params(target="a")) == settings.digest(Params(target="b")) != settings.digest(Params(threshold=0.4))
    assert settings.resolve_instant("2026-01-01T02:00:00+02:00", "5", None) == datetime(2026, 1, 1, tzinfo=UTC) == settings.instant("2026-01-01")
    assert settings.resolve_instant(None, "0", None) == datetime(1970, 1, 1, tzinfo=UTC)
    with pytest.raises(ValueError):
        settings.resolve_instant(None, None, None)
    assert settings.window_start(datetime(2026, 1, 31), 30) == datetime(2026, 1, 1) and settings.window_start(datetime(2026, 1, 31), 0) is None
    assert settings.whole_days(datetime(2026, 1, 1), datetime(2026, 1, 2)) == 0
    assert {settings.remote(u) for u in ("git@Host.org:a/b.git", "https://user@host.org/a/b/", "ssh://git@host.org:22/a/b")} == {"host.org/a/b"}


def test_snapshots_are_reused_only_while_they_hold(spark, tmp_path):
    root, now = str(tmp_path), datetime(2026, 1, 2)
    run = {"ref": "r1", "config": "c" * 20, "as_of": "2026-01-01T00:00:00"}
    table = spark.createDataFrame([("p", 1)], "path string, n int")
    state.write(table, root, "owners", run)
    ask = lambda **k: state.reusable(spark, root, "owners", **{"head": "r1", "config": "c" * 20, "now": now} | k)
    assert [tuple(r) for r in ask().collect()] == [("p", 1)] and ask(head="r2", allow_stale=True) is not None
    assert ask(head="r2") is None and ask(config="d") is None and ask(max_age=0) is None and ask(max_age=3600) is None and ask(max_age=90_000) is not None
    assert state.refusal({"version": "0"}, "", "", now) and state.refusal(run | {"version": state.VERSION, "truncated": True}, "r1", "c" * 20, now)
    state.write(table, root, "owners", run | {"ref": "r2"})
    assert len(state.snapshots(spark, root, "owners")) == 2 and state.evict(spark, root, "owners") == 0 and state.evict(spark, root, "owners", 1) == 2
    state.write(table, root, "owners", run)
    state.clear(spark, root, "owners")
    assert state.snapshots(spark, root, "owners") == []


def test_replay_and_refresh(spark):
    at = datetime(2026, 1, 1)
    window = spark.createDataFrame([("1", "a", at), ("2", "b", at), ("3", "c", at)], "sha string, author string, ts timestamp")
    files = lambda *r: spark.createDataFrame(list(r), "sha string, path string")
    rows = {(r["sha"], r["path"], r["missing"]) for r in state.replayed(window, files(("1", "p")), files(("1", "other"), ("2", "q"))).collect()}
    assert rows == {("1", "p", False), ("2", "q", False), ("3", None, True)}
    scores = lambda *r: spark.createDataFrame(list(r), "path string, score double")
    assert {tuple(r) for r in state.refreshed(scores(("p", 1.0), ("q", 1.0)), scores(("p", 2.0), ("q", 2.0), ("z", 2.0)), scores(("q", 0.0))).collect()} == {("p", 1.0), ("q", 2.0)}


def test_merges_leave_a_trail_and_can_be_undone():
    people = Identities({h: Record(h, (f"{h}@x",), (h.upper(),)) for h in ("ann", "anna", "bob")})
    assert people.merge("ann", "anna", "@ann") and people.records["@ann"].emails == ("ann@x", "anna@x") and not people.merge("ann", "anna", "@ann")
    assert people.revert("ANNA", "@ann") and set(people.records) == {"ann", "anna", "bob"} and people.separated("ann", "anna") and people.merge("ann", "anna", "@ann")
    assert [e.action for e in people.trail] == ["merge", "unmerge", "merge"] and not people.revert("bob", "zoe")
    assert certain_groups([("a", "@x", True), ("b", "@X", True), ("c", "@x", False), ("d", "x", True)], [("A", "d")]) == [["a", "b"], ["c"], ["d"]]
    assert shown_names([("a", "@x", True), ("b", "@X", True), ("c", "@y", False), ("d", "x", True)], [("A", "d")]) == {"a": "a", "b": "@X", "c": "@y", "d": "d"}


def test_redaction_walks_everything():
    found = redacted({"owners": ["@Ann", "bob"], "ann": 1, "text": "by @ann and ANN, not bob", "deep": [{"handle": "ann"}]}, ["@Ann"])
    assert found == {"owners": ["bob"], "text": "by [removed] and [removed], not bob", "deep": [{"handle": "[removed]"}]}


def test_rule_files_round_trip_and_widen_only_without_loss():
    rows = [("/app/[id]/page.js", "@a"), ("/lib/", "@b")]
    assert documents.broadened(rows, {"app/[id]/page.js": "@a", "app/x/page.js": "@a"}) == ([("/app/*/page.js", "@a"), ("/lib/", "@b")], [])
    kept, refused = documents.broadened(rows, {"app/[id]/page.js": "@a", "app/x/page.js": "@z"})
    assert kept == [("/lib/", "@b")] and refused[0][0] == "/app/[id]/page.js"
    content = documents.rule_file([("/src/", "@a"), ("/src/x.py", "@b")], manual="# BEGIN MANUAL\n/own/ @m\n# END MANUAL")
    assert documents.round_trip(content, {"src/y": "@A", "src/x.py": "@b", "own/z": "@a"}) == []  # a manual block overrides
    assert documents.round_trip(content, {"src/y": "@c"}) == [("src/y", "@c", "@a")]
    assert "[src][1]\n/src/ @a\n/src/x.py @b" in documents.sections_file([("/src/", "@a"), ("/src/x.py", "@b"), ("*", "@all")]) and "[Repository][1]\n* @all" in documents.sections_file([("*", "@all")])
    assert documents.same_syntax([{"line_no": 2}], [{"line_no": 2}, {"line_no": 2}]) and not documents.same_syntax([{"line_no": 2}], [])


def test_texts_for_people():
    findings = [{"rule": "r", "path": f"p{i:03d}|"} for i in range(60)]
    shown = documents.summary({"drift": 60}, findings)
    assert "| drift | 60 |" in shown and shown.endswith("- and 10 more\n") and "p000\\|" in shown
    assert documents.fix_plan([{"kind": "stale_rule", "path": "/a/", "line_no": 3}, {"kind": "owner_mismatch", "path": "b", "line_no": None}]) == "line -: review the owners of b\nline 3: remove rule /a/\n"
    html = documents.page("A & B", {"t": (["c"], [("<x>",), (None,)])})
    assert "&lt;x&gt;" in html and "http" not in html and "src=" not in html
    with pytest.raises(ValueError):
        documents.page("x", {}, max_bytes=10)
    assert json.loads(documents.stamped({"n": 1}, {"ref": "r", "noise": 2})) == {"ref": "r", "data": {"n": 1}}


def test_tree_changes_and_descriptors(spark):
    listing = f"100644 blob {'a' * 40}\tsrc/a b.py\n040000 tree {'b' * 40}\tsrc\n100755 blob {'c' * 40}\tx"
    assert {tuple(r) for r in text.tree(raw(spark, listing)).collect()} == {("src/a b.py", "a" * 40), ("x", "c" * 40)}
    files = spark.createDataFrame([("A", "a"), ("D", "b"), ("M", "gen/c"), ("R", "d"), ("M", "a")], "status string, path string")
    assert {r["path"] for r in text.changed(files, ["gen"]).collect()} == {"a", "d"}
    docs = spark.createDataFrame([("svc/catalog-info.yaml", "kind: x\nspec:\n  type: s\n  owner: 'team-a'\n"), ("catalog-info.yaml", "metadata:\n  owner: no\n")], "path string, value string")
    assert [tuple(r) for r in text.catalog_owner(docs).collect()] == [("svc", "team-a")]
