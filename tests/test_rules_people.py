"""Reports on small hand-made tables, with the values that their definitions give."""

from datetime import datetime, timedelta

import pytest

from kenmap.functions.patterns import attribute_regex, rule_regex
from kenmap.params import Params
from kenmap.plans import catalog
from kenmap.plans.engine import Engine

NOW = datetime(2026, 5, 28, 12)
PARAMS = Params(as_of="2026-05-28 12:00:00", removed="alice", target="src")
#: Every fact and step that a test may give, with its columns.
SCHEMAS = {
    "owners": "path string, author string, score double, rank int, status string, commits long, review double, age int",
    "ranked": "path string, author string, score double, rank int",
    "decay_warnings": "path string, author string, days long, status string",
    "path_summary": "path string, qualified_owners long, primary_owner string, decaying long, change_events long, cadence_days double, cochange_degree double",
    "pulls": "number long, reviewer string, opened timestamp, closed timestamp, lines int",
    "review_counts": "path string, author string, n long",
    "teams": "slug string, parent string", "team_members": "slug string, login string",
    "events_all": "path string, author string, sha string, ts timestamp", "extra_bots": "author string", "roster_status": "identity string, status string", "org_members": "login string",
    "tracked": "path string", "modifications": "sha string, path string",
    "declared": "path string, line_no int, owner string",
    "tiers": "path string, qualified_owners long, tier string",
    "removal": "path string, before_count long, after_count long",
    "base_primary": "path string, author string, score double, qualified_owners long",
    "attr_rules": "dir string, line int, rx string, attr string, value boolean", "owners_files": "dir string, owner string",
    "commits": "sha string, author string, ts timestamp, parents int, subject string",
    "contributions": "path string, author string, commits long, credit double, last_commit timestamp, last_sha string, later_commits long, cadence_days double",
    "drift_missing": "category string, path string, delta double, line_no int, qualified_owners long, decay boolean, overlap double", "drift_stale": "category string, path string, delta double, line_no int, qualified_owners long, decay boolean, overlap double",
    "drift_changed": "category string, path string, delta double, line_no int, qualified_owners long, decay boolean, overlap double", "criticality": "ord int, rx string, rule_rx string, weight double",
    "rules": "line_no int, pattern string, rx string, top string, supported boolean, owners string, source string",
    "import_edges": "dependent string, dependency string", "identities": "identity string, email string, name string",
    "overrides": "identity string, handle string", "hits": "identity string, handle string, source string", "separations": "a string, b string",
    "blobs": "path string, blob string", "blobs_before": "path string, blob string",
    "winners": "path string, line_no int, owners string", "findings": "rule string, path string, owners string, fingerprint string", "baseline": "rule string, path string, owners string", "suppressed": "rule string, path string",
    "blame_lines": "path string, author string, n_lines double", "blame_before": "path string, author string, n_lines double",
    "flags": "code string", "excluded_paths": "path string", "moves": "sha string, similarity int, old_path string, path string",
}


@pytest.fixture
def table(spark):
    def run(name, params=PARAMS, **rows):
        given = {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}
        return [tuple(r) for r in Engine(spark, catalog.OPERATORS, given, params, pinned=frozenset()).table(name).collect()]

    return run


def own(path, author, score, rank, status="stable", commits=1, review=None, age=1):
    return (path, author, score, rank, status, commits, review, age)


def days(n):
    return NOW - timedelta(days=n)


def test_the_successor_is_never_the_person_who_decays(table):
    owners = [own("src/a/x", "old", 0.9, 1, "inactive"), own("src/a/y", "old", 0.95, 1), own("src/a/y", "near", 0.4, 2), own("src/z", "far", 0.99, 1), own("lib/q", "other", 1.0, 1)]
    summary = [(p, 1, "x", 0, 1, None, None) for p in ("src/a/x", "src/a/y", "src/z", "lib/q")]
    assert table("transfers", owners=owners, path_summary=summary, decay_warnings=[("src/a/x", "old", 300, "inactive")]) == [("src/a/x", "old", "near")]


def test_review_bands_take_reviews_and_waiting(table):
    done = [(i, who, days(9), days(8), 1) for i, who in enumerate(["a"] * 8 + ["b"] + ["c"] * 2 + ["d"])]
    waiting = [(100 + i, who, days(3), None, 1) for i, who in enumerate(["c"] * 5)]
    assert {r[0]: r[4] for r in table("review_load", pulls=done + waiting)} == {"a": "high", "b": "low", "c": "high", "d": "low"}


def test_monopolies_need_72_percent_and_two_owners(table):
    owners = [own(p, a, 0.5, i + 1) for p in ("p", "q") for i, a in enumerate("xy")] + [own("r", "x", 0.5, 1)]
    counts = [("p", "x", 72), ("p", "y", 28), ("q", "x", 71), ("q", "y", 29), ("r", "x", 9)]
    assert table("review_monopolies", owners=owners, review_counts=counts) == [("p", "x", 0.72, 2)]


def test_teams_hold_the_members_of_all_teams_below_them_even_in_cycles(table):
    teams = [("top", None), ("mid", "top"), ("low", "mid"), ("c1", "c2"), ("c2", "c1")]
    got = set(table("team_closure", teams=teams, team_members=[("low", "ann"), ("mid", "bob"), ("c1", "cy")]))
    assert got == {("top", "ann"), ("top", "bob"), ("mid", "ann"), ("mid", "bob"), ("low", "ann"), ("c1", "cy"), ("c2", "cy")}


def test_status_comes_from_roster_bots_members_and_activity(table):
    people = {"@ros": 1, "dependabot@x": 1, "@member": 180, "@stranger": 1, "quiet": 181, "late": -5}
    got = dict(table("contributor_status", events_all=[("p", a, str(i), days(n)) for i, (a, n) in enumerate(people.items())], extra_bots=[], roster_status=[("ROS", "former")], org_members=[("Member",)]))
    assert got == {"@ros": "former", "dependabot@x": "bot", "@member": "active", "@stranger": "external", "quiet": "inactive", "late": "unknown"}


def test_bots_are_known_by_name_or_named(table):
    names = ["x[bot]", "BOT@a.b", "actions@github.com", "release-please@x", "renovate", "svc@x", "robot@x", "bob"]
    got = {r[0] for r in table("bot_authors", events_all=[("p", a, "1", NOW) for a in names], extra_bots=[("SVC@x",)])}
    assert got == set(names) - {"robot@x", "bob"}


def test_mechanical_authors_count_at_most_one(table):
    commits = [(str(i), "m", NOW, 1, f"Bump lib from 1.{i}.0 to deadbeef{i:02d}") for i in range(20)] + [(f"h{i}", "h", NOW, 1, f"work on {chr(97 + i)}") for i in range(20)]
    rows = [("p", a, 5, 5.0, NOW, "1", 0, None) for a in "mh"]
    assert {r[1]: r[3] for r in table("capped_contributions", commits=commits, contributions=rows)} == {"m": 1.0, "h": 5.0}


def test_mass_commits_modify_half_of_all_tracked_files(table):
    got = table("mass_commits", tracked=[(f"f{i}",) for i in range(10)], modifications=[("big", f"f{i}") for i in range(5)] + [("small", f"f{i}") for i in range(4)])
    assert got == [("big", 5)]


def test_one_common_person_aligns(table):
    owners = [own(p, a, 0.5, 1) for p, a in (("a", "Ann"), ("b", "ann"), ("c", "ann"), ("d", "bob"))]
    got = table("assessment", owners=owners, path_summary=[(p, 1, "x", 0, 1, None, None) for p in "abcde"], declared=[("a", 1, "ann"), ("a", 1, "zoe"), ("b", 1, "zoe"), ("c", 2, "org/core")], teams=[("core", None)], team_members=[("core", "ANN")])
    assert dict(got) == {"a": "aligned", "b": "diverged", "c": "aligned", "d": "unverifiable", "e": "unverifiable"}


def test_backups_fall_back_to_the_whole_repository(table):
    owners = [own("root", "a", 0.9, 1), own("src/x", "b", 0.8, 1), own("src/y", "c", 0.7, 1), own("src/y", "a", 0.6, 2)]
    got = {(r[0], r[1]) for r in table("backups", owners=owners, tiers=[("root", 1, "critical"), ("src/x", 1, "critical"), ("src/y", 2, "ok")])}
    assert got == {("root", "b"), ("root", "c"), ("src/x", "c"), ("src/x", "a")}


def test_orphaned_directories_are_the_topmost_at_any_depth(table):
    removal = [("a/b/c/d", 1, 0), ("a/b/c/e", 1, 0), ("a/b/f", 1, 0), ("a/g", 2, 1), ("h/i", 1, 0), ("j", 1, 0)]
    assert set(table("orphaned_directories", removal=removal)) == {("a/b", 3), ("h", 1)}


@pytest.mark.parametrize("paths,want", [
    (["a/b/x", "a/b/y", "a/c"], {("/a/", 3)}),
    (["a/x", "b/y"], {("*", 2)}),
    (["a/x"], {("/a/x", 1)}),
])
def test_rules_are_put_at_the_shortest_uniform_directory(table, paths, want):
    assert {(r[0], r[2]) for r in table("consolidated", owners=[own(p, "u", 0.5, 1) for p in paths])} == want


def test_mixed_directories_split_at_any_depth(table):
    owners = [own("a/b/c/x", "u", 0.5, 1), own("a/b/c/y", "u", 0.5, 1), own("a/b/z", "v", 0.5, 1), own("q", "v", 0.5, 1)]
    assert {(r[0], r[1]) for r in table("consolidated", owners=owners)} == {("/a/b/c/", "u"), ("/a/b/z", "v"), ("/q", "v")}


def test_regressions_lose_owners_and_have_few_left(table):
    base = [("lost", "a", 0.5, 2), ("many", "a", 0.5, 4), ("moved", "a", 0.5, 1), ("same", "a", 0.5, 1), ("gone", "a", 0.5, 1)]
    owners = [own("lost", "a", 0.5, 1), *(own("many", f"p{i}", 0.5 - i / 100, i + 1) for i in range(3)), own("moved", "b", 0.5, 1), own("same", "A", 0.5, 1), own("new", "c", 0.5, 1)]
    assert {r[0]: r[5] for r in table("change_report", base_primary=base, owners=owners)} == {"lost": "regression", "many": "shift", "moved": "shift", "same": "single", "gone": "regression", "new": "new"}


def test_drift_takes_the_largest_weight_of_the_entrys_own_path(table):
    weights = [(i, "x", rule_regex(p), w) for i, (p, w) in enumerate((("/src/", 0.5), ("*.py", 0.9), ("/doc/", 0.4)))]
    row = lambda c, p: (c, p, 0.4, None, 1, False, 0.0)
    got = table("drift", drift_missing=[row("missing", "src/a.py")], drift_stale=[], drift_changed=[row("changed", "doc/x")], criticality=weights)
    assert {r[1]: (r[7], round(r[8], 4), r[9]) for r in got} == {"src/a.py": (0.9, round(0.4 + 0.1 + 0.135 + 0.05, 4), "high"), "doc/x": (0.4, round(0.4 + 0.1 + 0.06 + 0.05, 4), "high")}


def test_pairs_add_owners_reviews_and_directories(table):
    owners = [own("s/a", "x", 0.8, 1, review=0.5), own("s/a", "y", 0.6, 2, review=0.2), own("s/t/b", "x", 0.9, 1), own("root", "y", 0.9, 1)]
    assert table("pair_weights", owners=owners) == [("x", "y", pytest.approx(0.6 + 0.2 + 0.25))]


def test_attributes_and_owners_files_of_deeper_directories_win(table):
    rules = [("", 1, attribute_regex("*.js"), "linguist-generated", True), ("web", 1, attribute_regex("*.js"), "linguist-generated", False), ("web/dist", 1, attribute_regex("*"), "linguist-vendored", True)]
    tracked = [("a.js",), ("web/b.js",), ("web/dist/c.css",), ("d.py",)]
    assert {r[0] for r in table("linguist_excluded", tracked=tracked, attr_rules=rules)} == {"a.js", "web/dist/c.css"}
    assert set(table("nearest_owners", tracked=tracked, owners_files=[("", "r"), ("web", "w1"), ("web", "w2")])) == {("a.js", "", "r"), ("d.py", "", "r"), *((p, "web", o) for p in ("web/b.js", "web/dist/c.css") for o in ("w1", "w2"))}


def test_truck_factors_remove_the_widest_owner_first(table):
    owners = [own(f"p{i}", "a", 0.5, 1) for i in range(6)] + [own(f"p{i}", "b", 0.4, 2) for i in range(4)] + [own(f"q{i}", "c", 0.5, 1) for i in range(4)]
    assert dict(table("repo_truck_factors", owners=owners)) == {0.5: 2, 0.75: 2, 0.9: 1}


def test_manifests(table):
    names = ["Dockerfile", "x/Procfile", "infra/a.tf", "docker-compose.prod.yml", "compose.yaml", "composer.yml", "k8s/a.txt", "deploy/x", "deployment/x", "Dockerfile.md", "src/compose.py"]
    assert {r[0] for r in table("manifests", tracked=[(n,) for n in names])} == {"Dockerfile", "x/Procfile", "infra/a.tf", "docker-compose.prod.yml", "compose.yaml", "k8s/a.txt", "deploy/x"}


def test_handles_come_from_overrides_hits_and_noreply_addresses(table):
    people = [("ann", "ann@x.org", "Ann"), ("bob", "7+bobby@users.noreply.host", "Bob"), ("cy", "cy@x.org", "Cy"), ("dee", "dee@x.org", "Dee"), ("eve", "eve@x.org", "Eve")]
    rows = dict(identities=people, overrides=[("ANN", "@a"), ("eve", "@a")], hits=[("ann", "@no", "commit"), ("cy", "@c", "search")], separations=[])
    assert {r[0]: (r[1], r[2], r[3]) for r in table("resolved", **rows)} == {"ann": ("@a", "override", 1.0), "bob": ("bobby", "noreply", 1.0), "cy": ("@c", "search", 0.5), "dee": (None, "none", 0.75), "eve": ("@a", "override", 1.0)}
    assert table("merges", **rows) == [("@a", "ann", "eve", "override")] and table("merges", **rows | {"separations": [("Eve", "ann")]}) == []


def test_gaps_are_listed_once_in_order(table):
    rows = dict(flags=[("missing_mailmap",), ("absent_token",), ("absent_token",)], events_all=[], review_counts=[], team_members=[("t", "x")], identities=[], excluded_paths=[("x",)], moves=[])
    assert [r[1] for r in sorted(table("gap_list", **rows))] == ["insufficient_history", "absent_token", "review_history", "excluded_files", "missing_mailmap"]
    assert table("completeness", **rows) == [(round(8 / 13, 4), 5)]


def test_reuse_needs_the_same_blob(table):
    got = table("dirty_paths", blobs=[("a", "1"), ("b", "2"), ("c", "3")], blobs_before=[("a", "1"), ("b", "9"), ("z", "1")])
    assert set(got) == {("a", "reused"), ("b", "changed"), ("c", "new")}


def test_team_drift_statuses(table):
    rule = lambda n, owners: (n, f"/{n}/", "x", None, True, owners, "generated")
    rules = [rule(1, "org/Core,Dora"), rule(2, "org/none"), rule(3, "org/top"), rule(4, "org/void"), rule(5, "org/core")]
    seen = {1: ("ann", "Dora", "eve"), 2: ("ann",), 3: ("cy",), 4: ("ann",), 5: ("Ann", "bob")}
    rows = table(
        "team_drift", rules=rules, teams=[("core", None), ("top", None), ("low", "top"), ("void", None)], team_members=[("core", "ANN"), ("core", "bob"), ("low", "cy")],
        winners=[(f"{n}/f", n, "") for n in seen], owners=[own(f"{n}/f", a, 0.9, k + 1) for n, people in seen.items() for k, a in enumerate(people)],
    )
    assert set(rows) == {
        (1, "org/core", "partial-drift", 0.6667, "bob", "eve"), (2, "org/none", "invisible", None, "", ""), (3, "org/top", "nested", 1.0, "", ""),
        (4, "org/void", "empty", 0.0, "", "ann"), (5, "org/core", "aligned", 1.0, "", ""),
    }


def test_an_accepted_finding_is_new_when_its_owners_change(table):
    found = [("changed-drift", "/a/", "x,y", "1"), ("changed-drift", "/b/", "x", "2"), ("single-expert", "c", "", "3"), ("single-expert", "d", "", "4")]
    accepted = [("changed-drift", "/a/", "x,y"), ("changed-drift", "/b/", "z"), ("single-expert", "c", ""), ("single-expert", "gone", "")]
    given = dict(findings=found, baseline=accepted, suppressed=[("single-expert", "d")])
    assert table("new_findings", **given) == [("changed-drift", "/b/", "x", "2")]
    assert set(table("settled_findings", **given)) == {("changed-drift", "/b/", "z"), ("single-expert", "gone", "")}


def test_findings_sort_their_owners(table):
    drift = dict(drift_changed=[("changed", "/a/", 0.5, 1, 1, False, 0.0)], drift_missing=[], drift_stale=[], criticality=[])
    rules = [(1, "/a/", "x", None, True, "Zoe,Ann", "generated")]
    assert [r[:3] for r in table("findings", rules=rules, tiers=[], tracked=[("a/f",)], **drift)] == [("changed-drift", "/a/", "ann,zoe")]


def test_reused_paths_keep_the_shares_of_the_run_before(table):
    rows = table("mixed_blame", blobs=[("same", "1"), ("new", "2"), ("changed", "3")], blobs_before=[("same", "1"), ("changed", "0")],
                 blame_lines=[("same", "ann", 1.0), ("new", "ann", 3.0), ("new", "bob", 1.0), ("changed", "bob", 2.0)], blame_before=[("same", "ann", 1.0), ("same", "bob", 3.0), ("changed", "ann", 9.0)])
    assert set(rows) == {("same", "ann", 0.25, "reused"), ("same", "bob", 0.75, "reused"), ("new", "ann", 0.75, "new"), ("new", "bob", 0.25, "new"), ("changed", "bob", 1.0, "changed")}
