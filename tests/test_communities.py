"""Communities by levels against plain measures of modularity, and teams against clusters."""

import random
from collections import Counter, defaultdict

import pytest

from kenmap.operators import communities


def plain_modularity(weights, home):
    total, degree, inside = 2 * sum(weights.values()), Counter(), Counter()
    for (a, b), w in weights.items():
        degree[home[a]] += w
        degree[home[b]] += w
        if home[a] == home[b]:
            inside[home[a]] += 2 * w
    return sum(inside[c] / total - (degree[c] / total) ** 2 for c in degree)


def cliques(seed, groups, size):
    rng, weights = random.Random(seed), defaultdict(float)
    people = [[f"p{g}{i}" for i in range(size)] for g in range(groups)]
    for g in people:
        for i, a in enumerate(g):
            for b in g[i + 1 :]:
                if rng.random() < 0.8:
                    weights[a, b] += rng.randint(1, 8) / 2
    for _ in range(groups * 3):
        a, b = rng.choice(rng.choice(people)), rng.choice(rng.choice(people))
        if a != b:
            weights[min(a, b), max(a, b)] += 0.5
    return dict(weights)


def levels_of(spark, weights):
    pairs = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "a string, b string, weight double")
    found = communities.levels(pairs)
    by_level = defaultdict(dict)
    for r in found.collect():
        by_level[r["level"]][r["person"]] = r["community"]
    return pairs, found, by_level


def test_levels_grow_in_modularity_and_leave_no_better_move(spark):
    weights = cliques(3, 5, 6)
    pairs, found, by_level = levels_of(spark, weights)
    people = {p for e in weights for p in e}
    assert all(h.keys() == people and all(h[c] == c == min(p for p in h if h[p] == c) for c in h.values()) for h in by_level.values())
    measured = {r["level"]: (r["communities"], r["modularity"]) for r in communities.modularity(pairs, found).collect()}
    values = [plain_modularity(weights, by_level[k]) for k in sorted(by_level)]
    assert [measured[k][1] for k in sorted(measured)] == pytest.approx(values) and all(a < b for a, b in zip(values, values[1:]))
    assert [measured[k][0] for k in sorted(measured)] == [len(set(by_level[k].values())) for k in sorted(by_level)]
    first = by_level[1]
    for p in people:  # of the first level no person moves to advantage
        for c in set(first.values()):
            assert plain_modularity(weights, first | {p: c}) <= values[0] + 1e-7
    last = by_level[max(by_level)]
    for c in set(last.values()):  # and of the last no community joins another
        for d in set(last.values()):
            assert plain_modularity(weights, {p: d if h == c else h for p, h in last.items()}) <= values[-1] + 1e-7
    for low, high in zip(sorted(by_level), sorted(by_level)[1:]):  # levels nest
        assert len({(by_level[low][p], by_level[high][p]) for p in people}) == len(set(by_level[low].values()))


def test_two_cliques_and_a_star(spark):
    weights = {(a, b): 1.0 for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]} | {("d", "w"): 0.1}
    _, _, by_level = levels_of(spark, weights)
    assert set(by_level[max(by_level)].values()) == {"a", "w"}
    _, _, star = levels_of(spark, {("hub", f"s{i}"): 1.0 for i in range(12)})
    assert set(star[max(star)].values()) == {"hub"}
    _, found, _ = levels_of(spark, {})
    assert found.count() == 0


def test_clusters_and_teams(spark):
    pairs = [("a", "b", 2.0), ("b", "c", 2.0), ("a", "c", 2.0), ("x", "y", 2.0), ("y", "z", 2.0), ("x", "z", 2.0), ("c", "x", 1.0), ("c", "y", 1.2)]
    weights = spark.createDataFrame(pairs, "a string, b string, weight double")
    two = spark.createDataFrame([(1, p, "a" if p in "abc" else "x") for p in "abcxyz"], "level long, person string, community string")
    teams = spark.createDataFrame([("same", "X"), ("same", "@y"), ("same", "z"), ("same", "C"), ("half", "a"), ("half", "b"), ("half", "q"), ("far", "q"), ("far", "r")], "slug string, login string")
    found = communities.clusters(weights, two, teams)
    rows = {r["name"]: (r["declared"], r["parent"], r["members"], r["affiliated"]) for r in found.collect()}
    assert rows == {"inferred-0": (False, "", "a,b,c", ""), "same": (True, "", "x,y,z", "c")}
    compared = {r["team"]: tuple(r)[1:] for r in communities.team_comparisons(found, teams).collect()}
    assert compared["same"] == ("same", 1.0, 1.0, 1.0, 1.0, "")
    assert compared["half"] == ("inferred-0", 0.5, 0.6667, 0.6667, 0.6667, "c")
    assert compared["far"] == ("inferred-0", 0.0, 0.0, 0.0, 0.0, "a,b,c")
    nested = two.union(spark.createDataFrame([(2, p, "a") for p in "abcxyz"], "level long, person string, community string"))
    assert {r["parent"] for r in communities.clusters(weights, nested, teams).collect()} == {"parent-0"}
    assert communities.team_comparisons(found.limit(0), teams).where("cluster <> '' or overlap > 0").count() == 0
