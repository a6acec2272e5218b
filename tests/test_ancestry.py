"""Chains and ancestry of commits against plain walks."""

import random

import pytest

from kenmap.operators import ancestry, graphs


def plain(edges, pairs):
    out = set()
    for repo, a, b in pairs:
        parents = {}
        for r, sha, parent in edges:
            if r == repo:
                parents.setdefault(sha, []).append(parent)
        one, two = graphs.reachable(parents, [a]), graphs.reachable(parents, [b])
        out.add((repo, a, b, len(one - two), len(two - one), a in two, ",".join(graphs.merge_bases(parents, a, b))))
    return out


def found(spark, edges, pairs):
    rows = ancestry.commit_graph(spark.createDataFrame(edges, "repo string, sha string, parent string"), spark.createDataFrame(pairs, "repo string, a string, b string")).collect()
    assert len(rows) == len({(r["repo"], r["a"], r["b"]) for r in rows})
    return set(map(tuple, rows))


def test_random_histories_equal_walks(spark):
    edges, pairs = [], []
    for seed in range(12):
        rng, repo = random.Random(seed), f"r{seed}"
        n = rng.randrange(2, 26)
        edges += [(repo, f"c{i:02d}", f"c{p:02d}") for i in range(1, n) for p in set(rng.sample(range(i), min(i, rng.choice((0, 1, 1, 1, 2, 3)))))]
        pairs += [(repo, f"c{rng.randrange(n):02d}", f"c{rng.randrange(n):02d}") for _ in range(15)]
    assert found(spark, edges, pairs) == plain(edges, pairs)


def test_hand_made_histories(spark):
    # Two branches that took each other's commits have two bases; a long line is one chain; a repository and a commit without edges stand alone.
    edges = [("x", a, b) for a, b in (("l1", "o"), ("r1", "o"), ("l2", "l1"), ("l2", "r1"), ("r2", "r1"), ("r2", "l1"))] + [("line", f"{i:03d}", f"{i - 1:03d}") for i in range(1, 200)]
    pairs = [("x", "l2", "r2"), ("x", "o", "r2"), ("x", "l2", "l2"), ("x", "l2", "nowhere"), ("line", "000", "199"), ("line", "150", "020"), ("empty", "p", "q"), ("empty", "p", "p")]
    rows = found(spark, edges, pairs)
    assert rows == plain(edges, pairs)
    assert ("x", "l2", "r2", 1, 1, False, "l1,r1") in rows and ("line", "000", "199", 0, 199, True, "000") in rows and ("empty", "p", "q", 1, 1, False, "") in rows


def test_awkward_rows(spark):
    edges = [("x", "b", "a"), ("x", "b", "a"), ("x", "b", None), (None, "b", "a"), ("x", None, "a"), ("x", "a", "a")]
    assert found(spark, edges, [("x", "a", "b"), ("x", "a", "b"), ("x", None, "b"), (None, "a", "b")]) == {("x", "a", "b", 0, 1, True, "a")}
    assert found(spark, [], []) == set()
    with pytest.raises(ValueError):
        found(spark, [("x", "a", "b"), ("x", "b", "a")], [("x", "a", "b")])


def test_chains_follow_first_parents_that_go_on(spark):
    edges = spark.createDataFrame([("x", "2", "1", 0), ("x", "3", "2", 0), ("x", "3", "a", 1), ("x", "a", "1", 0)], "repo string, sha string, parent string, nth int")
    placed = {r["sha"]: (r["chain"], r["pos"]) for r in ancestry.chains(edges).collect()}
    assert placed == {"1": ("1", 0), "2": ("1", 1), "3": ("1", 2), "a": ("a", 0)}
    assert [tuple(r) for r in ancestry.crossings(edges, ancestry.chains(edges)).orderBy("chain", "to_chain").collect()] == [("x", "1", 2, "a", 0), ("x", "a", 0, "1", 0)]


def test_no_table_as_large_as_the_history_is_broadcast(spark):
    edges = spark.createDataFrame([("r", str(i), str(i - 1)) for i in range(1, 9)] + [("r", "8", "5")], "repo string, sha string, parent string")
    found = ancestry.commit_graph(edges, spark.createDataFrame([("r", "3", "8")], "repo string, a string, b string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["ahead"], r["behind"], r["is_ancestor"]) for r in found.collect()] == [(0, 5, True)]
