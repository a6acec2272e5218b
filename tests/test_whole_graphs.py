"""Whole-graph operators and chains of moves against plain searches, on random and hand-made graphs."""

import random

import pytest

from kenmap.operators import components, graphs, moves


def frame(spark, edges):
    return spark.createDataFrame(edges, "a string, b string")


def plain_components(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        todo = [n]
        while todo:
            m = todo.pop()
            if m not in out:
                out[m] = n
                todo += near[m]
    return out


def random_edges(seed, nodes, count):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for _ in range(count)]


def reached(edges, start):
    seen, todo = set(), [b for a, b in edges if a == start]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for a, b in edges if a == n]
    return seen


@pytest.fixture(scope="module")
def forest_of_graphs():
    """Several random graphs as one: their nodes carry a number in front."""
    sizes = [(6, 5), (8, 8), (10, 9), (12, 12), (9, 14), (15, 16), (20, 22), (30, 30), (5, 10), (25, 26)]
    return [(f"{i}-{a}", f"{i}-{b}") for i, (n, m) in enumerate(sizes) for a, b in random_edges(i, n, m)] + [("chain0", "chain1"), ("chain1", "chain2"), ("chain2", "chain3"), ("chain3", "chain4"), ("chain4", "chain4")]


def test_connected(spark, forest_of_graphs):
    plain = [(a, b) for a, b in forest_of_graphs if a != b]
    assert {tuple(r) for r in components.connected(frame(spark, forest_of_graphs)).collect()} == set(plain_components(plain).items())
    alone = components.connected(frame(spark, []), spark.createDataFrame([("x",)], "node string"))
    assert [tuple(r) for r in alone.collect()] == [("x", "x")]


def test_cuts_and_blocks(spark, forest_of_graphs):
    plain = [(a, b) for a, b in forest_of_graphs if a != b]
    sides = components.blocks(frame(spark, forest_of_graphs)).collect()
    held = {}
    for r in sides:
        held.setdefault(r["a"], set()).add(r["block"])
        held.setdefault(r["b"], set()).add(r["block"])
    assert {n for n in held if len(held[n]) > 1} == graphs.articulation(plain)
    # two edges at a node lie in one block exactly where their other ends stay connected without the node
    block = {frozenset((r["a"], r["b"])): r["block"] for r in sides}
    assert block.keys() == {frozenset(e) for e in plain}
    for n in sorted({x for e in plain for x in e}):
        left = plain_components([e for e in plain if n not in e])
        ends = [next(iter(e - {n})) for e in block if n in e]
        for x in ends:
            for y in ends:
                assert (block[frozenset((n, x))] == block[frozenset((n, y))]) == (left.get(x, x) == left.get(y, y)), (n, x, y)


def test_knowledge_cuts_over_directories(spark):
    owners = [("a/x", "ann"), ("a/y", "ann"), ("a/y", "bob"), ("b/u/p", "bob"), ("b/u/p", "cid"), ("c/q", "cid"), ("c/q", "dan"), ("c/r", "dan"), ("c/q2", "cid"), ("c/q2", "dan"), ("z", "dan"), ("solo/1", "eve")]
    rows = {r["person"]: (r["pieces"], r["directories"]) for r in components.knowledge_cuts(spark.createDataFrame(owners, "path string, author string")).collect()}
    assert rows == {"ann": (2, "a"), "bob": (2, "a,b/u"), "cid": (2, "b/u,c"), "dan": (3, "c")}
    plain = graphs.articulation([(f"person:{a}", f"path:{p}") for p, a in owners])
    assert {f"person:{p}" for p in rows} == {n for n in plain if n.startswith("person:")}
    assert components.knowledge_cuts(spark.createDataFrame([], "path string, author string")).count() == 0


def test_ranks_and_strong_components(spark):
    edges = [(f"{i}-{a}", f"{i}-{b}") for i, (n, m) in enumerate([(6, 7), (10, 14), (12, 10), (20, 24)]) for a, b in random_edges(50 + i, n, m)]
    edges += [("p", "q"), ("q", "p"), ("q", "between"), ("between", "r"), ("r", "s"), ("s", "t"), ("t", "r"), ("behind", "p"), ("leaf", "leaf")]
    plain = [e for e in edges if e[0] != e[1]]
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    got = {r["node"]: r for r in components.ranked(frame(spark, edges), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    levels, cyclic = graphs.topological_ranks(plain, nodes)
    assert {n for n in nodes if got[n]["cyclic"]} == set(cyclic) == {n for n in nodes if n in reached(plain, n)}
    assert {n: got[n]["level"] for n in levels} == levels and {got[n]["level"] for n in nodes if n not in levels} == {max(levels.values()) + 1}
    for n in cyclic:
        assert got[n]["cycle"] == min(m for m in reached(plain, n) if n in reached(plain, m))
    assert got["between"]["cyclic"] is False and got["behind"]["cyclic"] is False and got["leaf"]["level"] == 0
    empty = components.ranked(frame(spark, []), spark.createDataFrame([("x",)], "node string")).collect()
    assert [tuple(r) for r in empty] == [("x", 0, False, None)]


def test_a_level_is_written_once(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(components, "written", lambda df: sizes.append(df.count()) or df.localCheckpoint())
    chain = [(f"n{i + 1}", f"n{i}") for i in range(6)]
    flat, rest = components.layers(frame(spark, [*chain, ("x", "y"), ("y", "x")]), spark.createDataFrame([(f"n{i}",) for i in range(7)] + [("x",), ("y",)], "node string"))
    assert {r["node"]: r["level"] for r in flat.collect()} == {f"n{i}": i for i in range(7)} and rest.count() == 2
    assert sizes == [8, 9, 8, 7, 6, 5, 4, 3, 2, 7]  # edges, then what waits, round by round, then the levels


def plain_living(touches, history):
    """The files one after the other, commit after commit."""
    steps = sorted({m[0] for m in history})
    file_at, path_of, fresh, out = {}, {}, iter(range(10**6)), {}
    for t in sorted({*steps, *(o for _, o in touches)}):
        now = [m for m in history if m[0] == t]
        taken = {s: file_at.get(s) for _, _, s, _ in now}
        for _, _, source, _ in now:
            file_at.pop(source, None)
        for _, kind, source, dest in now:
            if kind == "R":
                if dest in file_at:
                    path_of[file_at.pop(dest)] = None
                file_at[dest] = taken[source] if taken[source] is not None else next(fresh)
                path_of[file_at[dest]] = dest
            elif taken[source] is not None:
                path_of[taken[source]] = None
        for p in {p for p, o in touches if o == t}:
            if p not in file_at:
                file_at[p] = next(fresh)
                path_of[file_at[p]] = p
            out[p, t] = file_at[p]
    return {k: path_of[f] for k, f in out.items()}


def test_chains_swaps_cycles_and_reuse(spark):
    history = [(10, "R", "a", "b"), (20, "R", "b", "c"), (30, "R", "c", "d"), (40, "R", "d", "e"), (50, "R", "e", "f"), (25, "R", "s", "t"), (25, "R", "t", "s"), (35, "R", "u", "v"), (45, "R", "v", "u"), (15, "D", "x", None), (55, "R", "y", "z")]
    touches = [("a", 1), ("b", 10), ("c", 21), ("f", 60), ("a", 33), ("s", 5), ("t", 5), ("s", 25), ("u", 1), ("v", 40), ("u", 50), ("x", 3), ("x", 20), ("z", 2), ("y", 2), ("q", 9)]
    got = moves.living(spark.createDataFrame(touches, "path string, ord long"), spark.createDataFrame(history, "ord long, kind string, source string, dest string"))
    rows = {(r["path"], r["ord"]): r["living"] for r in got.collect()}
    assert rows == {("a", 1): "f", ("b", 10): "f", ("c", 21): "f", ("f", 60): "f", ("a", 33): "a", ("s", 5): "t", ("t", 5): "s", ("s", 25): "s", ("u", 1): "u", ("v", 40): "u", ("u", 50): "u", ("x", 3): None, ("x", 20): "x", ("z", 2): None, ("y", 2): "z", ("q", 9): "q"}
    assert rows == plain_living(touches, history)


def test_random_histories(spark):
    rng, history, touches, alive = random.Random(8), [], [], {"p0"}
    for t in range(1, 120):
        path = f"p{rng.randrange(12)}"
        if rng.random() < 0.5:
            touches.append((path, t))
            alive.add(path)
        elif path in alive:
            dest = f"p{rng.randrange(12)}"
            if rng.random() < 0.15:
                history.append((t, "D", path, None))
                alive.discard(path)
            elif dest != path:
                history.append((t, "R", path, dest))
                alive.discard(path)
                alive.add(dest)
    got = moves.living(spark.createDataFrame(touches, "path string, ord long"), spark.createDataFrame(history, "ord long, kind string, source string, dest string"))
    assert {(r["path"], r["ord"]): r["living"] for r in got.collect()} == plain_living(touches, history)


def test_moves_change_contributions_and_scores(spark, sf):
    from kenmap.plans import extras

    own = extras._renamed(spark, sf)
    assert own.table("events_all").where("path like 'old/%' or path like 'mid/%'").join(own.table("path_moves").selectExpr("source as path"), "path", "left_semi").count() == 0
    assert own.table("events_all").select("path").distinct().count() < own.table("touches").select("path").distinct().count()


def test_shortest_chains(spark, forest_of_graphs):
    plain = [(a, b) for a, b in forest_of_graphs if a != b]
    nodes = sorted({x for e in plain for x in e})
    rng = random.Random(2)
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)] + [("chain0", "chain4"), ("chain4", "chain0"), ("7-n00", "7-n00")]
    got = {(r["start"], r["goal"]): (r["hops"], r["chain"]) for r in components.shortest(frame(spark, plain), spark.createDataFrame(pairs, "start string, goal string")).collect()}
    both = {*plain, *((b, a) for a, b in plain)}
    for a, b in set(pairs):
        if a == b:
            continue
        want = graphs.shortest_path(plain, a, b)
        if not want:
            assert (a, b) not in got
            continue
        hops, chain = got[a, b]
        assert hops == len(want) - 1 == len(chain) - 1 and chain[0] == a and chain[-1] == b and all((x, y) in both for x, y in zip(chain, chain[1:]))


def test_knowledge_chains_cross_directories(spark):
    owners = spark.createDataFrame([("a/x", "ann"), ("a/x", "bob"), ("a/w", "ann"), ("a/w", "bob"), ("b/y", "bob"), ("b/y", "cid"), ("c/z", "dan")], "path string, author string")
    rows = components.knowledge_chains(owners, spark.createDataFrame([("ann", "cid"), ("ann", "dan")], "author string, successor string")).collect()
    assert [tuple(r) for r in rows] == [("ann", "cid", 4, "person:ann,path:a/w,person:bob,path:b/y,person:cid")]


def test_betweenness_with_twins_and_leaves(spark):
    rng = random.Random(12)
    owners = sorted({(f"{g}/p{i}", f"{g}-a{rng.randrange(6)}") for g in range(2) for i in range(25) for _ in range(rng.choice([1, 1, 2, 3]))} | {("0/p0", "bridge"), ("1/p0", "bridge")})
    want = graphs.betweenness([(f"person:{a}", f"path:{p}") for p, a in owners])
    people = sorted(((round(v, 9), k[7:]) for k, v in want.items() if k.startswith("person:") and v > 1e-12), key=lambda x: (-x[0], x[1]))
    df = spark.createDataFrame(owners, "path string, author string")
    got = [(r["person"], r["score"]) for r in components.knowledge_betweenness(df, 30, batch=20).collect()]
    assert [p for p, _ in got] == [p for _, p in people] and [s for _, s in got] == pytest.approx([v for v, _ in people], abs=5.1e-5)
    assert components.knowledge_betweenness(df.limit(0)).count() == 0


def test_all_below_any_depth_and_cycles(spark):
    tree = [(f"t{i}", f"t{i - 1}" if i else None) for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "x")]
    got = {tuple(r) for r in components.below(spark.createDataFrame(tree, "node string, parent string")).collect()}
    assert got == {(f"t{i}", f"t{j}") for i in range(40) for j in range(i, 40)} | {(a, b) for a in "xy" for b in "xyz"} | {("z", "z")}


def test_parameters_beyond_the_defaults(spark, sf):
    from kenmap.params import Params
    from kenmap.plans import catalog

    own = catalog.engine(spark, sf, Params(top_n=5, periods=9))
    assert own.table("leaders").count() == 8 and own.table("periods").count() == 9
