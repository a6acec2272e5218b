"""Whole-graph operators as rounds of joins: connected, biconnected and strongly connected components.

No step holds a graph, a node's edges or a component in one task: a round is a join on a node's name and an aggregate that
sums partially before it shuffles.  Each round's small state is written to the checkpoint folder and read again, so plans stay short and lost
executors cost a round at most.  Rounds end when nothing is new; none has a number of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kenmap.plans.storage import written

#: A node's children are numbered in so many parts, so a node of very many children is not one task's.
PARTS = 64


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst of an undirected graph's edges (a, b) in both directions, each once, no loops."""
    plain = edges.where("a <> b").select("a", "b")
    return plain.union(plain.select("b", "a")).distinct().toDF("src", "dst")


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node) of an undirected graph (a, b); ``nodes`` (node) adds nodes without edges.

    Every node points to a smaller node of its component or to itself.  A round lets the node that each node points to, and the node itself, take the
    smallest grandparent among the neighbours, and follows pointers twice; the number of rounds is about the logarithm of the nodes.
    """
    near = written(both_ways(edges))
    names = near.select(F.col("src").alias("node"))
    names = (names if nodes is None else names.union(nodes.select("node"))).distinct()
    state = written(names.select("node", F.col("node").alias("up"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        above = state.alias("s").join(state.alias("t"), F.col("s.up") == F.col("t.node")).select(F.col("s.node"), F.col("s.up"), F.col("t.up").alias("grand"))
        lowest = near.join(above.select(F.col("node").alias("dst"), "grand"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("grand").alias("least"))
        seen = above.join(lowest, "node", "left").withColumn("least", F.expr("least(grand, coalesce(least, grand))"))
        offers = seen.selectExpr("node", "least as up", "up as old").union(seen.selectExpr("up", "least", "null"))
        state = written(offers.groupBy("node").agg(F.min("up").alias("up"), F.max("old").alias("old")).selectExpr("node", "up", "up <> old as moved"))
    return state.select("node", F.col("up").alias("component"))


def forest(edges: DataFrame) -> DataFrame:
    """node, parent (null at the root), depth: a breadth-first tree of each component of an undirected graph (a, b), rooted in its smallest node.

    A level is a join of the level before with the edges; what it finds lies in the two levels before or is new, so only those are compared.
    """
    near = written(both_ways(edges))
    level = written(connected(edges).select(F.col("component").alias("node")).distinct().select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")))
    whole, before = level, level.limit(0)
    while not level.isEmpty():
        reached = level.select(F.col("node").alias("src"), "depth").join(near, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"), F.max(F.col("depth") + 1).alias("depth"))
        before, level = level, written(reached.join(level.select("node").union(before.select("node")), "node", "left_anti"))
        whole = whole.unionByName(level)
    return written(whole)


def _upward(tree: DataFrame, values: dict[str, str]) -> DataFrame:
    """node and ``values`` (column: sum, min or max), each aggregated over the node and all below it, by pointers that double their reach."""
    state = written(tree.select("node", F.col("parent").alias("jump"), *values))
    fold = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b)}
    while not state.where("jump is not null").isEmpty():
        given = state.where("jump is not null").groupBy("jump").agg(*[getattr(F, how)(c).alias(f"below_{c}") for c, how in values.items()]).withColumnRenamed("jump", "node")
        further = state.where("jump is not null").select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        joined = state.join(given, "node", "left").join(further, "jump", "left")
        state = written(joined.select("node", F.col("next").alias("jump"), *[fold[how](F.col(c), F.col(f"below_{c}")).alias(c) for c, how in values.items()]))
    return state.drop("jump")


def numbered(tree: DataFrame) -> DataFrame:
    """``tree`` with size (nodes of the subtree) and pre (place in a walk that takes a node before its subtree, from 0 in each tree): a subtree is [pre, pre + size)."""
    sized = written(tree.join(_upward(tree.withColumn("size", F.lit(1).cast("long")), {"size": "sum"}), "node"))
    children = sized.where("parent is not null").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    parts = children.groupBy("parent", "part").agg(F.sum("size").alias("whole"))
    parts = parts.withColumn("ahead", F.expr("coalesce(sum(whole) over (partition by parent order by part rows between unbounded preceding and 1 preceding), 0)"))
    inside = children.withColumn("inside", F.expr("coalesce(sum(size) over (partition by parent, part order by node rows between unbounded preceding and 1 preceding), 0)"))
    steps = inside.join(parts.select("parent", "part", "ahead"), ["parent", "part"]).select("node", (1 + F.col("ahead") + F.col("inside")).alias("step"))
    state = written(sized.join(steps, "node", "left").select("node", F.col("parent").alias("jump"), F.coalesce("step", F.lit(0)).alias("pre")))
    while not state.where("jump is not null").isEmpty():
        above = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("pre").alias("more"))
        state = written(state.join(above, "jump", "left").select("node", F.col("next").alias("jump"), (F.col("pre") + F.coalesce("more", F.lit(0))).alias("pre")))
    return written(sized.join(state.select("node", "pre"), "node"))


def blocks(edges: DataFrame) -> DataFrame:
    """a, b, block: the biconnected component of each edge of an undirected graph (a, b), by the method of Tarjan and Vishkin.

    With the preorder numbers of a spanning forest, low and high of a node are the least and greatest number next to its subtree by edges outside the tree.
    Tree edges (named by their lower node) belong together where an edge joins two subtrees of which neither holds the other, or where the edges out of a subtree leave
    the subtree of its parent; the connected components of that relation are the blocks, and any other edge lies in the block of the node with the later number.
    """
    tree = numbered(forest(edges))
    place = tree.select("node", "parent", "pre", "size")
    ends = edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
    ends = ends.join(place.toDF("a", "a_parent", "a_pre", "a_size"), "a").join(place.toDF("b", "b_parent", "b_pre", "b_size"), "b")
    first = "a_pre < b_pre"
    ends = written(ends.selectExpr("a", "b", f"if({first}, a, b) as u", f"if({first}, b, a) as w", f"if({first}, a_pre, b_pre) as u_pre", f"if({first}, b_pre, a_pre) as w_pre", f"if({first}, a_size, b_size) as u_size", f"if({first}, b_parent, a_parent) as w_parent"))
    outside = ends.where("w_parent <> u")
    reach = outside.selectExpr("u as node", "w_pre as other").union(outside.selectExpr("w", "u_pre")).groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    local = tree.join(reach, "node", "left").select("node", "parent", F.expr("least(pre, coalesce(least, pre)) as low"), F.expr("greatest(pre, coalesce(most, pre)) as high"))
    ranges = _upward(local, {"low": "min", "high": "max"})
    inner = tree.where("parent is not null").select("node", "parent").join(ranges, "node").join(place.selectExpr("node as parent", "parent as grand", "pre", "size"), "parent")
    together = inner.where("grand is not null and (low < pre or high >= pre + size)").selectExpr("parent as a", "node as b")
    together = together.union(outside.where("u_pre + u_size <= w_pre").select("u", "w"))
    found = connected(together, tree.where("parent is not null").select("node"))
    return ends.join(found.toDF("w", "block"), "w").select("a", "b", "block")


def layers(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, level) of the nodes behind no cycle of a directed graph (a needs b), and the edges among the rest.

    Level 0 needs nothing, each other node stands one level above the highest that it needs; a round takes the next level off.
    """
    near = written(edges.where("a <> b").select("a", "b").distinct())
    needs = near.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("unmet"))
    state, level, flat = written(nodes.select("node").distinct().join(needs, "node", "left").selectExpr("node", "coalesce(unmet, 0) as unmet")), 0, None
    while not (ready := state.where("unmet = 0")).isEmpty():
        taken = ready.select("node", F.lit(level).cast("long").alias("level"))
        flat = taken if flat is None else flat.union(taken)
        met = ready.select(F.col("node").alias("b")).join(near, "b").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("met"))
        level += 1
        state = written(state.where("unmet > 0").join(met, "node", "left").selectExpr("node", "unmet - coalesce(met, 0) as unmet"))  # nodes that have a level are not written again
    rest = state.select("node")
    flat = rest.selectExpr("node", "0L as level").where("false") if flat is None else written(flat)
    return flat, near.join(rest.withColumnRenamed("node", "a"), "a", "left_semi").join(rest.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


def _spread(state: DataFrame, edges: DataFrame, value: Column) -> DataFrame:
    """node, color: each node takes the greatest ``value`` among itself and the nodes that it can be reached from, by edges (a to b)."""
    state = written(state.select("node", value.alias("color"), value.isNotNull().alias("moved")))
    while not state.where("moved").isEmpty():
        given = edges.join(state.where("moved").select(F.col("node").alias("a"), "color"), "a").selectExpr("b as node", "color", "null as old")  # only what has changed is handed on
        offers = state.selectExpr("node", "color", "color as old").union(given)
        state = written(offers.groupBy("node").agg(F.max("color").alias("color"), F.max("old").alias("old")).selectExpr("node", "color", "color is not null and (old is null or color <> old) as moved"))
    return state.select("node", "color")


def strong(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): the strongly connected components of two nodes or more of a directed graph (a, b).

    Nodes that nothing enters or nothing leaves are on no cycle and are trimmed.  Of the rest each node takes as color the greatest node that reaches it; the nodes
    that reach their own color's node inside the color are its component.  They go, and the next round looks at what is left.
    """
    rest, found = written(edges.where("a <> b").select("a", "b").distinct()), None
    while True:
        n = rest.count()
        while True:
            inner = rest.select(F.col("a").alias("node")).intersect(rest.select("b"))
            inner_edges = written(rest.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").join(inner.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"))
            before, n, rest = n, inner_edges.count(), inner_edges
            if n == before:
                break
        if rest.isEmpty():
            return rest.select(F.col("a").alias("node"), F.col("a").alias("component")) if found is None else found
        nodes = rest.select(F.col("a").alias("node")).distinct()
        color = _spread(nodes, rest, F.col("node"))
        inside = rest.join(color.toDF("a", "color_a"), "a").join(color.toDF("b", "color_b"), "b").where("color_a = color_b")
        back = written(inside.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mine = color.select("node", F.when(F.col("node") == F.col("color"), F.col("color")).alias("start"))
        reached = _spread(mine, back, F.col("start")).where("color is not null")
        sets = reached.groupBy("color").agg(F.min("node").alias("component"), F.count("*").alias("n"))
        done = written(sets.join(reached, "color").select("node", "component", "n"))
        several = done.where("n > 1").select("node", "component")  # a node between two cycles is a component alone
        found = several if found is None else found.union(several)
        gone = done.select("node")
        rest = written(rest.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))


def ranked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level, cyclic, cycle of a directed graph (a needs b): nodes on or behind cycles share the level after all others, and only those that reach themselves are cyclic (``cycle``: the smallest node of theirs)."""
    flat, rest = layers(edges, nodes)
    cycles = strong(rest)
    last = flat.agg(F.coalesce(F.max("level") + 1, F.lit(0)).alias("last"))
    behind = nodes.select("node").distinct().join(flat.select("node"), "node", "left_anti").join(F.broadcast(last)).select("node", F.col("last").alias("level"))  # last is one row
    return flat.union(behind).join(cycles.withColumnRenamed("component", "cycle"), "node", "left").select("node", "level", F.col("cycle").isNotNull().alias("cyclic"), "cycle")


def below(tree: DataFrame) -> DataFrame:
    """node, inner: each node of (node, parent) with itself and all nodes below it, whatever the depth; nodes on a cycle are below each other.

    A round joins only the pairs that the round before found.
    """
    children = written(tree.where("parent is not null").select(F.col("parent").alias("inner"), F.col("node").alias("child")).distinct())
    fresh = written(tree.select("node", F.col("node").alias("inner")).distinct())
    known = fresh
    while not fresh.isEmpty():
        fresh = written(fresh.join(children, "inner").select("node", F.col("child").alias("inner")).distinct().join(known, ["node", "inner"], "left_anti"))
        known = known.union(fresh)
    return known


def shortest(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """start, goal, hops, chain: a shortest chain of nodes of an undirected graph (a, b) for each pair (start, goal) that has one; of several the one whose steps before the goal have the smallest names, from the goal on.

    The search goes out from all distinct starts at once, a level a round, and ends when a start has met all its goals or nothing new; each (start, node) keeps its smallest predecessor.
    """
    near, wanted = written(both_ways(edges)), written(pairs.select("start", "goal").distinct())
    level = written(wanted.select("start", F.col("start").alias("node"), F.lit(None).cast("string").alias("before"), F.lit(0).alias("hops")).distinct())
    seen, open_pairs = level, wanted.where("start <> goal")
    while not level.isEmpty():
        level = level.join(open_pairs.select("start").distinct(), "start", "left_semi")
        out = level.join(near, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min("src").alias("before"), F.max(F.col("hops") + 1).alias("hops"))
        level = written(out.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = seen.union(level)
        open_pairs = written(open_pairs.join(level.select("start", F.col("node").alias("goal")), ["start", "goal"], "left_anti"))
    seen = written(seen)
    chains = written(wanted.join(seen.withColumnRenamed("node", "goal"), ["start", "goal"]).select("start", "goal", "hops", F.array("goal").alias("chain"), F.col("before").alias("at")))
    while not chains.where("at is not null").isEmpty():
        steps = seen.select("start", F.col("node").alias("at"), F.col("before").alias("further"))
        chains = written(chains.join(steps, ["start", "at"], "left").select("start", "goal", "hops", F.expr("if(at is null, chain, concat(array(at), chain))").alias("chain"), F.col("further").alias("at")))
    return chains.select("start", "goal", F.col("hops").cast("long").alias("hops"), "chain")


def _sets(owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, people) of all paths, and (people, path) of the sets of several people with the first path of each: paths of the same people are twins in the graph of people and paths."""
    paths = owners.groupBy("path").agg(F.array_sort(F.collect_set("author")).alias("people"))
    return paths, written(paths.where("size(people) > 1").groupBy("people").agg(F.min("path").alias("path")))


def knowledge_chains(owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """author, successor, hops, chain: a shortest chain of people and paths from each author to each successor (pairs: author, successor) in the whole graph of people and paths.

    Of twin paths the first one stands for all; a path of one person leads nowhere.
    """
    edges = _sets(owners)[1].select(F.explode("people").alias("person"), "path").selectExpr("concat('person:', person) as a", "concat('path:', path) as b")
    found = shortest(edges, pairs.selectExpr("concat('person:', author) as start", "concat('person:', successor) as goal"))
    return found.select(F.expr("substr(start, 8)").alias("author"), F.expr("substr(goal, 8)").alias("successor"), "hops", F.array_join("chain", ",").alias("chain"))


def knowledge_cuts(owners: DataFrame) -> DataFrame:
    """person, pieces, directories: people whose departure splits the graph of people and paths, with how many pieces their paths fall into and a directory of each.

    ``owners``: path, author.  Paths with the same people are twins, so the graph holds each set of people once; a path of one person alone is a piece of its own.
    A person's other pieces are their blocks.  The directory of a piece is that of its first path of the person; paths without directory give none.
    """
    paths, sets = _sets(owners)
    edges = sets.select(F.explode("people").alias("person"), "path")
    named = edges.select(F.concat(F.lit("person:"), "person").alias("a"), F.concat(F.lit("set:"), "path").alias("b"))
    sides = blocks(named).where("startswith(a, 'person:')").selectExpr("substr(a, 8) as person", "substr(b, 5) as path", "block")
    pieces = sides.groupBy("person", "block").agg(F.min("path").alias("path")).select("person", "path")
    pieces = pieces.union(paths.where("size(people) = 1").select(F.col("people")[0], "path"))
    found = pieces.withColumn("dir", F.expr("if(contains(path, '/'), regexp_replace(path, '/[^/]*$', ''), null)"))
    grouped = found.groupBy("person").agg(F.count("*").alias("pieces"), F.array_join(F.array_sort(F.collect_set("dir")), ",").alias("directories"))
    return grouped.where("pieces > 1")


def knowledge_betweenness(owners: DataFrame, top: int = 10, batch: int = 5000) -> DataFrame:
    """person, score: the people between most pairs of nodes in the whole graph of people and paths (owners: path, author), normalised and exact; those above 0, best first.

    Twin paths (of the same people) are one node with a number of copies.  From each source, ``batch`` of them at a time, levels go out with the number of shortest paths, which a node of
    m copies passes on m times, and what depends on a node is summed back level by level.  A source's own twins lie two steps away, behind each of its people alike.
    """
    paths = owners.groupBy("path").agg(F.array_sort(F.collect_set("author")).alias("people"))
    sets = written(paths.groupBy("people").agg(F.min("path").alias("path"), F.count("*").cast("double").alias("copies")).withColumn("node", F.concat(F.lit("set:"), "path")))
    links = sets.select(F.explode("people").alias("person"), "node").select(F.concat(F.lit("person:"), "person").alias("person"), "node")
    near = written(links.toDF("src", "dst").union(links.select("node", "person")))
    weights = written(sets.select("node", "copies", F.size("people").alias("people")).union(links.select("person").distinct().selectExpr("person", "1e0", "0")))
    total = weights.agg(F.sum("copies").alias("n"), F.count("*").alias("nodes")).first()
    batches, scores = max(1, -(-total.nodes // batch)), None
    for number in range(batches):
        sources = weights.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == number)
        level = written(sources.selectExpr("node as s", "node", "1e0 as ways", "1e0 as copies"))
        levels = []
        while not level.isEmpty():
            levels.append(level)
            out = level.join(near, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum(F.col("ways") * F.col("copies")).alias("ways"))
            for old in levels[-2:]:
                out = out.join(old.select("s", "node"), ["s", "node"], "left_anti")
            level = written(out.join(weights.select("node", "copies"), "node").select("s", "node", "ways", "copies"))
        lower, found = None, []
        for d in range(len(levels) - 1, 0, -1):
            here = levels[d].withColumn("depends", F.lit(0.0)) if lower is None else levels[d].join(lower, ["s", "node"], "left").withColumn("depends", F.coalesce("depends", F.lit(0.0)))
            if d == 1:  # the source's twins are no level: they are reached through each of its people
                twins = weights.where("people > 0 and copies > 1").selectExpr("node as s", "(copies - 1) / people as twins")
                here = here.join(twins, "s", "left").withColumn("depends", F.col("depends") + F.coalesce("twins", F.lit(0.0))).drop("twins")
            here = written(here)
            found.append(here.where("startswith(node, 'person:')").select("s", "node", "depends"))
            above = levels[d - 1].selectExpr("s", "node as dst", "ways as above_ways")
            lower = here.join(near, F.col("node") == F.col("src")).join(above, ["s", "dst"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum(F.expr("copies * above_ways / ways * (1 + depends)")).alias("depends"))
        for part in found:
            scores = part if scores is None else scores.union(part)
    if scores is None:
        return weights.limit(0).selectExpr("node as person", "copies as score")
    pairs = max(1.0, (total.n - 1) * (total.n - 2))
    each = scores.join(weights.selectExpr("node as s", "copies as sources"), "s").groupBy("node").agg((F.sum(F.col("depends") * F.col("sources")) / pairs).alias("score"))
    shown = each.selectExpr("substr(node, 8) as person", "score").where("score > 1e-12")
    return shown.orderBy(F.round("score", 9).desc(), "person").limit(top).select("person", F.round("score", 4).alias("score"))
