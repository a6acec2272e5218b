"""Communities of a weighted graph by levels (Louvain), as rounds of joins, and their comparison with declared teams.

A level starts with every node alone.  In a round each node finds the neighbouring community to which its move adds most modularity.  Communities are dealt into those
that may lose and those that may gain nodes, anew in each round, and of the moves between them those are made at once that add something even if all others are
made too; where there is none, those that are the best of both communities that they touch.  So modularity grows with every round, and rounds end.  When no move is left, communities become the nodes of the next level, until a level moves nothing.  Ties go to the community of the smaller name, so results do not
depend on how the graph is dealt out.  No step holds the graph or a community in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.plans.storage import written

#: A move must add more than this to the sum of weights.
LEAST = 1e-9


def _two_way(weights: DataFrame) -> DataFrame:
    """src, dst, w in both directions; a loop stands once, with twice its weight."""
    plain = weights.where("weight > 0").select("a", "b", F.col("weight").cast("double").alias("w"))
    both = plain.union(plain.selectExpr("b", "a", "w"))
    return both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def _wanted(near: DataFrame, state: DataFrame, total: float, resolution: float) -> DataFrame:
    """node, home, degree, target, gain: the best move of each node that has one; the gain is in weight."""
    size = state.groupBy("home").agg(F.sum("degree").alias("size"))
    links = near.where("src <> dst").join(state.select(F.col("node").alias("dst"), F.col("home").alias("target")), "dst").groupBy(F.col("src").alias("node"), "target").agg(F.sum("w").alias("inside"))
    offers = state.join(size, "home").join(links, "node").join(size.toDF("target", "target_size"), "target")
    # at home a node is measured without itself
    offers = offers.withColumn("value", F.expr(f"inside - {resolution}d * degree * if(target = home, size - degree, target_size) / {total!r}d"))
    alone = f"-{resolution}d * degree * (size - degree) / {total!r}d"
    best = F.min(F.expr("if(target <> home, struct(round(-value, 9) as less, target as target), null)")).alias("best")  # equal offers go to the smaller name; equal sums may differ in their last bit
    found = offers.groupBy("node", "home", "degree", "size").agg(F.max(F.expr("if(target = home, value, null)")).alias("stay"), best)
    return found.withColumn("gain", F.expr(f"-best.less - coalesce(stay, {alone})")).where(f"gain > {LEAST}").select("node", "home", "degree", F.col("best.target").alias("target"), "gain")


def _made(wanted: DataFrame, number: int, total: float, resolution: float) -> DataFrame:
    """node, target of the moves of round ``number`` that add something though all others of them are made too."""
    role = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(number)), F.lit(2))
    allowed = wanted.where((role("home") == 0) & (role("target") == 1))
    joining = allowed.groupBy("target").agg(F.sum("degree").alias("joining"))
    leaving = allowed.groupBy("home").agg(F.sum("degree").alias("leaving"))
    return allowed.join(joining, "target").join(leaving, "home").where(f"gain - {resolution}d * degree * (joining + leaving - 2 * degree) / {total!r}d > {LEAST}").select("node", "target")


def _apart(wanted: DataFrame) -> DataFrame:
    """node, target of the moves that are the best of both communities that they touch; there is always one."""
    chosen = wanted.withColumn("rank", F.struct(-F.round("gain", 9), F.least("home", "target"), "node"))
    ends = chosen.select(F.col("home").alias("community"), "rank").union(chosen.select("target", "rank")).groupBy("community").agg(F.min("rank").alias("first"))
    return chosen.join(ends.toDF("home", "home_first"), "home").join(ends.toDF("target", "target_first"), "target").where("rank = home_first and rank = target_first").select("node", "target")


def _level(near: DataFrame, total: float, resolution: float) -> tuple[DataFrame, int]:
    """node, home after all moves of a level, and how many rounds it took."""
    state = written(near.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree")).select("node", F.col("node").alias("home"), "degree"))
    rounds = 0
    while True:
        wanted = written(_wanted(near, state, total, resolution))
        if wanted.isEmpty():
            return state.select("node", "home"), rounds
        moves = _made(wanted, rounds, total, resolution)
        if moves.isEmpty():
            moves = _apart(wanted)
        state = written(state.join(moves, "node", "left").select("node", F.coalesce("target", "home").alias("home"), "degree"))
        rounds += 1


def levels(weights: DataFrame, resolution: float = 1.0) -> DataFrame:
    """level (from 1), person, community (its smallest person) of a graph (a, b, weight): the communities of each level, of all people that have an edge."""
    near = written(_two_way(weights))
    total = near.agg(F.sum("w")).first()[0] or 1.0
    found, people, level = None, None, 0
    while True:
        homes, rounds = _level(near, total, resolution)
        if level and not rounds:
            return found
        level += 1
        people = homes.toDF("person", "node") if people is None else people.join(homes, "node").select("person", F.col("home").alias("node"))
        names = people.groupBy("node").agg(F.min("person").alias("community"))
        people = written(people.join(names, "node").select("person", "node", "community"))
        rows = people.select(F.lit(level).cast("long").alias("level"), "person", "community")
        found = rows if found is None else found.union(rows)
        people = people.select("person", "node")
        merged = near.join(homes.toDF("src", "s"), "src").join(homes.toDF("dst", "d"), "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w"))
        near = written(merged)


def modularity(weights: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """level, communities, modularity of each level of ``levels``."""
    near = _two_way(weights)
    degree = near.groupBy(F.col("src").alias("person")).agg(F.sum("w").alias("degree"))
    size = communities.join(degree, "person").groupBy("level", "community").agg(F.sum("degree").alias("degree"))
    one, two = communities.toDF("level", "src", "community"), communities.toDF("other_level", "dst", "other")
    inside = near.join(one, "src").join(two, "dst").where("level = other_level and community = other").groupBy("level", "community").agg(F.sum("w").alias("inside"))
    total = near.agg(F.sum("w").alias("total"))
    parts = size.join(inside, ["level", "community"], "left").join(F.broadcast(total))  # total is one row
    return parts.groupBy("level").agg(F.count("*").alias("communities"), F.sum(F.expr(f"coalesce(inside, 0) / total - {resolution}d * (degree / total) * (degree / total)")).alias("modularity"))


def clusters(weights: DataFrame, communities: DataFrame, teams: DataFrame, neighbours: int = 2, fraction: float = 0.5) -> DataFrame:
    """community, name, declared, parent, members, affiliated: one row a community of the level below the last (the only one, where there is one).

    A person is affiliated to another community with at least ``neighbours`` neighbours there whose weight is at least ``fraction`` of that at home.  A cluster whose people and
    affiliated people are those of a team (slug, login) has its name (the first of several), else it is inferred-<number> in the order of their people.  The parent is the
    larger community of the last level that holds it, parent-<number>; where that is no larger there is none.
    """
    top = communities.agg(F.max("level").alias("top")).first()["top"] or 1
    here = communities.where(F.col("level") == max(1, top - 1)).select("person", "community")
    near = _two_way(weights).where("src <> dst")
    away = near.join(here.toDF("src", "home"), "src").join(here.toDF("dst", "other"), "dst").groupBy(F.col("src").alias("person"), "home", "other").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    at_home = away.where("home = other").select("person", F.col("w").alias("home_w"))
    extra = away.where(f"home <> other and n >= {neighbours}").join(at_home, "person").where(f"home_w > 0 and w >= {fraction} * home_w").select("person", F.col("other").alias("community"))
    everyone = written(here.withColumn("own", F.lit(True)).union(extra.withColumn("own", F.lit(False))))
    bare = F.expr("lower(trim(leading '@' from person))")
    held = everyone.groupBy("community").agg(
        F.array_sort(F.collect_set(F.expr("if(own, person, null)"))).alias("members"), F.array_sort(F.collect_set(F.expr("if(own, null, person)"))).alias("affiliated"), F.array_sort(F.collect_set(bare)).alias("bare")
    )
    declared = teams.groupBy("slug").agg(F.array_sort(F.collect_set(F.expr("lower(trim(leading '@' from login))"))).alias("bare")).groupBy("bare").agg(F.min("slug").alias("slug"))
    last = communities.where(F.col("level") == top)
    wide = last.groupBy("community").agg(F.count("*").alias("n"), F.min("person").alias("first"))
    size = here.groupBy("community").agg(F.count("*").alias("own"), F.min("person").alias("person"))
    above = size.join(last.withColumnRenamed("community", "up").drop("level"), "person").join(wide.toDF("up", "n", "first"), "up").where("n > own").select("community", "first")
    parents = above.select("first").distinct().withColumn("parent", F.expr("concat('parent-', row_number() over (order by first) - 1)"))  # as few as there are parents
    numbered = held.withColumn("number", F.expr("row_number() over (order by members) - 1"))  # as few as there are communities
    named = numbered.join(declared, "bare", "left").join(above, "community", "left").join(parents, "first", "left")
    return named.select("community", F.expr("coalesce(slug, concat('inferred-', number))").alias("name"), F.col("slug").isNotNull().alias("declared"), F.expr("coalesce(parent, '')").alias("parent"), F.array_join("members", ",").alias("members"), F.array_join("affiliated", ",").alias("affiliated"))


def team_comparisons(found: DataFrame, teams: DataFrame) -> DataFrame:
    """team, cluster, overlap, precision, recall, coverage, cross_team: one row a declared team (slug, login) against the cluster of ``clusters`` nearest to it.

    Nearest is the largest overlap (shared people over all people of both), then the smaller name; affiliated people count as members.  Names are compared without case and @.  Coverage is
    the share of the team's people in any cluster; cross_team lists the cluster's people that are not of the team.
    """
    people = found.select("name", F.explode(F.expr("filter(split(concat_ws(',', members, affiliated), ','), x -> x <> '')")).alias("person")).withColumn("bare", F.expr("lower(trim(leading '@' from person))"))
    mine = teams.select("slug", F.expr("lower(trim(leading '@' from login))").alias("bare")).distinct()
    sizes, team_sizes = people.groupBy("name").agg(F.countDistinct("bare").alias("people")), mine.groupBy("slug").agg(F.count("*").alias("team_people"))
    shared = people.select("name", "bare").distinct().join(mine, "bare").groupBy("slug", "name").agg(F.count("*").alias("shared")).join(sizes, "name").join(team_sizes, "slug")
    scored = shared.withColumn("overlap", F.expr("shared / (people + team_people - shared)"))
    nearest = scored.groupBy("slug").agg(F.min(F.struct(-F.col("overlap"), "name", "shared", "people", "overlap")).alias("best"))
    none = found.agg(F.min("name").alias("first_name"))  # a team that shares nothing: all clusters are alike
    covered = mine.join(people.select("bare").distinct(), "bare").groupBy("slug").agg(F.count("*").alias("covered"))
    rows = team_sizes.join(nearest, "slug", "left").join(covered, "slug", "left").join(F.broadcast(none)).join(sizes.toDF("first_name", "first_people"), "first_name", "left")
    rows = rows.selectExpr("slug as team", "coalesce(best.name, first_name, '') as cluster", "coalesce(best.shared, 0) as shared", "coalesce(best.people, first_people, 0) as people", "team_people", "coalesce(best.overlap, 0e0) as overlap", "coalesce(covered, 0) as covered")
    cross = rows.select("team", "cluster").join(people, F.col("cluster") == F.col("name")).join(mine.toDF("team", "bare"), ["team", "bare"], "left_anti").groupBy("team").agg(F.array_join(F.array_sort(F.collect_set("person")), ",").alias("cross_team"))
    ratio = "round(if({1} > 0, {0} / {1}, 0e0), 4) as {2}"
    return rows.join(cross, "team", "left").selectExpr("team", "cluster", "round(overlap, 4) as overlap", ratio.format("shared", "people", "precision"), ratio.format("shared", "team_people", "recall"), ratio.format("covered", "team_people", "coverage"), "coalesce(cross_team, '') as cross_team")
