"""Ancestry of commits by an index of chains: no step holds a repository, a history or the ancestors of a commit.

The history is cut into chains of first parents.  All ancestors of a commit that lie on one chain are the chain's oldest commits up to a place, so a
commit's ancestors are one row a chain that it reaches.  Only the commits that are asked about get these rows, by rounds that follow the edges between chains:
a round is a join, and the rounds are as many as a walk changes chains, not as the history is deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.plans.storage import written

#: All joins here are on names as many as the commits, and these tables are far smaller as files than in memory: by their files' size Spark would broadcast them through the driver.
MERGE = "merge"
#: Edges that leave one chain are dealt into so many parts by their place, so a trunk of very many merges is not one task's.
PARTS = 16


def chains(edges: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """repo, sha, chain (its oldest commit), pos (from 0, the oldest) of all commits in ``edges`` (repo, sha, parent, and nth if the order of the parents is known).

    A commit follows its first parent (without nth: the smallest); where several do, the smallest of those that go on themselves, else the smallest.
    ``heads`` (repo, sha) adds commits that no edge names.  Rows with a null are left out.  A circle of first parents raises ``ValueError``.
    """
    order = F.col("nth") if "nth" in edges.columns else F.lit(0)
    plain = edges.select("repo", "sha", "parent", order.alias("nth")).dropna(subset=["repo", "sha", "parent"]).where("sha <> parent")
    first = plain.groupBy("repo", "sha").agg(F.min(F.struct("nth", "parent")).alias("least")).selectExpr("repo", "sha", "least.parent as parent")
    tips = first.join(first.selectExpr("repo", "parent as sha").distinct().hint(MERGE), ["repo", "sha"], "left_anti").selectExpr("repo", "sha", "true as tip")
    offers = first.join(tips.hint(MERGE), ["repo", "sha"], "left")
    links = offers.groupBy("repo", "parent").agg(F.min(F.struct(F.coalesce("tip", F.lit(False)).alias("tip"), "sha")).alias("least")).selectExpr("repo", "least.sha as sha", "parent as jump")
    names = plain.select("repo", "sha").union(plain.select("repo", "parent"))
    names = (names if heads is None else names.union(heads.select("repo", "sha").dropna())).distinct()
    state = written(names.join(links.hint(MERGE), ["repo", "sha"], "left").selectExpr("repo", "sha", "jump", "cast(if(jump is null, 0, 1) as bigint) as pos", "if(jump is null, sha, null) as chain"))
    # Each open commit points 2**round places back, no two to the same, so no name is hot; after as many rounds as the count has bits only circles are open.
    for _ in range(names.count().bit_length() + 1):
        if state.where("jump is not null").isEmpty():
            return state.select("repo", "sha", "chain", "pos")
        further = state.selectExpr("repo", "sha as jump", "jump as next", "pos as more", "chain as oldest")
        moved = state.where("jump is not null").join(further.hint(MERGE), ["repo", "jump"]).selectExpr("repo", "sha", "next as jump", "pos + more as pos", "oldest as chain")
        state = written(state.where("jump is null").select("repo", "sha", "jump", "pos", "chain").union(moved))
    raise ValueError("commits that are their own first ancestors")


def crossings(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """repo, chain, pos, to_chain, to_pos: the edges from a commit to a parent that its chain does not hold below it."""
    own, above = placed, placed.selectExpr("repo", "sha as parent", "chain as to_chain", "pos as to_pos")
    return edges.select("repo", "sha", "parent").join(own.hint(MERGE), ["repo", "sha"]).join(above.hint(MERGE), ["repo", "parent"]).where("chain <> to_chain").select("repo", "chain", "pos", "to_chain", "to_pos").distinct()


def reach(heads: DataFrame, placed: DataFrame, crossed: DataFrame) -> DataFrame:
    """repo, head, chain, upto: of each chain the place up to which its commits are ancestors of a head (repo, sha), or the head itself.

    A round takes the crossings between the place that was known before and the one that is known now, so each crossing meets a head once.
    """
    dealt = written(crossed.withColumn("part", F.pmod("pos", F.lit(PARTS))))
    fresh = written(heads.select("repo", "sha").distinct().join(placed.hint(MERGE), ["repo", "sha"]).selectExpr("repo", "sha as head", "chain", "pos as upto", "-1L as since"))
    known = fresh.drop("since")
    while not fresh.isEmpty():
        spread = fresh.withColumn("part", F.explode(F.expr(f"sequence(0L, {PARTS - 1}L)")))
        offers = spread.join(dealt.hint(MERGE), ["repo", "chain", "part"]).where("pos > since and pos <= upto").groupBy("repo", "head", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("upto"))
        better = offers.join(known.withColumnRenamed("upto", "since").hint(MERGE), ["repo", "head", "chain"], "left").where("since is null or upto > since")
        fresh = written(better.selectExpr("repo", "head", "chain", "upto", "coalesce(since, -1L) as since"))
        known = written(known.union(fresh.drop("since")).groupBy("repo", "head", "chain").agg(F.max("upto").alias("upto")))
    return known


def commit_graph(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """repo, a, b, ahead, behind, is_ancestor, bases of pairs of commits (repo, a, b), from the parents (repo, sha, parent, perhaps nth) of each repository.

    ahead: ancestors of a (itself among them) that b has not; behind: the other way; is_ancestor: a is b or an ancestor of it; bases: the common ancestors that are no parents
    of common ancestors, sorted, comma-joined (empty: none).  A commit that no edge names is its own only ancestor.  Repeated pairs give one row, pairs with a null none.
    """
    pairs = pairs.select("repo", "a", "b").dropna().distinct()
    heads = pairs.selectExpr("repo", "a as sha").union(pairs.selectExpr("repo", "b")).distinct()
    placed = chains(edges, heads)
    crossed = written(crossings(edges, placed))
    known = reach(heads, placed, crossed)
    sides = pairs.join(known.withColumnRenamed("head", "a").hint(MERGE), ["repo", "a"]).selectExpr("repo", "a", "b", "chain", "upto as one", "-1L as two")
    sides = sides.union(pairs.join(known.withColumnRenamed("head", "b").hint(MERGE), ["repo", "b"]).selectExpr("repo", "a", "b", "chain", "-1L", "upto"))
    both = written(sides.groupBy("repo", "a", "b", "chain").agg(F.max("one").alias("one"), F.max("two").alias("two")).withColumn("upto", F.least("one", "two")))
    at = placed.selectExpr("repo", "sha as a", "chain as a_chain", "pos as a_pos")
    counts = both.join(at.hint(MERGE), ["repo", "a"]).groupBy("repo", "a", "b").agg(F.sum(F.expr("one - upto")).alias("ahead"), F.sum(F.expr("two - upto")).alias("behind"), F.max(F.expr("chain = a_chain and two >= a_pos")).alias("is_ancestor"))
    # A common ancestor is no base if it is the parent of one: on its own chain all but the last are, the last by a crossing from a common place.
    last = both.where("upto >= 0").select("repo", "a", "b", "chain", "upto")
    behind = last.join(crossed.selectExpr("repo", "to_chain as chain", "to_pos as upto", "chain as from_chain", "pos as from_pos").hint(MERGE), ["repo", "chain", "upto"])
    behind = behind.join(last.selectExpr("repo", "a", "b", "chain as from_chain", "upto as common").hint(MERGE), ["repo", "a", "b", "from_chain"]).where("from_pos <= common").select("repo", "a", "b", "chain").distinct()
    bases = last.join(behind.hint(MERGE), ["repo", "a", "b", "chain"], "left_anti").join(placed.withColumnRenamed("pos", "upto").hint(MERGE), ["repo", "chain", "upto"])
    bases = bases.groupBy("repo", "a", "b").agg(F.array_join(F.array_sort(F.collect_list("sha")), ",").alias("bases"))
    return counts.join(bases.hint(MERGE), ["repo", "a", "b"], "left").select("repo", "a", "b", "ahead", "behind", "is_ancestor", F.coalesce("bases", F.lit("")).alias("bases"))
