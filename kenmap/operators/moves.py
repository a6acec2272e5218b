"""Living paths: which of today's paths a touch of the past belongs to, through chains of moves.

The history of one path is a list of transitions: its file moves away, is deleted, or another file moves over it.  A touch belongs
to the file that had the path then, so its first transition after the touch says where to look next.  Orders grow along a chain of moves, so chains have no
cycles, whatever the names do (swaps, moves back and forth, a path that is used again); pointers between transitions are followed by doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmap.plans.storage import written


def timelines(moves: DataFrame) -> DataFrame:
    """path, steps: the transitions of each path by order (ord, dest); dest is null where the file of that path ends.

    ``moves``: ord, kind (R: rename, D: deletion), source, dest.  Where one commit moves a path's file away and another over it, the file moves away (a swap).
    """
    away = moves.where("kind in ('R', 'D') and source is not null").selectExpr("source as path", "ord", "0 as over", "if(kind = 'R', dest, null) as dest")
    over = moves.where("kind = 'R' and dest is not null and not source <=> dest").selectExpr("dest as path", "ord", "1 as over", "cast(null as string) as dest")
    firsts = away.union(over).groupBy("path", "ord").agg(F.min(F.struct("over", F.coalesce("dest", F.lit("")).alias("key"), "dest")).alias("step"))
    return firsts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("step.dest").alias("dest")))).alias("steps"))


#: The first step of ``steps`` after ``ord``, null where there is none.
_NEXT = "get(filter(steps, s -> s.ord > {0}), 0)"


def outcomes(lines: DataFrame) -> DataFrame:
    """path, ord, living: where the file that left ``path`` at ``ord`` stands in the end; null where it ended.

    Each round halves the chain that is left, so the number of rounds is the logarithm of the longest one.
    """
    steps = lines.select("path", F.explode("steps").alias("step")).select("path", F.col("step.ord").alias("ord"), F.col("step.dest").alias("dest"))
    further = lines.withColumnsRenamed({"path": "dest"})
    state = steps.join(further, "dest", "left").withColumn("next", F.expr(f"if(dest is null or steps is null, null, {_NEXT.format('ord')})"))
    # a transition points to the next one of its file; without one, dest is the answer
    state = written(state.selectExpr("path", "ord", "dest as living", "if(next is null, null, dest) as to_path", "next.ord as to_ord"))
    while not state.where("to_path is not null").isEmpty():
        above = state.selectExpr("path as to_path", "ord as to_ord", "living as end", "to_path as next_path", "to_ord as next_ord", "true as met")
        joined = state.join(above, ["to_path", "to_ord"], "left")
        state = written(joined.selectExpr("path", "ord", "if(met, end, living) as living", "if(met, next_path, null) as to_path", "if(met, next_ord, null) as to_ord"))
    return state.select("path", "ord", "living")


def living(touches: DataFrame, moves: DataFrame) -> DataFrame:
    """``touches`` (path, ord, ...) with ``living``, today's path of the file touched; null where the file has ended.

    Touches are not ordered or grouped: each meets its path's transitions, which are few, and the outcome of one of them.  A commit's touches name its paths
    after its own moves, so only later transitions count.
    """
    lines = written(timelines(moves))
    ends = outcomes(lines).selectExpr("path as from_path", "ord as from_ord", "living as settled")
    met = touches.join(lines.withColumnRenamed("path", "line_path"), F.col("path") == F.col("line_path"), "left").withColumn("from_ord", F.expr(f"if(steps is null, null, {_NEXT.format('ord')}.ord)"))
    met = met.drop("line_path", "steps").withColumnRenamed("from_ord", "first_ord")
    found = met.join(ends, (F.col("path") == F.col("from_path")) & (F.col("first_ord") == F.col("from_ord")), "left")
    return found.withColumn("living", F.expr("if(first_ord is null, path, settled)")).drop("first_ord", "from_path", "from_ord", "settled")
