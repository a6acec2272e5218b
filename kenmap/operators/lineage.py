"""Lineage of paths: ordered folds over commits, dealt by components of paths that bear on each other."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kenmap.operators.components import connected
from kenmap.plans.storage import written


class Lineage:
    """Living paths and the logical file that each stands for."""

    def __init__(self) -> None:
        self.file_at: dict[str, str] = {}
        self.names: dict[str, list[str]] = {}
        self.similarity: dict[str, int] = {}
        self.source: dict[str, str] = {}

    def touch(self, path: str, nonce: str) -> str:
        if path not in self.file_at:
            key = hashlib.sha256(path.encode()).hexdigest()[:16]
            if key in self.names:
                key = hashlib.sha256(f"{path}\0{nonce}".encode()).hexdigest()[:16]
            self.file_at[path], self.names[key], self.similarity[key] = key, [path], 100
        return self.file_at[path]

    def rename(self, moves: Iterable[tuple[str, str, int]], nonce: str) -> None:
        """All renames of one commit at once, so that swaps keep both files."""
        taken = [(self.touch(old, nonce), old, new, s) for old, new, s in moves]
        for _, old, _, _ in taken:
            self.file_at.pop(old, None)
        for key, _, new, s in taken:
            self.file_at[new] = key
            self.names[key].append(new)
            self.similarity[key] = min(self.similarity[key], s)

    def copy(self, old: str, new: str, similarity: int, nonce: str) -> None:
        """The copy is a file of its own that shares the history of its source so far."""
        source = self.touch(old, nonce)
        self.file_at.pop(new, None)
        key = self.touch(new, nonce)
        self.source[key], self.similarity[key] = source, similarity

    def rows(self) -> list[tuple[str, str, list[str], float, str | None]]:
        out = []
        for path, key in sorted(self.file_at.items()):
            prior: list[str] = []
            for name in reversed(self.names[key][:-1]):
                if name == path or name in prior:
                    break
                prior.append(name)
            out.append((key, path, prior, self.similarity[key] / 100, self.source.get(key)))
        return out


def _shared_directory(paths: list[str]) -> list[str]:
    """Components of the deepest directory above all paths."""
    split = [p.split("/")[:-1] for p in paths]
    return [parts[0] for parts in itertools.takewhile(lambda parts: len(set(parts)) == 1, zip(*split))]


def directory_moves(moves: list[tuple[str, str, int]], living: Iterable[str]) -> list[tuple[str, str]]:
    """(old, new) directory, where a commit's renames (two or more) change nothing but it and move all its living files."""
    if len(moves) < 2:
        return []
    old, new = _shared_directory([m[0] for m in moves]), _shared_directory([m[1] for m in moves])
    while old and new and old[-1] == new[-1]:  # a component that both end in was not renamed
        old, new = old[:-1], new[:-1]
    sources = {m[0] for m in moves}
    same = old and new and all(a.split("/")[len(old) :] == b.split("/")[len(new) :] for a, b, _ in moves)
    root = "/".join(old) + "/"
    return [("/".join(old), "/".join(new))] if same and all(p in sources for p in living if p.startswith(root)) else []


def settled(moves: list[tuple[str, str, int]], living: dict[str, str]) -> list[tuple[str, str, int]]:
    """The renames of a commit as they count: a moved directory takes its living files only, all with the least similarity."""
    if not directory_moves(moves, living):
        return moves
    least = min(s for *_, s in moves)
    return [(a, b, least) for a, b, _ in moves if a in living]


#: Rows of one fold, about; a component that is larger stays whole.
GROUP_ROWS = 20_000


def _directories(path: str) -> str:
    return f"slice(split({path}, '/'), 1, size(split({path}, '/')) - 1)"


def _shared(one: str, two: str) -> str:
    """The components that two lists begin with alike."""
    return f"slice({one}, 1, array_min(transform(concat(filter(sequence(1, least(size({one}), size({two})) + 1), i -> not get({one}, i - 1) <=> get({two}, i - 1)), array(least(size({one}), size({two})) + 1)), i -> i - 1)))"


def moved_roots(moves: DataFrame) -> DataFrame:
    """repo, sha, root of the commits whose renames (two or more: repo, sha, old_path, path) change nothing but a directory above all; whether they move all its living files is told by the fold.

    The components that the least and the greatest of some lists begin with alike are those of all of them, so no commit is collected.
    """
    ends = moves.groupBy("repo", "sha").agg(F.count("*").alias("n"), *[how(F.expr(_directories(c))).alias(f"{name}_{c}") for c in ("old_path", "path") for name, how in (("least", F.min), ("most", F.max))]).where("n > 1")
    both = ends.selectExpr("repo", "sha", f"{_shared('least_old_path', 'most_old_path')} as was", f"{_shared('least_path', 'most_path')} as now")
    # a component that both end in was not renamed
    cut = both.withColumn("same", F.expr(f"size({_shared('reverse(was)', 'reverse(now)')})")).selectExpr("repo", "sha", "slice(was, 1, size(was) - same) as was", "slice(now, 1, size(now) - same) as now").where("size(was) > 0 and size(now) > 0")
    tail = "slice(split({0}, '/'), size({1}) + 1, size(split({0}, '/')))"
    kept = moves.join(cut, ["repo", "sha"]).groupBy("repo", "sha").agg(F.min(F.expr(f"{tail.format('old_path', 'was')} = {tail.format('path', 'now')}")).alias("same"), F.first(F.expr("array_join(was, '/')")).alias("root"))
    return kept.where("same").select("repo", "sha", "root")


def _components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """node (repo and path), component: paths that renames and copies join, or a directory that may have moved whole."""
    name = lambda path: F.concat_ws("\n", "repo", path)
    edges = rows.where("old_path is not null and status in ('R', 'C')").select(name("old_path").alias("a"), name("path").alias("b"))
    if not roots.isEmpty():
        spoken = rows.select("repo", "path").union(rows.where("old_path is not null").select("repo", "old_path")).distinct()
        above = spoken.select("repo", "path", F.explode(F.expr(f"transform(filter(sequence(0, size({_directories('path')})), i -> i > 0), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("root"))
        inside = above.join(roots.select("repo", "root").distinct(), ["repo", "root"]).select(F.concat_ws("\n", "repo", "root", F.lit("")).alias("a"), name("path").alias("b"))
        edges = edges.union(inside)
    return connected(edges)


def lineage(commits: DataFrame, files: DataFrame) -> DataFrame:
    """logical_id, path, priors, confidence, copied_from of the living paths.

    ``commits``: repo, sha, ts; ``files``: repo, sha, status, similarity, old_path, path.
    A fold holds whole components of paths that renames and copies join (with all paths below a directory that may have moved whole), since no other path bears on them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        pdf = pdf.sort_values(["repo", "ts", "sha", "path"])
        for _, own in itertools.groupby(zip(*(pdf[c].tolist() for c in ("repo", "ts", "sha", "status", "similarity", "old_path", "path", "whole"))), key=lambda r: r[0]):
            state = Lineage()
            for (_, sha), group in itertools.groupby(own, key=lambda r: r[1:3]):
                rows = list(group)
                moves = [(old, path, int(s)) for *_, status, s, old, path, _ in rows if status == "R"]
                state.rename(settled(moves, state.file_at) if rows[0][-1] else moves, sha)
                for *_, status, s, old, path, _ in rows:
                    if status == "C":
                        state.copy(old, path, int(s), sha)
                    elif status == "D":
                        state.file_at.pop(path, None)
                    else:
                        state.touch(path, sha)
            out += state.rows()
        return pd.DataFrame(out, columns=["logical_id", "path", "priors", "confidence", "copied_from"])

    # A path is touched once before it moves: of its plain changes only the first decides, so only moves, deletions and first touches are handed over.
    joined = commits.select("repo", "sha", "ts").join(files.select("repo", "sha", "status", F.coalesce("similarity", F.lit(100)).alias("similarity"), "old_path", "path"), ["repo", "sha"])
    plain = F.col("status").isin("A", "M", "T")
    first = joined.withColumn("n", F.when(plain, F.row_number().over(Window.partitionBy("repo", "path", plain).orderBy("ts", "sha"))))
    moved = joined.where(~plain).select("repo", F.explode(F.array("path", "old_path")).alias("path")).where("path is not null").distinct().withColumn("moves", F.lit(True))
    needed = written(first.join(moved, ["repo", "path"], "left").where("n is null or n = 1 or moves").drop("n", "moves"))
    roots = written(moved_roots(needed.where("status = 'R'")))
    placed = needed.withColumn("node", F.concat_ws("\n", "repo", "path")).join(_components(needed, roots).hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    dealt = placed.join(roots.select("repo", "sha", F.lit(True).alias("whole")), ["repo", "sha"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    groups = max(1, -(-needed.count() // GROUP_ROWS))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(groups))).drop("node", "component")
    return dealt.groupBy("part").applyInPandas(run, "logical_id string, path string, priors array<string>, confidence double, copied_from string")
