"""Readers of exported platform pages (one JSON document a row), with DataFrame functions.

Exports stand in for a live interface: a page that is no JSON, or lacks its list, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PULLS = """struct<repository:struct<pullRequests:struct<nodes:array<struct<number:bigint,createdAt:string,updatedAt:string,closedAt:string,changedLines:int,
  reviews:struct<nodes:array<struct<author:struct<login:string>,submittedAt:string>>>,files:struct<nodes:array<struct<path:string>>>>>>>>"""
#: Statuses of files that a change leaves in the tree.
LIVING = ("added", "modified", "renamed", "copied", "changed")


def pull_pages(raw: DataFrame, since: str | None, as_of: str, column: str = "value") -> DataFrame:
    """number, opened, closed, lines, reviewers, paths of the pulls that closed in [since, as_of].

    A pull without a closing time counts by its last update; one that was last updated before ``since`` is left out.
    """
    nodes = raw.select(F.explode(F.from_json(column, PULLS)["repository"]["pullRequests"]["nodes"]).alias("n")).select(
        F.col("n.number").alias("number"), F.expr("try_to_timestamp(n.createdAt)").alias("opened"), F.expr("try_to_timestamp(n.updatedAt)").alias("updated"), F.expr("try_to_timestamp(n.closedAt)").alias("closed_at"),
        F.col("n.changedLines").alias("lines"), F.expr("filter(transform(n.reviews.nodes, x -> x.author.login), x -> x is not null)").alias("reviewers"), F.expr("filter(transform(n.files.nodes, x -> x.path), x -> x is not null)").alias("paths"),
    )
    dated = nodes.where("updated is not null").withColumn("closed", F.coalesce("closed_at", "updated")).where(F.col("closed") <= F.lit(as_of).cast("timestamp"))
    if since is not None:
        dated = dated.where((F.col("updated") >= F.lit(since).cast("timestamp")) & (F.col("closed") >= F.lit(since).cast("timestamp")))
    return dated.select("number", "opened", "closed", "lines", "reviewers", "paths").dropDuplicates(["number"])


def review_counts(pulls: DataFrame) -> DataFrame:
    """path, author, n: in how many pulls a reviewer saw a path."""
    pairs = pulls.select("number", F.explode(F.array_distinct("paths")).alias("path"), "reviewers").select("number", "path", F.explode(F.array_distinct("reviewers")).alias("author"))
    return pairs.groupBy("path", "author").agg(F.count("*").alias("n"))


def pull_files(raw: DataFrame, column: str = "value") -> DataFrame:
    """path of the files that a pull leaves in the tree, each once."""
    items = raw.select(F.explode(F.from_json(column, "array<struct<filename:string,status:string>>")).alias("f"))
    return items.where(F.col("f.status").isin(*LIVING) & F.col("f.filename").isNotNull()).select(F.col("f.filename").alias("path")).distinct()


def teams(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """teams (slug, parent, visible) and team_members (slug, login); a team whose members could not be listed is not visible."""
    rows = raw.select(F.explode(F.from_json(column, "array<struct<slug:string,parent:struct<slug:string>,members:array<struct<login:string>>>>")).alias("t")).where("t.slug <> ''")
    found = rows.select(F.col("t.slug").alias("slug"), F.col("t.parent.slug").alias("parent"), F.col("t.members").isNotNull().alias("visible")).dropDuplicates(["slug"])
    return found, rows.select(F.col("t.slug").alias("slug"), F.explode("t.members.login").alias("login")).where("login <> ''").distinct()


def members(raw: DataFrame, column: str = "value") -> DataFrame:
    """login of the members of an organisation."""
    return raw.select(F.explode(F.from_json(column, "array<struct<login:string>>")["login"]).alias("login")).where("login <> ''").distinct()


def rule_errors(raw: DataFrame, column: str = "value") -> DataFrame:
    """line_no, kind, message of the syntax errors that the platform reports for a rule file."""
    return raw.select(F.explode(F.from_json(column, "struct<errors:array<struct<line:int,kind:string,message:string>>>")["errors"]).alias("e")).select(F.col("e.line").alias("line_no"), F.col("e.kind").alias("kind"), F.col("e.message").alias("message"))


def review_required(rulesets: DataFrame, protection: DataFrame, column: str = "value") -> DataFrame:
    """One row: required where a ruleset or the branch protection asks for owners' reviews, unknown where one of them could not be read, else disabled."""
    rules = rulesets.select(F.explode_outer(F.from_json(column, "array<struct<type:string,parameters:struct<require_code_owner_review:boolean>>>")).alias("r"))
    asked = rules.agg(F.max(F.coalesce(F.col("r.parameters.require_code_owner_review"), F.lit(False))).alias("a"), F.count("r").alias("n"))
    held = protection.select(F.from_json(column, "struct<required_pull_request_reviews:struct<require_code_owner_reviews:boolean>>").alias("p")).agg(F.max(F.coalesce(F.col("p.required_pull_request_reviews.require_code_owner_reviews"), F.lit(False))).alias("b"), F.count("p").alias("m"))
    return asked.crossJoin(held).select(F.expr("case when a or b then 'required' when n = 0 or m = 0 then 'unknown' else 'disabled' end").alias("review"))  # one row each


def access(owners: DataFrame, raw: DataFrame, column: str = "value") -> DataFrame:
    """owner, access (write, read, invisible or unknown) of declared owners, from exported permissions (owner, permission; null: not visible)."""
    known = raw.select(F.from_json(column, "struct<owner:string,permission:string>").alias("p")).select(F.lower("p.owner").alias("name"), F.col("p.permission").alias("permission"), F.lit(True).alias("seen"))
    joined = owners.select("owner").distinct().join(known, F.lower("owner") == F.col("name"), "left")
    level = "case when seen is null then 'unknown' when permission is null then 'invisible' when permission in ('admin', 'maintain', 'push', 'write') then 'write' else 'read' end"
    return joined.select("owner", F.expr(level).alias("access"))


class Budget:
    """How many requests a run may still make; once it is spent, the gap stays noted."""

    def __init__(self, limit: int) -> None:
        self.left, self.gaps = limit, set()

    def take(self) -> bool:
        if self.left <= 0:
            self.gaps.add("api_budget")
            return False
        self.left -= 1
        return True


def paged(fetch, budget: Budget, limit: int = 1000) -> list | None:
    """Items of all pages of ``fetch(cursor)`` -> (items, next cursor or None).

    At most ``limit`` of them, the interface's own bound.  None where the first page fails (None); what came before where a later one does or the budget ends.
    """
    out, cursor, first = [], None, True
    while (first or cursor is not None) and len(out) < limit:
        page = fetch(cursor) if budget.take() else None
        if page is None:
            return None if first else out
        items, cursor = page
        out += items
        first = False
    return out[:limit]
