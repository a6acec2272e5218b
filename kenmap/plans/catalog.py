"""All SQL operators, and the queries over the star-schema tables with their statements for another engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kenmap.operators import components, concentration, history, insight, ownership, people, policy, risk, rules
from kenmap.params import Params
from kenmap.plans import checks
from kenmap.plans.engine import Engine, Operator, in_dialect, statement
from kenmap.plans.schemas import SCHEMAS
from kenmap.sources import adapter

OPERATORS: dict[str, Operator] = {n: Operator(n, sql, doc) for module in (history, ownership, concentration, rules, risk, people, policy, insight) for n, (doc, sql) in module.SQL.items()}

OPERATORS["teams_below"] = replace(OPERATORS["teams_below"], build=lambda tables: components.below(tables["teams"].select(F.col("slug").alias("node"), "parent")).toDF("slug", "inner_slug"))

#: Operators that are steps of others and no report of their own.
STEPS = {"rule_teams", "rule_people", "gaps", "teams_below", "small_commits", "weighted_shares", "orphan_dirs", "ancestors", "ancestor_best", "periods", "uniform_dirs", "set_dirs", "leaders", "directory_leaders", "tracked_dirs", "left_shares", "departure_order", "departure_steps"}
ROUND = 6


#: Reports of one target directory: nothing below them is pinned, so the target reaches the scans of the history.
TARGETED = {"expertise", "explanation", "why_not", "match_chain", "mentors", "reviewer_suggestions", "outside_window", "outsider_blame", "threshold_knobs", "prerequisites", "onboarding", "onboarding_complexity", "team_resolution"}


def _views(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The star-schema tables in ``sf_dir``, each as the view of its name from now on."""
    tables = [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in adapter.TABLES]
    for name, table in zip(adapter.TABLES, tables):
        table.createOrReplaceTempView(name)
    return tables


def engine(spark: SparkSession, sf_dir: str, params: Params = Params(), pinned: bool = True) -> Engine:
    """An engine over the star-schema tables in ``sf_dir``; they are read lazily, columns and filters reach the scans."""
    _views(spark, sf_dir)
    made = Engine(spark, adapter.OPERATORS | OPERATORS, {}, params)
    return made if pinned else replace(made, pinned=frozenset())


#: Lines of the history for each partition of a shuffle, and bytes for each task that reads one: so a task's memory does not grow with the tables.
PARTITION_LINES, TASK_BYTES = 100_000, "16m"
#: Lines for each bucket of small tables, which have no more buckets than a shuffle has partitions.
BUCKET_LINES = 20_000


def sized(spark: SparkSession, lines: int) -> int:
    """Let shuffles have partitions by the size of the history; the settings are the session's, as Spark has no narrower place for them.

    Gives the buckets for that history: tables of few lines have few.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at_least = max(usual, lines // PARTITION_LINES)
    if at_least > int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(at_least))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    return max(lines // PARTITION_LINES, min(usual, lines // BUCKET_LINES + 1))


_SHARED: dict[tuple, tuple[tuple[str, ...], Engine]] = {}


def shared(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine of a session over ``sf_dir``, so reports of one session share the results that are pinned; files that are written anew (under new names) make a new one."""
    files = tuple(sorted(f for table in _views(spark, sf_dir) for f in table.inputFiles()))
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    held = _SHARED.get(key)
    if held is None or held[0] != files:
        parts = sized(spark, spark.table("lineitem").count())
        _SHARED[key] = (files, Engine(spark, adapter.OPERATORS | OPERATORS, {}, parts=parts))
    return _SHARED[key][1]


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in SCHEMAS[name].split(", ")]


def rounded(df: DataFrame, name: str) -> DataFrame:
    """The columns of a report in their published form: doubles to six digits (engines differ in the last bit of ``power`` and of sums), whole numbers as bigint, time stamps as text."""
    form = {"double": lambda c: F.round(c, ROUND), "bigint": lambda c: F.col(c).cast("bigint"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return df.select(*[form.get(k, F.col)(c).alias(c) for c, k in _columns(name)])


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded((engine(spark, sf_dir, pinned=False) if name in TARGETED else shared(spark, sf_dir)).table(name), name)

    run.__name__, run.__doc__ = name, OPERATORS[name].doc
    return run


QUERIES = {name: _query(name) for name in OPERATORS if name not in STEPS}


def oracle(name: str) -> str:
    """The statement of an operator for DuckDB, in the form of ``rounded``."""
    form = {"double": "round({0}, 6) AS {0}", "bigint": "CAST({0} AS BIGINT) AS {0}", "timestamp": "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"}
    text = statement(adapter.OPERATORS | OPERATORS | checks.OPERATORS, name, Params())
    return text[: text.rindex("SELECT * FROM")] + "SELECT " + ", ".join(form.get(k, "{0}").format(c) for c, k in _columns(name)) + f" FROM {name}"


def over(name: str, select: str, operators: dict[str, Operator] | None = None) -> str:
    """``select`` for DuckDB over the statement of the operator ``name``; ``operators`` stand in for some below it."""
    text = statement(adapter.OPERATORS | OPERATORS | checks.OPERATORS | (operators or {}), name, Params())
    return "WITH RECURSIVE" + text[len("WITH") : text.rindex("\nSELECT * FROM")] + (",\n" if select.lstrip().startswith("+") else "\n") + select.lstrip().removeprefix("+")


def oracle_text(fact: str) -> str:
    """A fact table of the adapter for DuckDB."""
    return in_dialect(adapter.FACTS[fact], 1)


ORACLES = {name: oracle(name) for name in QUERIES}
