"""Operators as SQL over named tables.

An operator is one SELECT whose inputs stand in braces.  ``Engine`` builds it lazily on Spark: each input is a
fact table that was given, or another operator; Catalyst sees one plan.  ``statement`` writes the same operator with its
inputs as one self-contained statement, for any other SQL engine that is to check it.  Functions whose names differ between engines are written
``@name`` and listed in ``DIALECTS``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kenmap.params import Params
from kenmap.plans.storage import bucketed, kept

_INPUT = re.compile(r"\{([a-z_]\w*)\}")
_BRACES = re.compile(r"\{([a-z_]\w*)\}|[{}]")
_PARAM = re.compile(r":(\w+)\b")

#: name: (Spark, DuckDB); %s are the arguments.
DIALECTS: dict[str, tuple[str, str]] = {
    "days": ("((unix_micros(cast(%s as timestamp)) - unix_micros(cast(%s as timestamp))) / 8.64e10)", "((epoch_us(%s) - epoch_us(%s)) / 8.64e10)"),
    "joined": ("array_join(array_sort(collect_set(%s)), ',')", "coalesce(string_agg(DISTINCT %s, ',' ORDER BY %s), '')"),
    "matches": ("(%s RLIKE %s)", "regexp_matches(%s, %s)"),
    "sha": ("sha2(%s, 256)", "sha256(%s)"),
    "sorted_list": ("array_join(array_sort(split(%s, ',')), ',')", "array_to_string(list_sort(string_split(%s, ',')), ',')"),
    "explode": ("explode(%s)", "unnest(%s)"),
    "parts": ("split(%s, %s)", "string_split(%s, %s)"),
    "size": ("size(%s)", "len(%s)"),
    "series": ("sequence(%s, %s)", "range(%s, %s + 1)"),
    "replace_all": ("regexp_replace(%s, %s, %s)", "regexp_replace(%s, %s, %s, 'g')"),
    "extract": ("regexp_extract(%s, %s, %s)", "regexp_extract(%s, %s, %s)"),
    "json_text": ("get_json_object(%s, %s)", "json_extract_string(%s, %s)"),
    "raw": ("r%s", "%s"),
    "str": ("cast(%s as string)", "cast(%s as varchar)"),
    "prefix": ("array_join(slice(split(%s, '/'), 1, %s), '/')", "array_to_string(string_split(%s, '/')[1:%s], '/')"),
    "depth": ("(size(split(%s, '/')) - 1)", "(len(string_split(%s, '/')) - 1)"),
    "contains": ("contains(%s, %s)", "contains(%s, %s)"),
}


_MACRO = re.compile("@(" + "|".join(DIALECTS) + r")\(")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose bracket opens at ``at``, and the place behind it."""
    depth, start, quoted, out = 0, at + 1, False, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError(text[at : at + 80])


def in_dialect(sql: str, which: int) -> str:
    """``sql`` with each @name written for engine 0 (Spark) or 1 (DuckDB)."""
    while found := list(_MACRO.finditer(sql)):
        name, at = found[-1], found[-1].start()  # inner calls stand further right
        args, end = _arguments(sql, name.end() - 1)
        form = DIALECTS[name[1]][which]
        args += args[-1:] * (form.count("%s") - len(args))
        sql = sql[:at] + form % tuple(args[: form.count("%s")]) + sql[end:]
    return sql


@dataclass(frozen=True)
class Operator:
    name: str
    sql: str
    doc: str = ""
    #: Where Spark's SQL can't say it: makes the table of the inputs' tables, by name.
    build: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    #: The same SELECT over steps that Spark shares between operators, for engines that pin; ``sql`` stays the definition.
    shared: str = ""

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys(_INPUT.findall(self.sql)))


def _literal(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value}e0" if isinstance(value, float) else str(value)


def with_params(sql: str, params: Params) -> str:
    known = asdict(params)
    return _PARAM.sub(lambda m: _literal(known[m[1]]) if m[1] in known else m[0], sql)


@dataclass
class Engine:
    """Operators over the fact tables ``facts`` (name: DataFrame)."""

    spark: SparkSession
    operators: Mapping[str, Operator]
    facts: dict[str, DataFrame]
    params: Params = field(default_factory=Params)
    #: Owner-level results that many steps of one report read: written once to the checkpoint folder, which also keeps the plans above them small.
    pinned: frozenset[str] = frozenset({"scored", "winners", "drift", "findings"})

    #: Steps that are read again as files, in buckets by their path: wide tables of which each reader takes some columns and rows and groups them by path.
    stored: frozenset[str] = frozenset({"line_items", "events"})
    #: Steps of at most a row a person: sent to all tasks, as a join by person would gather each person's whole history in one task.
    small: frozenset[str] = frozenset({"bot_authors", "mechanical_authors"})
    #: Buckets of the stored steps; as many as a shuffle has partitions where it is 0.
    parts: int = 0

    def table(self, name: str) -> DataFrame:
        if name not in self.facts:
            op = self.operators[name]
            text = op.shared if op.shared and self.pinned else op.sql
            sql = with_params(in_dialect(text, 0), self.params)
            plain = _BRACES.sub(lambda m: m[0] if m[1] else 2 * m[0], sql)  # other braces are ordinary text
            inputs = {i: F.broadcast(self.table(i)) if i in self.small else self.table(i) for i in dict.fromkeys(_INPUT.findall(text))}
            made = op.build(inputs) if op.build else self.spark.sql(plain, **inputs)
            with self._as_it_lies(name == "scored" and bool(self.pinned)):
                self.facts[name] = kept(made) if name in self.pinned else self._stored(made) if self.pinned and name in self.stored else made
        return self.facts[name]

    @contextmanager
    def _as_it_lies(self, yes: bool) -> Iterator[None]:
        """Let joins by path and person take what lies in buckets by path as it lies; only for steps all of whose large inputs do."""
        setting = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(setting)
        if yes:
            self.spark.conf.set(setting, "false")
        try:
            yield
        finally:
            self.spark.conf.set(setting, before)

    def _stored(self, made: DataFrame) -> DataFrame:
        return bucketed(made, "path", self.parts or int(self.spark.conf.get("spark.sql.shuffle.partitions")))


def statement(operators: Mapping[str, Operator], name: str, params: Params, which: int = 1) -> str:
    """One statement for ``name``: its inputs as common table expressions; what is no operator is a table of the database."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in operators and n not in order:
            for i in operators[n].inputs:
                visit(i)
            order.append(n)

    visit(name)
    text = {n: _INPUT.sub(r"\1", with_params(in_dialect(operators[n].sql, which), params)) for n in order}
    return "WITH " + ",\n".join(f"{n} AS ({text[n]})" for n in order) + f"\nSELECT * FROM {name}"
