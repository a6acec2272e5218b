"""Readers of text exports, with DataFrame functions: history logs, line attribution, rule files, attributes."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kenmap.functions.patterns import attribute_regex, rule_regex, rule_supported

RECORD, FIELD = "\x1e", "\x1f"


def history(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """commits and commit_files of exported logs.

    A record is RECORD sha FIELD name TAB mail FIELD ISO time FIELD parents FIELD subject FIELD body FIELD file lines; records with a bad
    time, no author or a wrong hash are dropped.  File lines: status TAB path, or status TAB old TAB new.
    """
    parts = raw.select(F.posexplode(F.split(column, RECORD)).alias("ord", "chunk")).select("ord", F.split("chunk", FIELD).alias("f")).where("size(f) >= 7")
    commits = parts.select(
        F.trim(F.col("f")[0]).alias("sha"),
        F.lower(F.split(F.col("f")[1], "\t")[1]).alias("author"),
        F.split(F.col("f")[1], "\t")[0].alias("author_name"),
        F.expr("try_to_timestamp(f[2])").alias("ts"),
        F.expr("size(filter(split(f[3], ' '), x -> x <> ''))").alias("parents"),
        F.col("f")[4].alias("subject"),
        F.col("f")[5].alias("body"),
        F.col("ord").cast("long").alias("ord"),
        F.col("f")[6].alias("__files"),
    ).where("sha rlike '^[0-9a-f]{40}$' and author <> '' and ts is not null")
    lines = commits.select("sha", F.explode(F.split("__files", "\n")).alias("line")).select("sha", F.split("line", "\t").alias("p")).where("size(p) >= 2")
    files = lines.select(
        "sha",
        F.expr("substr(p[0], 1, 1)").alias("status"),
        F.expr("coalesce(try_cast(nullif(substr(p[0], 2), '') as int), 100)").alias("similarity"),
        F.expr("if(size(p) > 2, p[1], null)").alias("old_path"),
        F.expr("p[size(p) - 1]").alias("path"),
    )
    return commits.drop("__files"), files


def coauthors(commits: DataFrame) -> DataFrame:
    """sha, ord, name, email of the trailers in each body; one row an address, first spelling."""
    found = commits.select("sha", F.posexplode(F.expr(r"regexp_extract_all(body, '(?im)^co-authored-by:\\s*(.+?)\\s*<([^<>\\s]+)>\\s*$', 0)")).alias("ord", "line"))
    named = found.select("sha", "ord", F.regexp_extract("line", r"(?i)^co-authored-by:\s*(.+?)\s*<", 1).alias("name"), F.regexp_extract("line", r"<([^<>\s]+)>", 1).alias("email"))
    return named.withColumn("n", F.expr("row_number() over (partition by sha, lower(email) order by ord)")).where("n = 1").drop("n")


def credits(commits: DataFrame, trailers: DataFrame, mailmap: DataFrame) -> DataFrame:
    """sha, author, ts for the author and each co-author of a commit, addresses canonical, nobody twice."""
    everyone = commits.select("sha", "author", "ts").unionByName(trailers.join(commits.select("sha", "ts"), "sha").select("sha", F.lower("email").alias("author"), "ts"))
    mapped = everyone.join(mailmap.select(F.lower("raw_email").alias("author"), "canonical"), "author", "left") if mailmap is not None else everyone.withColumn("canonical", F.lit(None).cast("string"))
    return mapped.select("sha", F.coalesce("canonical", "author").alias("author"), "ts").dropDuplicates(["sha", "author"])


def attribution(raw: DataFrame, path: str = "path", column: str = "value") -> DataFrame:
    """path, author, sha, n_lines of porcelain line attributions (one whole text a path)."""
    lines = raw.select(F.col(path).alias("path"), F.posexplode(F.split(column, "\n")).alias("i", "line"))
    marked = lines.select(
        "path", "i", "line",
        F.expr("last(nullif(regexp_extract(line, '^([0-9a-f]{40}) [0-9]', 1), ''), true) over (partition by path order by i)").alias("sha"),
    )
    mails = marked.where("line like 'author-mail %'").select("path", "sha", F.lower(F.regexp_extract("line", "<([^>]*)>", 1)).alias("author")).distinct()
    counts = marked.where("line like '\t%'").groupBy("path", "sha").agg(F.count("*").alias("n_lines"))
    return counts.join(mails, ["path", "sha"]).select("path", "author", "sha", "n_lines")


MARKERS = {"# BEGIN GENERATED": ("generated", True), "# END GENERATED": ("generated", False), "# BEGIN MANUAL": ("manual", True), "# END MANUAL": ("manual", False)}


def marked_lines(content: str, markers: dict[str, tuple[str, bool]] = MARKERS) -> dict[int, str]:
    """Kind of block that each line lies in; lines outside of all blocks are not listed.

    A block that is closed before it is opened, opened twice, interrupted by a marker of another kind, repeated or never closed is an error.
    """
    inside: tuple[str, int] | None = None
    closed: set[str] = set()
    kinds: dict[int, str] = {}
    for number, line in enumerate(content.split("\n"), 1):
        marker = markers.get(line.strip())
        if marker is None:
            if inside:
                kinds[number] = inside[0]
            continue
        kind, opens = marker
        if inside is None:
            fault = "" if opens and kind not in closed else f"repeats a {kind} block" if opens else "closes no block"
        else:
            fault = f"stands inside the {inside[0]} block of line {inside[1]}" if kind != inside[0] else "opens an open block" if opens else ""
        if fault:
            raise ValueError(f"line {number}: {line.strip()!r} {fault}")
        if opens:
            inside = (kind, number)
        else:
            inside = None
            closed.add(kind)
    if inside:
        raise ValueError(f"line {inside[1]}: the {inside[0]} block is never closed")
    return kinds


def attributes(content: str, directory: str = "") -> list[tuple[str, int, str, str, bool]]:
    """dir, line, rx, attr, value of the attribute rules of one file (a small text): ``name`` sets, ``-name`` clears, ``name=value`` sets unless the value says no."""
    out = []
    for number, line in enumerate(content.split("\n"), 1):
        parts = line.split()
        if not parts or parts[0].startswith("#"):
            continue
        for word in parts[1:]:
            name, has_value, value = word.lstrip("-!").partition("=")
            out.append((directory, number, attribute_regex(parts[0]), name, not word.startswith(("-", "!")) and not (has_value and value.lower() in {"false", "0", "no", "off"})))
    return out


def owners_file(content: str) -> list[str]:
    """Owners that a per-directory file names: the first word with an @ of each line that is no comment."""
    rows = (line.split("#", 1)[0].split() for line in content.split("\n"))
    return [found for words in rows if (found := next((w for w in words if "@" in w), None))]


def modified_counts(raw: DataFrame, column: str = "value") -> DataFrame:
    """sha, modified: how many files each commit of a name-status log modifies (one whole log a row)."""
    lines = raw.select(F.monotonically_increasing_id().alias("log"), F.split(column, "\n").alias("all")).select("log", F.posexplode("all").alias("i", "line"))
    marked = lines.select("log", "i", "line", F.expr("last(nullif(regexp_extract(line, '^([0-9a-f]{40})$', 1), ''), true) over (partition by log order by i)").alias("sha"))
    return marked.where("sha is not null").groupBy("sha").agg(F.expr("count_if(line rlike '^M[\\t ]')").alias("modified"))


def import_statements(files: DataFrame) -> DataFrame:
    """path, level, module, name of each import in Python files (path, value), by their syntax tree; ``import a.b`` has no name, and a file that doesn't parse has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    tree = ast.parse(value or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.Import):
                        rows += [(path, 0, a.name, None) for a in node.names]
                    elif isinstance(node, ast.ImportFrom):
                        rows += [(path, node.level or 0, node.module or "", a.name) for a in node.names]
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["path", "level", "module", "name"])

    return files.where("path like '%.py'").select("path", "value").mapInArrow(run, "path string, level int, module string, name string")


def python_imports(files: DataFrame) -> DataFrame:
    """dependent, dependency of Python files (path, value): modules that are other files of the table; relative imports by their level.

    A name that is imported may be a module too.  The first path in order wins where two files make one module.
    """
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "[.]py$", ""), "(^|/)__init__$", ""), "/", ".")
    modules = files.where("path like '%.py'").groupBy(dotted.alias("module")).agg(F.min("path").alias("dependency")).where("module <> ''")
    folders = "slice(split(path, '/'), 1, size(split(path, '/')) - 1)"
    based = import_statements(files).withColumn("base", F.expr(f"if(level = 0 or level - 1 > size({folders}), '', array_join(slice({folders}, 1, size({folders}) - level + 1), '.'))"))
    whole = based.withColumn("whole", F.expr("concat_ws('.', nullif(base, ''), nullif(module, ''))"))
    named = whole.select("path", F.explode(F.expr("array(whole, if(name is null or name = '*' or whole = '', null, concat(whole, '.', name)))")).alias("module"))
    # the modules are as many as the files, while a short text that makes them looks small: they must not be broadcast
    return named.where("module <> ''").join(modules.hint("merge"), "module").where("path <> dependency").select(F.col("path").alias("dependent"), "dependency").distinct()


def rules(spark: SparkSession, content: str, sections: bool = False) -> DataFrame:
    """The ordered rules of one rule file (a small text): line_no, pattern, rx, top, supported, owners, source, section, approvals, optional.

    Blank lines and comments are skipped, a backslash keeps a space in a pattern; with ``sections`` headings name sections whose owners are defaults.
    """
    import re

    rows, section, approvals, optional, defaults, kinds = [], "", 0, False, "", marked_lines(content)
    for number, line in enumerate(content.split("\n"), 1):
        text = re.sub(r"(^|\s)#.*$", "", line).strip()
        heading = re.fullmatch(r"(\^)?\[([^\]]+)\](?:\[(\d+)\])?\s*(.*)", text) if sections else None
        if heading:
            optional, section, approvals, defaults = bool(heading[1]), heading[2], int(heading[3] or 1), ",".join(heading[4].split())
        elif text:
            pattern, *owners = [p.replace("\\ ", " ") for p in re.split(r"(?<!\\)\s+", text)]
            first = pattern.lstrip("/").split("/")[0]
            literal = ("/" in pattern.strip("/") or pattern.startswith("/")) and not set(first) & set("*?\\")
            rows.append((number, pattern, rule_regex(pattern), first if literal else None, rule_supported(pattern), ",".join(owners) or defaults, kinds.get(number, "unmarked"), section, approvals, optional))
    return spark.createDataFrame(rows, "line_no int, pattern string, rx string, top string, supported boolean, owners string, source string, section string, approvals int, optional boolean")


def tree(raw: DataFrame, column: str = "value") -> DataFrame:
    """path, blob of a tree listing: lines of mode, kind, id, TAB, path; other kinds than files are left out."""
    lines = raw.select(F.explode(F.split(column, "\n")).alias("line"))
    rx = r"^[0-7]{6} blob ([0-9a-f]{40,64})\s*\t(.+)$"
    return lines.select(F.regexp_extract("line", rx, 2).alias("path"), F.regexp_extract("line", rx, 1).alias("blob")).where("path <> ''")


def changed(files: DataFrame, excludes: list[str] = ()) -> DataFrame:
    """path of the files (status, path) that a change adds, copies, modifies or renames, but for those that an exclude pattern matches."""
    from kenmap.functions.patterns import target_regex

    kept = files.where("status in ('A', 'C', 'M', 'R')").select("path").distinct()
    for pattern in excludes:
        kept = kept.where(~F.col("path").rlike(target_regex(pattern)))
    return kept


def catalog_owner(raw: DataFrame, column: str = "value") -> DataFrame:
    """dir, owner of service descriptors (path, value): the field spec.owner of a small YAML text."""
    found = F.regexp_extract(column, r"(?m)^spec:[ \t]*\n(?:[ \t]+.*\n|[ \t]*\n)*?[ \t]+owner:[ \t]*['\"]?([^'\"\s#]+)", 1)
    return raw.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), found.alias("owner")).where("owner <> ''")
