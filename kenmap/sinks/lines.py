"""Documents of any size, line by line: each row of a report is one line, made by column expressions and written in order by all tasks.

``documents`` makes the same formats as one text from a few rows; here no row passes the driver.  The annotations of a run alone have a bound, which is
their reader's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kenmap.sinks.documents import ANNOTATIONS

_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: kind: (first line, last line, whether entries are parted by commas)
FRAMES = {
    "sarif": ('{"$schema":"' + _SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":{"name":"kenmap"}},"automationDetails":{"id":"report"},"results":[', "]}]}", True),
    "junit": ('<?xml version="1.0" encoding="UTF-8"?><testsuite name="report">', "</testsuite>", False),
    "baseline": ("[", "]", True),
    "annotations": (None, None, False),
    "rule_file": ("# Generated from observed ownership.", None, False),
    "dot": ("graph knowledge {", "}", False),
    "graphml": ('<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">', "</graph></graphml>", False),
}


def _xml(c: str) -> Column:
    return F.expr(f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')")


def _dot(c: str) -> Column:
    return F.expr(f"""replace(replace({c}, '\\\\', '\\\\\\\\'), '"', '\\\\"')""")


def finding_lines(findings: DataFrame) -> DataFrame:
    """kind, key, line of all findings (rule, path, owners, fingerprint): SARIF results, JUnit cases, accepted entries, and the first annotations."""
    key = F.concat_ws("\t", "rule", "path", "owners").alias("key")
    result = F.to_json(F.expr("""named_struct('ruleId', rule, 'level', 'warning', 'message', named_struct('text', rule),
        'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', path), 'region', named_struct('startLine', 1)))), 'partialFingerprints', named_struct('identity/v1', fingerprint))"""))
    case = F.concat(F.lit('<testcase classname="'), _xml("rule"), F.lit('" name="'), _xml("path"), F.lit('"><failure message="'), _xml("rule"), F.lit('"/></testcase>'))
    entry = F.to_json(F.expr("named_struct('rule', rule, 'path', path, 'owners', filter(split(owners, ','), o -> o <> ''))"))
    every = [findings.select(F.lit(kind).alias("kind"), key, line.alias("line")) for kind, line in (("sarif", result), ("junit", case), ("baseline", entry))]
    safe = "replace(replace(replace({0}, '%', '%25'), '\\r', '%0D'), '\\n', '%0A')"
    shown = findings.orderBy("rule", "path", "owners").limit(ANNOTATIONS).select(F.lit("annotations").alias("kind"), key, F.expr(f"concat('::warning file=', {safe.format('path')}, ',line=1::', {safe.format('rule')})").alias("line"))
    return every[0].union(every[1]).union(every[2]).union(shown)


def edge_lines(edges: DataFrame) -> DataFrame:
    """kind, key, line of all edges (src, dst, relations) as DOT and GraphML; nodes of GraphML come before its edges."""
    key = F.concat_ws("\t", F.lit("1"), "src", "dst")
    dot = F.concat(F.lit('  "'), _dot("src"), F.lit('" -- "'), _dot("dst"), F.lit('" [label="'), _dot("relations"), F.lit('"];'))
    link = F.concat(F.lit('<edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"/>'))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select(F.lit("graphml").alias("kind"), F.concat_ws("\t", F.lit("0"), "node").alias("key"), F.concat(F.lit('<node id="'), _xml("node"), F.lit('"/>')).alias("line"))
    return edges.select(F.lit("dot").alias("kind"), key.alias("key"), dot.alias("line")).union(nodes).union(edges.select(F.lit("graphml"), key, link))


def rule_lines(rules: DataFrame) -> DataFrame:
    """kind, key, line of a rule file of all rows (pattern, owners): the catch-all first, then by length and text, as the last match counts."""
    key = F.expr("concat(lpad(if(pattern = '*', 0, length(pattern)), 9, '0'), '\\t', pattern)")
    return rules.select(F.lit("rule_file").alias("kind"), key.alias("key"), F.expr("concat(replace(pattern, ' ', '\\\\ '), ' ', replace(owners, ',', ' '))").alias("line"))


def write(lines: DataFrame, kind: str, at: str) -> None:
    """The whole document of one kind as text files whose names are in its order: what a reader of the folder gets as one text."""
    first, last, commas = FRAMES[kind]
    rows = lines.where(F.col("kind") == kind).select("key", "line")
    if commas:
        start = rows.agg(F.min("key").alias("start"))  # one row
        rows = rows.join(F.broadcast(start)).select("key", F.expr("if(key = start, line, concat(',', line))").alias("line"))
    frame = [(p, t) for p, t in ((0, first), (2, last)) if t is not None]
    ends = rows.sparkSession.createDataFrame(frame, "place int, line string").select("place", F.lit("").alias("key"), "line")
    ends.union(rows.select(F.lit(1).alias("place"), "key", "line")).orderBy("place", "key", "line").select("line").write.text(at)
