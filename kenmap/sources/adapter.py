"""Fact tables from the star-schema tables: paths are parts, people are nations, commits are orders."""

from __future__ import annotations

from kenmap.functions.patterns import attribute_regex, exclude_regex, rule_regex, rule_supported, target_regex
from kenmap.plans.engine import Operator

#: (pattern, owners, source) in file order.
RULES = (
    ("/", "NATION_13", "generated"),
    ("*o*", "NATION_12", "generated"),
    ("/Brand#1/", "NATION_1,NATION_2", "manual"),
    ("ECONOMY/", "NATION_3", "generated"),
    ("/Brand#2/STANDARD/", "", "generated"),
    ("*ring*", "NATION_4,NATION_5", "generated"),
    ("/Nowhere/", "NATION_6", "generated"),
    ("/Brand#1/", "NATION_7", "generated"),
    ("/Brand#17/PROMO/*", "NATION_8", "manual"),
    ("/Brand#2*/**/blue*", "NATION_9,NATION_10", "generated"),
    ("!/Brand#3/", "NATION_11", "generated"),
    ("/Brand#11/", "world/EUROPE", "generated"),
    ("/Brand#12/ECONOMY*/", "world/ATLANTIS,NATION_3", "generated"),
)
CRITICALITY = (("Brand#1*", 1.0), ("Brand#2/PROMO", 0.9), ("*/ECONOMY/*", 0.1))
EXCLUDES = ("Brand#25/*", "*-1??7")


def _text(value: str | None) -> str:
    return "CAST(NULL AS varchar(9))" if value is None else "@raw('" + value.replace("'", "''") + "')" if "\\" in value else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) or v is None else str(v).lower() if isinstance(v, bool) else f"{v}e0" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + f") AS v({names})"


def _first_directory(pattern: str) -> str | None:
    first = pattern.lstrip("/").split("/")[0]
    literal = "/" in pattern.strip("/") or pattern.startswith("/")
    return first if literal and not set(first) & set("*?\\") else None


_RULES = [(i + 1, p, rule_regex(p), _first_directory(p), rule_supported(p), o, s) for i, (p, o, s) in enumerate(RULES)]
#: A few parts stand for files that one person alone works on, and for manifests one directory deeper.
_PATH = "CASE WHEN p.p_partkey % 97 = 0 THEN 'Solo' ELSE p.p_brand END || '/' || p.p_type || '/' || p.p_name || '-' || @str(p.p_partkey) || CASE WHEN p.p_partkey % 53 = 0 THEN '/Dockerfile' ELSE '' END"
_WHO = "CASE WHEN p.p_partkey % 97 = 0 THEN 'NATION_1' ELSE n.n_name END"
_LINES = "lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey JOIN part AS p ON l.l_partkey = p.p_partkey"

FACTS: dict[str, str] = {
    "events_all": f"SELECT DISTINCT {_PATH} AS path, CASE WHEN o.o_orderkey % 50 = 0 AND o.o_orderdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'NATION_99' ELSE {_WHO} END AS author, o.o_orderkey AS sha, CAST(o.o_orderdate AS TIMESTAMP) AS ts FROM {_LINES} JOIN supplier AS s ON l.l_suppkey = s.s_suppkey JOIN nation AS n ON s.s_nationkey = n.n_nationkey",
    "commits": "SELECT o.o_orderkey AS sha, n.n_name AS author, CAST(o.o_orderdate AS TIMESTAMP) AS ts, CASE WHEN o.o_orderkey % 12 = 0 THEN 2 ELSE 1 END AS parents, CASE WHEN o.o_orderkey % 3 = 0 OR c.c_nationkey = 3 THEN 'Bump release v' || @str(o.o_orderkey % 7) || '.1' ELSE 'Change ' || o.o_orderpriority || ' (#' || @str(o.o_orderkey) || ')' END AS subject FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey",
    "tracked": f"SELECT DISTINCT {_PATH} AS path FROM part AS p",
    "blame_lines": f"SELECT {_PATH} AS path, {_WHO} AS author, sum(l.l_quantity) AS n_lines FROM {_LINES} JOIN supplier AS s ON l.l_suppkey = s.s_suppkey JOIN nation AS n ON s.s_nationkey = n.n_nationkey WHERE l.l_linestatus = 'F' GROUP BY 1, 2",
    "blame_then": f"SELECT {_PATH} AS path, {_WHO} AS author, sum(l.l_quantity) AS n_lines FROM {_LINES} JOIN supplier AS s ON l.l_suppkey = s.s_suppkey JOIN nation AS n ON s.s_nationkey = n.n_nationkey WHERE l.l_returnflag <> 'N' GROUP BY 1, 2",
    "blame_before": f"SELECT {_PATH} AS path, {_WHO} AS author, sum(l.l_quantity) AS n_lines FROM {_LINES} JOIN supplier AS s ON l.l_suppkey = s.s_suppkey JOIN nation AS n ON s.s_nationkey = n.n_nationkey WHERE l.l_linestatus = 'F' AND o.o_orderkey % 11 <> 0 GROUP BY 1, 2",
    "review_counts": f"SELECT {_PATH} AS path, {_WHO} AS author, count(*) AS n FROM {_LINES} JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE l.l_returnflag = 'R' GROUP BY 1, 2 UNION ALL SELECT {_PATH}, 'NATION_' || @str(p.p_partkey % 5), 40 FROM part AS p WHERE p.p_partkey % 9 = 0",
    "rules": _values(_RULES, "line_no, pattern, rx, top, supported, owners, source"),
    "criticality": _values([(i, target_regex(p), rule_regex(p), w) for i, (p, w) in enumerate(CRITICALITY)], "ord, rx, rule_rx, weight"),
    "exclude_rules": _values([(p, exclude_regex(p)) for p in EXCLUDES], "pattern, rx"),
    "baseline": "SELECT 'single-expert' AS rule, path, '' AS owners FROM (SELECT DISTINCT " + _PATH + " AS path, p.p_partkey FROM part AS p WHERE p.p_partkey % 5 = 0) AS b UNION ALL SELECT 'changed-drift', '/Brand#1/', 'nation_1,nation_2' UNION ALL SELECT 'shadowed-rule', '/Brand#1/', 'somebody else'",
    "suppressions": "SELECT rule, path, rx, CAST(expires AS DATE) AS expires FROM (" + _values([("single-expert", "Brand#3/", rule_regex("/Brand#3/"), "2030-01-01"), ("shadowed-rule", "ECONOMY/", rule_regex("ECONOMY/"), "2001-01-01")], "rule, path, rx, expires") + ") AS s",
    "pulls": "SELECT o.o_orderkey AS number, CASE WHEN o.o_orderkey % 5 = 0 THEN 'NATION_7' ELSE n.n_name END AS reviewer, CAST(o.o_orderdate AS TIMESTAMP) AS opened, CASE WHEN o.o_orderstatus <> 'P' THEN CAST(l.l_shipdate AS TIMESTAMP) END AS closed, CAST(round(l.l_quantity) AS INT) AS lines FROM orders AS o JOIN (SELECT l_orderkey, max(l_shipdate) AS l_shipdate, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey) AS l ON o.o_orderkey = l.l_orderkey JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey",
    "teams": "SELECT r_name AS slug, 'world' AS parent FROM region UNION ALL SELECT 'world', CAST(NULL AS varchar(9))",
    "team_members": "SELECT r.r_name AS slug, n.n_name AS login FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey",
    "identities": "SELECT s_name AS identity, CASE WHEN s_suppkey % 4 = 0 THEN @str(s_suppkey) || '+sup' || @str(s_suppkey % 40) || '@users.noreply.example.com' ELSE 'sup' || @str(s_suppkey % 40) || '@mail.example.com' END AS email, 'Name ' || @str(s_suppkey % 30) AS name FROM supplier",
}

FACTS |= {
    "security": _values([(target_regex(p),) for p in ("Brand#1", "*/PROMO/*")], "rx"),
    "roster": "SELECT n_name AS identity, '@handle' || @str(n_nationkey % 20) AS handle, n_nationkey % 3 <> 0 AS certain FROM nation",
    "moves": f"SELECT p.p_partkey AS sha, 60 + p.p_size % 40 AS similarity, p.p_type || '/' || p.p_name AS old_path, {_PATH} AS path FROM part AS p WHERE p.p_partkey % 10 = 0",
}
FACTS |= {
    "extra_bots": "SELECT 'nation_24' AS author",
    "modifications": f"SELECT DISTINCT o.o_orderkey AS sha, {_PATH} AS path FROM {_LINES} UNION ALL SELECT 0, {_PATH} FROM part AS p WHERE p.p_partkey % 10 <> 0",
    "roster_status": _values([("@nation_5", "former"), ("NATION_9", "external")], "identity, status"),
    "org_members": "SELECT n_name AS login FROM nation",
    "flags": _values([("absent_token",), ("missing_mailmap",), ("absent_token",)], "code"),
    "import_edges": "\n UNION ALL ".join(f"SELECT {_PATH.replace('p.', 'a.')} AS dependent, {_PATH} AS dependency FROM part AS p JOIN part AS a ON a.p_partkey = {e}" for e in ("2 * p.p_partkey", "3 * p.p_partkey + 1", "p.p_partkey + 25 AND a.p_brand = p.p_brand", "p.p_partkey / 2 AND p.p_partkey % 16 = 0")),
    "attr_rules": _values([("", 1, attribute_regex("*ring*"), "linguist-generated", True), ("", 2, attribute_regex("*"), "text", True), ("Brand#4", 1, attribute_regex("*ring*"), "linguist-generated", False), ("Brand#5", 1, attribute_regex("STANDARD"), "linguist-vendored", True)], "dir, line, rx, attr, value"),
    "owners_files": _values([("Brand#1", "NATION_1"), ("Brand#1/PROMO", "NATION_2"), ("Brand#1/PROMO", "NATION_3"), ("Brand#2", "NATION_4"), ("", "NATION_0")], "dir, owner"),
    "nested_rules": _values([("Brand#1", 1, rule_regex("*"), "NATION_13"), ("Brand#1", 2, rule_regex("/PROMO/"), "NATION_14"), ("Brand#1/PROMO", 1, rule_regex("*ring*"), "NATION_15")], "dir, line, rx, owner"),
    "blobs": f"SELECT {_PATH} AS path, @str(p.p_size) AS blob FROM part AS p",
    "blobs_before": f"SELECT {_PATH} AS path, @str(CASE WHEN p.p_partkey % 4 = 0 THEN p.p_size + 1 ELSE p.p_size END) AS blob FROM part AS p WHERE p.p_partkey % 11 <> 0",
    "policy": _values([("drift", "block"), ("single_expert", "warn")], "check_name, level"),
    "overrides": "SELECT s_name AS identity, '@owner' || @str(s_suppkey % 9) AS handle FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT 'nobody', '@nobody'",
    "handle_cache": "SELECT s_name AS identity, CASE WHEN s_suppkey % 3 = 0 THEN '@c' || @str(s_suppkey) END AS handle, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2001-07-30 00:00:00' ELSE TIMESTAMP '2001-06-01 00:00:00' END AS seen FROM supplier",
    "separations": "SELECT min(s_name) AS a, max(s_name) AS b FROM supplier WHERE s_suppkey % 54 = 0",
    "hits": "SELECT s_name AS identity, '@hit' || @str(s_suppkey % 7) AS handle, CASE WHEN s_suppkey % 2 = 0 THEN 'search' ELSE 'commit' END AS source FROM supplier WHERE s_suppkey % 5 = 0",
    "queries": _values([("@nation_4",), ("NATION_6@mail.example.com",), ("somebody",)], "query"),
    "repository": _values([(1_204, "unknown")], "file_bytes, review"),
}
#: Every tenth part has had three names; touches name it as it was called then.  Some of these files also swap names, end, move away and back, or are moved over.
_OLD, _MID = (f"'{d}/' || p.p_type || '/' || p.p_name || '-' || @str(p.p_partkey)" for d in ("old", "mid"))
_MID_NEXT = "'mid/' || q.p_type || '/' || q.p_name || '-' || @str(q.p_partkey)"


def _moves(at: str, kind: str, source: str, dest: str, where: str, tables: str = "part AS p") -> str:
    return f"SELECT TIMESTAMP '{at} 00:00:00' AS ord, '{kind}' AS kind, {source} AS source, {dest} AS dest FROM {tables} WHERE {where}"


FACTS |= {
    "touches": f"SELECT DISTINCT CASE WHEN p.p_partkey % 10 <> 0 OR o.o_orderdate >= TIMESTAMP '2001-03-01 00:00:00' THEN {_PATH} WHEN o.o_orderdate < TIMESTAMP '2000-11-01 00:00:00' THEN {_OLD} ELSE {_MID} END AS path, {_WHO} AS author, o.o_orderkey AS sha, CAST(o.o_orderdate AS TIMESTAMP) AS ts FROM {_LINES} JOIN supplier AS s ON l.l_suppkey = s.s_suppkey JOIN nation AS n ON s.s_nationkey = n.n_nationkey",
    "path_moves": "\n UNION ALL ".join((
        _moves("2000-11-01", "R", _OLD, _MID, "p.p_partkey % 10 = 0"),
        _moves("2001-01-15", "R", _MID, _MID_NEXT, "p.p_partkey % 40 = 0", "part AS p JOIN part AS q ON q.p_partkey = p.p_partkey + 10"),
        _moves("2001-01-15", "R", _MID_NEXT, _MID, "p.p_partkey % 40 = 0", "part AS p JOIN part AS q ON q.p_partkey = p.p_partkey + 10"),
        _moves("2001-02-01", "D", _MID, "CAST(NULL AS varchar(9))", "p.p_partkey % 70 = 0"),
        _moves("2001-03-01", "R", _MID, _PATH, "p.p_partkey % 10 = 0"),
        _moves("2001-04-01", "R", "'tmp/' || @str(p.p_partkey)", _PATH, "p.p_partkey % 110 = 0"),
        _moves("2001-05-01", "R", _PATH, _OLD, "p.p_partkey % 90 = 0"),
        _moves("2001-06-01", "R", _OLD, _PATH, "p.p_partkey % 90 = 0"),
    )),
}
#: Most facts stand on the lines with their order, path and the nations of their supplier and customer.  Spark joins these once and by merge at any size, so what is shuffled grows with the lines; the facts then read the columns and rows they need.
#: A line without a supplier or customer stays; where a key has several of them, a line stands there once for each, and a fact on the suppliers reads each with the first customer alone (on the customers: with the first supplier).
_SUPPLIERS = "SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY s_nationkey) AS nth FROM supplier"
_CUSTOMERS = "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_custkey ORDER BY c_nationkey) AS nth FROM customer"
_ORDERED = f"SELECT /*+ MERGE(c) */ o.o_orderkey, o.o_orderdate, c.c_nationkey, coalesce(c.nth, 1) = 1 AS first_customer FROM orders AS o LEFT JOIN ({_CUSTOMERS}) AS c ON o.o_custkey = c.c_custkey"
LINE_ITEMS = f"SELECT /*+ MERGE(s, o, p) */ {_PATH} AS path, p.p_partkey % 97 = 0 AS solo, o.o_orderkey AS sha, CAST(o.o_orderdate AS TIMESTAMP) AS ts, s.s_nationkey, coalesce(s.nth, 1) = 1 AS first_supplier, o.c_nationkey, o.first_customer, l.l_quantity, l.l_linestatus, l.l_returnflag FROM lineitem AS l LEFT JOIN ({_SUPPLIERS}) AS s ON l.l_suppkey = s.s_suppkey JOIN ({_ORDERED}) AS o ON l.l_orderkey = o.o_orderkey JOIN part AS p ON l.l_partkey = p.p_partkey"
_BY = "CASE WHEN l.solo THEN 'NATION_1' ELSE n.n_name END"
_SUPPLIED = "{line_items} AS l JOIN nation AS n ON l.s_nationkey = n.n_nationkey AND l.first_customer"
SHARED = {
    "events_all": f"SELECT DISTINCT l.path, CASE WHEN l.sha % 50 = 0 AND l.ts < TIMESTAMP '1999-01-01 00:00:00' THEN 'NATION_99' ELSE {_BY} END AS author, l.sha, l.ts FROM {_SUPPLIED}",
    "blame_lines": f"SELECT l.path, {_BY} AS author, sum(l.l_quantity) AS n_lines FROM {_SUPPLIED} WHERE l.l_linestatus = 'F' GROUP BY 1, 2",
    "blame_then": f"SELECT l.path, {_BY} AS author, sum(l.l_quantity) AS n_lines FROM {_SUPPLIED} WHERE l.l_returnflag <> 'N' GROUP BY 1, 2",
    "blame_before": f"SELECT l.path, {_BY} AS author, sum(l.l_quantity) AS n_lines FROM {_SUPPLIED} WHERE l.l_linestatus = 'F' AND l.sha % 11 <> 0 GROUP BY 1, 2",
    "review_counts": f"SELECT l.path, {_BY} AS author, count(*) AS n FROM {{line_items}} AS l JOIN nation AS n ON l.c_nationkey = n.n_nationkey AND l.first_supplier WHERE l.l_returnflag = 'R' GROUP BY 1, 2" + FACTS["review_counts"][FACTS["review_counts"].index(" UNION ALL "):],
    "modifications": "SELECT DISTINCT l.sha, l.path FROM {line_items} AS l" + FACTS["modifications"][FACTS["modifications"].index(" UNION ALL "):],
}
OPERATORS = {name: Operator(name, sql, "Fact table from the star schema.", shared=SHARED.get(name, "")) for name, sql in FACTS.items()}
OPERATORS["line_items"] = Operator("line_items", LINE_ITEMS, "The lines with their order, path and nations, from the star schema.")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
