"""Queries whose operators are folds, small graphs or streams; SQL for those that it can express."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kenmap.operators import ancestry, communities, components, graphs, lineage, moves
from kenmap.plans import catalog, storage
from kenmap.plans.engine import Engine, Operator
from kenmap.sinks import attribution, documents, incremental, lines
from kenmap.sources import adapter, text
from kenmap.streaming import ingest


def person_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities, betweenness and articulation people of the collaboration graph."""
    return graphs.person_graph(catalog.shared(spark, sf_dir).table("pair_weights"))


def path_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical files with their prior names: each part is created under its type and moved below its brand by its last order."""
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    files = spark.sql("""
        SELECT 'r' AS repo, lpad(hex(p_partkey * 2 + k), 40, '0') AS sha, if(k = 0, 'A', 'R') AS status, if(k = 0, 100, 60 + p_size % 40) AS similarity,
          if(k = 0, NULL, p_type || '/' || p_partkey) AS old_path, if(k = 0, p_type || '/' || p_partkey, p_brand || '/' || p_type || '/' || p_partkey) AS path
        FROM part LATERAL VIEW explode(array(0, 1)) AS k""")
    commits = files.select("repo", "sha", F.timestamp_seconds(F.conv("sha", 16, 10).cast("long")).alias("ts"))
    return lineage.lineage(commits, files)


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of people against the declared teams."""
    own = catalog.shared(spark, sf_dir)
    return graphs.topology(own.table("pair_weights"), own.table("team_members"))


def knowledge_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People whose departure splits the whole graph of people and paths, with a directory of each piece."""
    return components.knowledge_cuts(catalog.shared(spark, sf_dir).table("owners"))


def knowledge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten people between most pairs of nodes in the whole graph of people and paths."""
    return components.knowledge_betweenness(catalog.shared(spark, sf_dir).table("owners"))


def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of every tracked file behind its imports, and the cycles among all imports."""
    own = catalog.shared(spark, sf_dir)
    edges = own.table("dependencies").selectExpr("dependent as a", "dependency as b")
    return components.ranked(edges, own.table("tracked").selectExpr("path as node")).withColumnRenamed("node", "path")


def _living(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame]:
    own = catalog.shared(spark, sf_dir)
    touches = own.table("touches").withColumn("ord", F.col("ts"))
    return own, moves.living(touches, own.table("path_moves")).drop("ord")


def living_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each path and month of the past: how many touches there are and on which of today's paths they count (none: the file has ended)."""
    _, found = _living(spark, sf_dir)
    return found.groupBy("path", F.date_format("ts", "yyyy-MM").alias("month"), "living").agg(F.count("*").alias("touches"))


def _renamed(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose events count on living paths, so all signals and scores follow the moves."""
    own, found = _living(spark, sf_dir)
    events = found.where("living is not null").select(F.col("living").alias("path"), "author", "sha", "ts").distinct()
    return Engine(spark, own.operators, {"events_all": events}, own.params)


def current_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of the window under the living path of each file; what has no tracked path is dropped."""
    made = _renamed(spark, sf_dir)
    return made.table("contributions").join(made.table("tracked"), "path", "left_semi").select("path", "author", F.col("commits").cast("bigint").alias("commits"), F.date_format("last_commit", "yyyy-MM-dd HH:mm:ss").alias("last_commit"))


def renamed_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners and scores where the history follows moves."""
    return catalog.rounded(_renamed(spark, sf_dir).table("owners"), "owners")


def community_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the collaboration graph at each level, with the modularity that the level reaches."""
    pairs = storage.written(catalog.shared(spark, sf_dir).table("pair_weights"))
    found = communities.levels(pairs)
    return found.join(communities.modularity(pairs, found).selectExpr("level as at", "communities", "round(modularity, 6) as modularity"), F.col("level") == F.col("at")).drop("at")


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = catalog.shared(spark, sf_dir)
    pairs, teams = storage.written(own.table("pair_weights")), own.table("team_members")
    return communities.clusters(pairs, communities.levels(pairs), teams), teams


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of people with their affiliated people, parents, and the teams that they equal."""
    return _clusters(spark, sf_dir)[0].drop("community")


def team_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each declared team against its nearest cluster."""
    return communities.team_comparisons(*_clusters(spark, sf_dir))


def incremental_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of the window by two runs: the first two months before its end, the second on what came since."""
    own = catalog.shared(spark, sf_dir)
    store = incremental.Store(spark, f"{storage.folder(spark)}/history-{uuid.uuid4().hex}")
    end, window = datetime.fromisoformat(own.params.as_of), timedelta(days=own.params.lookback_days)
    then = end - timedelta(days=60)
    events = own.table("events_all")
    store.advance(events.where(F.col("ts").between(F.lit(then - window), F.lit(then))), "then", then, window, {})
    store.advance(events.where((F.col("ts") > F.lit(then)) & (F.col("ts") <= F.lit(end))), "now", end, window, {})
    return catalog.rounded(store.contributions(), "contributions")


def onboarding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning order of the target's files behind what they import, with a reviewer for each."""
    own = catalog.shared(spark, sf_dir)
    inside = own.table("prerequisites").selectExpr("path as dependent", "prerequisite as dependency")
    return graphs.onboarding_plan(own.table("onboarding"), inside, own.table("owners"))


def transfer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest chain of people and paths from each person who decays to each successor, in the whole knowledge graph."""
    own = catalog.shared(spark, sf_dir)
    pairs = own.table("transfers").where("successor is not null").select("author", "successor").distinct()
    return components.knowledge_chains(own.table("owners"), pairs)


def steady_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of each event type's days with hysteresis, from a stream of daily runs."""
    runs = spark.sql("""
        SELECT event_type AS repo, datediff(ts, DATE '1992-01-01') AS run, CASE WHEN count(*) % 3 = 0 THEN 'high' ELSE 'low' END AS severity, count(*) % 5 / 20e0 AS delta
        FROM {events} GROUP BY 1, 2""", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return ingest.steadied(runs)


def commit_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestry of pairs of orders in the history of each customer: an order follows the one before it, every fourth also the third before, every fifth starts from the second before."""
    orders = spark.sql("SELECT cast(o_custkey AS string) AS repo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders}", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    edges = spark.sql("""
        SELECT repo, cast(n AS string) AS sha, posexplode(transform(if(n % 4 = 0, array(n - 1, n - 3), array(if(n % 5 = 0, n - 2, n - 1))), x -> cast(x AS string))) AS (nth, parent)
        FROM {orders} WHERE n > 3""", orders=orders)
    pairs = spark.sql("SELECT repo, cast(n - 3 AS string) AS a, cast(n AS string) AS b FROM {orders} WHERE n > 4 AND n % 3 = 0", orders=orders)
    return ancestry.commit_graph(edges, pairs)


def parsed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits and files read back from a text export of the orders."""
    raw = spark.sql(f"""
        SELECT concat('{text.RECORD}', lpad(lower(hex(o_orderkey)), 40, '0'), '{text.FIELD}', 'Name', '\t', concat('C', o_custkey, '@X.org'), '{text.FIELD}', date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '{text.FIELD}', 'p', '{text.FIELD}', o_orderpriority, '{text.FIELD}',
          'Co-authored-by: Two <c', o_custkey % 7, '@x.org>', '{text.FIELD}', 'M\t', o_orderstatus, '/', o_orderkey % 10, '\nR090\told/', o_orderkey, '\tnew/', o_orderkey) AS value
        FROM {{orders}}""", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    commits, files = text.history(raw)
    credited = text.credits(commits, text.coauthors(commits), None)
    return credited.join(files, "sha").groupBy("author", "status").agg(F.count("*").alias("files"), F.countDistinct("sha").alias("commits"), F.max("similarity").cast("long").alias("similarity"))


#: A Python file; <name> stands for numbers of the file's part.
_MODULE = "\n".join((
    '"""Text that only looks like imports:', "import pkg0.m0", "from pkg1 import m1", '"""', "import os, pkg<half_dir>.m<half> as x", "from pkg<third_dir> import (", "    m<third>,", "    m<third_next> as y,", ")",
    "def f():", "    from .m<next> import z", '    return "import pkg2.m2"', "",
))


def parsed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges read back from Python texts of the parts, with lists over several lines, relative imports and texts that only look like imports."""
    numbers = {"half_dir": "(k div 2) % 20", "half": "k div 2", "third_dir": "(k div 3) % 20", "third_next": "k div 3 + 20", "third": "k div 3", "next": "k + 20"}
    value = F.lit(_MODULE)
    for name, number in numbers.items():
        value = F.replace(value, F.lit(f"<{name}>"), F.expr(f"cast({number} as string)"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    return text.python_imports(parts.select(F.expr("concat('pkg', k % 20, '/m', k, '.py')").alias("path"), value.alias("value")))


def parsed_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts read back from porcelain texts of the line items."""
    raw = spark.sql("""
        SELECT concat('p', l_partkey) AS path, concat_ws('\n', transform(array_sort(collect_list(struct(l_orderkey, l_linenumber, l_suppkey))), x -> concat(lpad(concat(lower(hex(x.l_orderkey * 8 + x.l_linenumber)), 'f', x.l_suppkey), 40, '0'), ' 1 1 1\nauthor-mail <S', x.l_suppkey, '@x.org>\n\tline'))) AS value
        FROM {lineitem} GROUP BY l_partkey""", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return text.attribution(raw).groupBy("path", "author").agg(F.sum("n_lines").alias("n_lines"))


def cached_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts of all parts by a second run that reads only the contents that the first one had not."""
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    texts = """
        SELECT concat('p', l_partkey) AS path, concat_ws('\n', transform(array_sort(collect_list(struct(l_orderkey, l_linenumber, l_suppkey))), x -> concat(lpad(concat(lower(hex(x.l_orderkey * 8 + x.l_linenumber)), 'f', x.l_suppkey), 40, '0'), ' 1 1 1\nauthor-mail <S', x.l_suppkey, '@x.org>\n\tline'))) AS value
        FROM lineitem WHERE {} GROUP BY l_partkey"""
    store = attribution.Store(spark, f"{storage.folder(spark)}/attribution-{uuid.uuid4().hex}")
    before = spark.sql("SELECT concat('p', p_partkey) AS path, if(p_partkey % 4 = 0, 'old', 'new') AS blob FROM part WHERE p_partkey % 11 <> 0")
    store.attributed(before, spark.sql(texts.format("l_partkey % 4 <> 0 OR l_linenumber <= 3")), 1)
    return store.attributed(spark.sql("SELECT concat('p', p_partkey) AS path, 'new' AS blob FROM part"), spark.sql(texts.format("true")), 2)


def parsed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's rules read back from the file that is written for them."""
    content = documents.rule_file([(p, o) for p, o, s in adapter.RULES if s == "generated"], manual="\n".join(["# BEGIN MANUAL", *(f"{p} {o.replace(',', ' ')}" for p, o, s in adapter.RULES if s == "manual"), "# END MANUAL"]))
    return text.rules(spark, content).select("line_no", "pattern", "owners", "source", "supported")


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, graph edges and consolidated rules as the lines of documents of every format (of the annotations the first 50, their reader's bound)."""
    own = catalog.shared(spark, sf_dir)
    return lines.finding_lines(own.table("new_findings")).union(lines.edge_lines(own.table("graph_edges").select("src", "dst", "relations"))).union(lines.rule_lines(own.table("consolidated").select("pattern", "owners")))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events of each type, through a stream that is drained."""
    counted = ingest.drained(ingest.windowed(ingest.event_stream(spark, sf_dir)), ["start", "event_type"])
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", "value")


QUERIES = {f.__name__: f for f in (person_graph, topology, knowledge_cuts, knowledge_betweenness, import_cycles, living_paths, current_paths, renamed_owners, incremental_contributions, community_levels, clusters, team_comparisons, onboarding_plan, transfer_paths, steady_severity, commit_graph, path_lineage, parsed_history, parsed_imports, parsed_attribution, cached_attribution, parsed_rules, report_documents, stream_windows)}
#: Each touch followed from move to move, one after the other.
_FOLLOWED = """
    t AS (SELECT source AS path, ord, 0 AS over, CASE WHEN kind = 'R' THEN dest END AS dest FROM path_moves UNION ALL SELECT dest, ord, 1, NULL FROM path_moves WHERE kind = 'R' AND dest <> source),
    u AS (SELECT path, ord, arg_min(struct_pack(d := dest), struct_pack(o := over, k := coalesce(dest, ''))).d AS dest FROM t GROUP BY path, ord),
    w AS (SELECT path, ord, dest, coalesce(lag(ord) OVER (PARTITION BY path ORDER BY ord), TIMESTAMP '0001-01-01 00:00:00') AS since FROM u),
    f(path, ts, cur, ord, n) AS (SELECT DISTINCT path, ts, path, ts, 0 FROM touches UNION ALL SELECT f.path, f.ts, w.dest, w.ord, n + 1 FROM f JOIN w ON w.path = f.cur AND f.ord < w.ord AND f.ord >= w.since),
    g AS (SELECT path, ts, cur AS living FROM f QUALIFY row_number() OVER (PARTITION BY path, ts ORDER BY n DESC) = 1)"""
_RENAMED = {"events_all": Operator("events_all", "WITH RECURSIVE touches AS (SELECT * FROM {touches}), path_moves AS (SELECT * FROM {path_moves}), " + _FOLLOWED + " SELECT DISTINCT g.living AS path, e.author, e.sha, e.ts FROM touches AS e JOIN g ON e.path = g.path AND e.ts = g.ts WHERE g.living IS NOT NULL")}
_OWNER_COLUMNS = catalog.ORACLES["owners"].rsplit("SELECT ", 1)[1]

ORACLES = {
    "knowledge_cuts": catalog.over("owners", """+
        together AS (SELECT DISTINCT a.author AS a, b.author AS b FROM owners AS a JOIN owners AS b ON a.path = b.path AND a.author <> b.author),
        people AS (SELECT DISTINCT author FROM owners),
        reach(gone, a, b) AS (SELECT r.author, p.author, p.author FROM people AS r JOIN people AS p ON r.author <> p.author UNION SELECT r.gone, r.a, t.b FROM reach AS r JOIN together AS t ON t.a = r.b AND t.b <> r.gone),
        piece AS (SELECT gone, a, min(b) AS piece FROM reach GROUP BY gone, a),
        held AS (SELECT o.author, o.path, coalesce((SELECT min(x.author) FROM owners AS x WHERE x.path = o.path AND x.author <> o.author), '') AS other FROM owners AS o),
        pieces AS (SELECT h.author, coalesce(p.piece, '/' || h.path) AS piece, min(h.path) AS path FROM held AS h LEFT JOIN piece AS p ON p.gone = h.author AND p.a = h.other GROUP BY 1, 2)
        SELECT author AS person, count(*) AS pieces, coalesce(string_agg(DISTINCT regexp_replace(path, '/[^/]*$', ''), ',' ORDER BY regexp_replace(path, '/[^/]*$', '')) FILTER (WHERE contains(path, '/')), '') AS directories FROM pieces GROUP BY author HAVING count(*) > 1"""),
    "import_cycles": catalog.over("dependencies", """+
        reach(a, b) AS (SELECT dependent, dependency FROM dependencies UNION SELECT r.a, d.dependency FROM reach AS r JOIN dependencies AS d ON d.dependent = r.b),
        loops AS (SELECT r.a AS path, min(r.b) AS cycle FROM reach AS r JOIN reach AS s ON s.a = r.b AND s.b = r.a GROUP BY r.a),
        behind AS (SELECT DISTINCT a AS path FROM reach WHERE b IN (SELECT path FROM loops)),
        free AS (SELECT path FROM tracked WHERE path NOT IN (SELECT path FROM behind)),
        steps(path, n) AS (SELECT path, 0 FROM free UNION SELECT d.dependent, n + 1 FROM steps AS s JOIN dependencies AS d ON d.dependency = s.path WHERE d.dependent IN (SELECT path FROM free)),
        levels AS (SELECT path, max(n) AS level FROM steps GROUP BY path)
        SELECT t.path, CAST(coalesce(l.level, (SELECT max(level) + 1 FROM levels), 0) AS BIGINT) AS level, c.path IS NOT NULL AS cyclic, c.cycle FROM tracked AS t LEFT JOIN levels AS l ON t.path = l.path LEFT JOIN loops AS c ON t.path = c.path"""),
    "living_paths": catalog.over("path_moves", "+touches AS (" + catalog.oracle_text("touches") + "), " + _FOLLOWED + """
        SELECT e.path, strftime(e.ts, '%Y-%m') AS month, g.living, count(*) AS touches FROM touches AS e JOIN g ON e.path = g.path AND e.ts = g.ts GROUP BY 1, 2, 3"""),
    "current_paths": catalog.over("contributions", """
        SELECT path, author, CAST(commits AS BIGINT) AS commits, strftime(last_commit, '%Y-%m-%d %H:%M:%S') AS last_commit FROM contributions WHERE path IN (SELECT path FROM (""" + catalog.oracle_text("tracked") + "))", _RENAMED),
    "renamed_owners": catalog.over("owners", "SELECT " + _OWNER_COLUMNS, _RENAMED),
    "steady_severity": """
        WITH RECURSIVE d AS (SELECT event_type AS repo, datediff('day', DATE '1992-01-01', CAST(ts AS DATE)) AS run, CASE WHEN count(*) % 3 = 0 THEN 'high' ELSE 'low' END AS severity, count(*) % 5 / 20e0 AS delta FROM events GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run) AS i FROM d),
        f AS (SELECT repo, run, i, severity AS reported, severity AS pending, 1 AS streak FROM n WHERE i = 1 UNION ALL
          SELECT n.repo, n.run, n.i, CASE WHEN n.delta >= 0.4 OR n.severity = f.reported OR (CASE WHEN n.severity = f.pending THEN f.streak + 1 ELSE 1 END) >= 3 THEN n.severity ELSE f.reported END, n.severity,
            CASE WHEN n.delta >= 0.4 OR n.severity = f.reported THEN 1 WHEN n.severity = f.pending THEN f.streak + 1 ELSE 1 END FROM f JOIN n ON n.repo = f.repo AND n.i = f.i + 1)
        SELECT repo, run, reported, CAST(streak AS BIGINT) AS streak FROM f""",
    "transfer_paths": catalog.over("transfers", """+
        pairs AS (SELECT DISTINCT author, successor FROM transfers WHERE successor IS NOT NULL),
        first AS (SELECT min(path) AS path, l FROM (SELECT path, list(DISTINCT author ORDER BY author) AS l FROM owners GROUP BY path) GROUP BY l),
        near AS (SELECT 'person:' || p AS a, 'path:' || path AS b FROM (SELECT unnest(l) AS p, path FROM first) UNION ALL SELECT 'path:' || path, 'person:' || p FROM (SELECT unnest(l) AS p, path FROM first)),
        walk(start, node, hops) AS (SELECT DISTINCT 'person:' || author, 'person:' || author, 0 FROM pairs UNION SELECT w.start, n.b, w.hops + 1 FROM walk AS w JOIN near AS n ON n.a = w.node WHERE w.hops < 2 * (SELECT count(DISTINCT author) FROM owners)),
        level AS (SELECT start, node, min(hops) AS hops FROM walk GROUP BY start, node),
        before AS (SELECT l.start, l.node, min(n.b) AS before FROM level AS l JOIN near AS n ON n.a = l.node JOIN level AS k ON k.start = l.start AND k.node = n.b AND k.hops = l.hops - 1 GROUP BY l.start, l.node),
        back AS (SELECT p.author, p.successor, l.hops, l.node AS at, [l.node] AS chain FROM pairs AS p JOIN level AS l ON l.start = 'person:' || p.author AND l.node = 'person:' || p.successor
          UNION ALL SELECT b.author, b.successor, b.hops, x.before, list_prepend(x.before, b.chain) FROM back AS b JOIN before AS x ON x.start = 'person:' || b.author AND x.node = b.at)
        SELECT author, successor, CAST(hops AS BIGINT) AS hops, array_to_string(chain, ',') AS chain FROM back WHERE len(chain) = hops + 1"""),
    "report_documents": catalog.over("everything", r"""+
        f AS (SELECT rule, path, owners, fingerprint, concat_ws(chr(9), rule, path, owners) AS key FROM new_findings),
        x AS (SELECT *, replace(replace(replace(replace(rule, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xr, replace(replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xp FROM f),
        e AS (SELECT src, dst, relations, concat_ws(chr(9), '1', src, dst) AS key, [replace(replace(x, '\', '\\'), '"', '\"') FOR x IN [src, dst, relations]] AS d, [replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') FOR x IN [src, dst]] AS x FROM graph_edges)
        SELECT 'sarif' AS kind, key, '{"ruleId":' || to_json(rule) || ',"level":"warning","message":{"text":' || to_json(rule) || '},"locations":[{"physicalLocation":{"artifactLocation":{"uri":' || to_json(path) || '},"region":{"startLine":1}}}],"partialFingerprints":{"identity/v1":' || to_json(fingerprint) || '}}' AS line FROM f
        UNION ALL SELECT 'junit', key, '<testcase classname="' || xr || '" name="' || xp || '"><failure message="' || xr || '"/></testcase>' FROM x
        UNION ALL SELECT 'baseline', key, CAST(to_json(struct_pack(rule := rule, path := path, owners := [o FOR o IN string_split(owners, ',') IF o <> ''])) AS VARCHAR) FROM f
        UNION ALL SELECT 'annotations', key, '::warning file=' || replace(path, '%', '%25') || ',line=1::' || rule FROM (SELECT * FROM f ORDER BY rule, path, owners LIMIT 50)
        UNION ALL SELECT 'dot', key, '  "' || d[1] || '" -- "' || d[2] || '" [label="' || d[3] || '"];' FROM e
        UNION ALL SELECT 'graphml', key, '<edge source="' || x[1] || '" target="' || x[2] || '"/>' FROM e
        UNION ALL SELECT DISTINCT 'graphml', '0' || chr(9) || n.n, '<node id="' || n.x || '"/>' FROM (SELECT unnest([struct_pack(n := src, x := x[1]), struct_pack(n := dst, x := x[2])]) AS n FROM e)
        UNION ALL SELECT 'rule_file', lpad(CAST(CASE WHEN pattern = '*' THEN 0 ELSE len(pattern) END AS VARCHAR), 9, '0') || chr(9) || pattern, replace(pattern, ' ', '\ ') || ' ' || replace(owners, ',', ' ') FROM consolidated""",
        {"everything": Operator("everything", "SELECT 1 FROM {new_findings}, {graph_edges}, {consolidated} LIMIT 0")}),
    "incremental_contributions": catalog.ORACLES["contributions"],
    "commit_graph": """
        WITH RECURSIVE o AS (SELECT o_custkey AS repo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
        e AS (SELECT repo, n, unnest(CASE WHEN n % 4 = 0 THEN [n - 1, n - 3] WHEN n % 5 = 0 THEN [n - 2] ELSE [n - 1] END) AS p FROM o WHERE n > 3),
        pairs AS (SELECT repo, n - 3 AS a, n AS b FROM o WHERE n > 4 AND n % 3 = 0), r(repo, h, n) AS (SELECT repo, x, x FROM (SELECT repo, a AS x FROM pairs UNION SELECT repo, b FROM pairs) UNION SELECT r.repo, r.h, e.p FROM r JOIN e ON e.repo = r.repo AND e.n = r.n),
        s AS (SELECT repo, h, list(n) AS l FROM r GROUP BY repo, h), c AS (SELECT p.repo, p.a, p.b, x.l AS one, y.l AS two, list_intersect(x.l, y.l) AS shared FROM pairs AS p JOIN s AS x ON x.repo = p.repo AND x.h = p.a JOIN s AS y ON y.repo = p.repo AND y.h = p.b),
        v AS (SELECT repo, a, b, unnest(shared) AS v FROM c), w AS (SELECT v.repo, v.a, v.b, e.p FROM v JOIN e ON e.repo = v.repo AND e.n = v.v),
        bases AS (SELECT repo, a, b, string_agg(CAST(v AS VARCHAR), ',' ORDER BY CAST(v AS VARCHAR)) AS bases FROM (SELECT v.* FROM v ANTI JOIN w ON w.repo = v.repo AND w.a = v.a AND w.b = v.b AND w.p = v.v) GROUP BY ALL)
        SELECT CAST(c.repo AS VARCHAR) AS repo, CAST(c.a AS VARCHAR) AS a, CAST(c.b AS VARCHAR) AS b, len(one) - len(shared) AS ahead, len(two) - len(shared) AS behind, list_contains(two, c.a) AS is_ancestor, coalesce(x.bases, '') AS bases
        FROM c LEFT JOIN bases AS x ON x.repo = c.repo AND x.a = c.a AND x.b = c.b""",
    "parsed_history": """
        WITH c AS (SELECT o_orderkey AS sha, 'c' || o_custkey || '@x.org' AS author FROM orders UNION SELECT o_orderkey, 'c' || (o_custkey % 7) || '@x.org' FROM orders), f AS (SELECT unnest(['M', 'R']) AS status)
        SELECT author, status, count(*) AS files, count(DISTINCT sha) AS commits, CAST(CASE WHEN status = 'M' THEN 100 ELSE 90 END AS BIGINT) AS similarity FROM c, f GROUP BY author, status""",
    "parsed_imports": """
        WITH e AS (SELECT p_partkey AS k, unnest([p_partkey // 2, p_partkey // 3, p_partkey // 3 + 20, p_partkey + 20]) AS d FROM part)
        SELECT DISTINCT 'pkg' || (k % 20) || '/m' || k || '.py' AS dependent, 'pkg' || (d % 20) || '/m' || d || '.py' AS dependency FROM e WHERE d <> k AND d IN (SELECT p_partkey FROM part)""",
    "cached_attribution": "SELECT 'p' || l_partkey AS path, 's' || l_suppkey || '@x.org' AS author, count(*) AS n_lines, l_partkey % 4 <> 0 AND l_partkey % 11 <> 0 AS reused FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY ALL",
    "parsed_attribution": "SELECT 'p' || l_partkey AS path, 's' || l_suppkey || '@x.org' AS author, count(*) AS n_lines FROM lineitem GROUP BY ALL",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
