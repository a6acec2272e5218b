"""Composite risk, pathologies, transfers, comparison of two snapshots."""

_FACTORS = ("concentration", "frequency", "coupling", "criticality", "decay")

SQL = {
    "risk_factors": ("The five factors of each path, in (0, 1]; null where one is unknown.", """
        SELECT s.path, s.primary_owner, """ + ", ".join(f"CASE WHEN {e} IS NOT NULL THEN least(1e0, greatest(1e-4, round({e}, 4))) END AS {f}" for f, e in zip(_FACTORS, (
        "c.top_share", "CASE WHEN s.change_events <= 1 THEN 0.05e0 ELSE 1e0 / (1e0 + coalesce(s.cadence_days, 0e0) / 7e0) END", "CASE WHEN s.cochange_degree > 0 THEN s.cochange_degree END", "coalesce(w.configured, CASE WHEN m.path IS NOT NULL THEN :inferred_criticality END)", "greatest(0.05e0, 1e0 - d.recency)"))) + """, c.truck_50
        FROM {path_summary} AS s JOIN {concentration} AS c ON s.path = c.path JOIN {path_weight} AS w ON s.path = w.path LEFT JOIN {manifests} AS m ON s.path = m.path
        JOIN (SELECT path, recency FROM (SELECT path, recency, row_number() OVER (PARTITION BY path ORDER BY score DESC, commits DESC, author DESC) AS n FROM {ranked}) AS r WHERE n = 1) AS d ON s.path = d.path"""),
    "manifests": ("Tracked paths that deploy something: build and deployment manifests by name, and files below k8s or deploy.", """
        SELECT path FROM {tracked} WHERE @matches(path, '(^|/)(Dockerfile|Procfile|Chart[.]yaml|fly[.]toml|serverless[.]yml|[^/]*[.]tf|(docker-compose|compose)([.][^/]*)?[.](yml|yaml)|(k8s|deploy)/.*|(k8s|deploy))$') OR @matches(path, '(^|/)(k8s|deploy)/')"""),
    "risk": ("Geometric mean of the known factors, tier, and the reasons from the strongest.", """
        SELECT path, risk, CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS tier, single_expert, high_churn, coupled, stale_expertise FROM (
          SELECT path, least(100, CAST(floor(100e0 * exp((""" + " + ".join(f"coalesce(ln({f}), 0e0)" for f in _FACTORS) + ") / (" + " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in _FACTORS) + """)) + 0.5e0) AS BIGINT)) AS risk,
            truck_50 <= 1 AND concentration >= 0.6e0 AS single_expert, coalesce(frequency >= 0.6e0, false) AS high_churn, coalesce(coupling >= 0.6e0, false) AS coupled, coalesce(decay >= 0.6e0, false) AS stale_expertise
          FROM {risk_factors}) AS r"""),
    "risk_summary": ("Paths of each risk tier.", "SELECT tier, count(*) AS paths, max(risk) AS worst FROM {risk} GROUP BY tier"),
    "vacuum": ("Paths whose qualified owners are all stale.", """
        SELECT path, max(score) AS best, CAST(min(age) AS BIGINT) AS days FROM {owners} GROUP BY path HAVING count(CASE WHEN status = 'stable' THEN 1 END) = 0"""),
    "phantom_owners": ("Declared owners who never touched the path.", """
        SELECT d.path, d.owner FROM {declared} AS d WHERE NOT EXISTS (SELECT 1 FROM {scored} AS s WHERE s.path = d.path AND lower(s.author) = d.owner AND (s.commits > 0 OR s.review > 0))"""),
    "shadow_experts": ("Dominant people who are not declared.", """
        SELECT o.path, o.author, o.score FROM {owners} AS o WHERE o.rank = 1 AND EXISTS (SELECT 1 FROM {declared} AS d WHERE d.path = o.path) AND NOT EXISTS (SELECT 1 FROM {declared} AS d WHERE d.path = o.path AND d.owner = lower(o.author))"""),
    "role_divergence": ("Paths whose writer, reviewer and declared owner differ.", """
        SELECT w.path, w.author AS writer, r.author AS reviewer FROM (
          SELECT path, author, row_number() OVER (PARTITION BY path ORDER BY blame DESC, author) AS n FROM {scored} WHERE blame > 0) AS w
        JOIN (SELECT path, author, row_number() OVER (PARTITION BY path ORDER BY review DESC, author) AS n FROM {scored} WHERE review > 0) AS r ON w.path = r.path AND r.n = 1
        WHERE w.n = 1 AND w.author <> r.author AND EXISTS (SELECT 1 FROM {declared} AS d WHERE d.path = w.path)
          AND NOT EXISTS (SELECT 1 FROM {declared} AS d WHERE d.path = w.path AND d.owner IN (lower(w.author), lower(r.author)))"""),
    "pathologies": ("All pathologies of observed paths.", """
        SELECT path, kind, count(*) AS n FROM (SELECT path, 'vacuum' AS kind FROM {vacuum} UNION ALL SELECT path, 'phantom' FROM {phantom_owners} UNION ALL SELECT path, 'shadow' FROM {shadow_experts} UNION ALL SELECT path, 'divergence' FROM {role_divergence}) AS p GROUP BY path, kind"""),
    "transfers": ("For each decaying owner a successor: a fresh owner of the path, else the best fresh owner of the nearest directory; never the person itself.", """
        SELECT w.path, w.author, coalesce(own.author, near.author) AS successor FROM {decay_warnings} AS w
        LEFT JOIN (SELECT path, author FROM (SELECT path, author, row_number() OVER (PARTITION BY path ORDER BY rank) AS n FROM {owners} WHERE status = 'stable') AS s WHERE n = 1) AS own ON w.path = own.path
        LEFT JOIN (
          SELECT path, decaying, author FROM (
            SELECT x.path, x.author AS decaying, a.author, row_number() OVER (PARTITION BY x.path, x.author ORDER BY p.depth DESC, a.score DESC, a.author) AS n
            FROM {decay_warnings} AS x JOIN {ancestors} AS p ON x.path = p.path JOIN {ancestor_best} AS a ON p.dir = a.dir WHERE a.author <> x.author) AS c WHERE n = 1) AS near ON w.path = near.path AND w.author = near.decaying"""),
    "ancestors": ("All directories above each owned path.", """
        SELECT path, @prefix(path, depth) AS dir, depth FROM (SELECT path, @explode(@series(1, @depth(path))) AS depth FROM {path_summary} WHERE @contains(path, '/')) AS d"""),
    "ancestor_best": ("The two best fresh people below each directory.", """
        SELECT dir, author, score FROM (
          SELECT dir, author, score, row_number() OVER (PARTITION BY dir ORDER BY score DESC, author) AS n FROM (
            SELECT a.dir, o.author, max(o.score) AS score FROM {ancestors} AS a JOIN {owners} AS o ON a.path = o.path WHERE o.status = 'stable' GROUP BY a.dir, o.author) AS g) AS r WHERE n <= 2"""),
    "base_primary": ("Primary owner and number of qualified owners of each path one quarter before the instant, by recency and frequency.", """
        SELECT path, max(CASE WHEN n = 1 THEN author END) AS author, max(score) AS score, count(*) AS qualified_owners FROM (
          SELECT path, author, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, lower(author) DESC) AS n, row_number() OVER (PARTITION BY path ORDER BY score DESC, author) AS place FROM (
            SELECT path, author, (0.3e0 * power(0.5e0, (@days(TIMESTAMP :as_of, last_commit) - 90) / :half_life) + 0.2e0 * commits / (max(commits) OVER (PARTITION BY path) + :frequency_prior)) / 0.5e0 AS score FROM (
              SELECT path, author, count(*) AS commits, max(ts) AS last_commit FROM {events_all} WHERE @days(TIMESTAMP :as_of, ts) >= 90 AND @days(TIMESTAMP :as_of, ts) <= 90 + :lookback_days GROUP BY path, author) AS g) AS s WHERE score >= :threshold) AS r
        WHERE place <= :top_n GROUP BY path"""),
    "change_report": ("Primary owners before and now: regression (fewer qualified owners, and few), shift, new, single or ok.", """
        SELECT path, before_owner, after_owner, before_count, after_count,
          CASE WHEN before_count > 0 AND after_count < before_count AND after_count <= :warn_owners THEN 'regression' WHEN lower(before_owner) <> lower(after_owner) THEN 'shift'
            WHEN before_count = 0 AND after_owner IS NOT NULL THEN 'new' WHEN after_count = 1 THEN 'single' ELSE 'ok' END AS kind
        FROM (
          SELECT coalesce(b.path, h.path) AS path, b.author AS before_owner, h.author AS after_owner, coalesce(b.qualified_owners, 0) AS before_count, coalesce(h.n, 0) AS after_count
          FROM {base_primary} AS b FULL OUTER JOIN (
            SELECT path, max(CASE WHEN place = 1 THEN author END) AS author, count(*) AS n FROM (SELECT path, author, row_number() OVER (PARTITION BY path ORDER BY score DESC, lower(author) DESC) AS place FROM {owners}) AS o GROUP BY path) AS h
          ON b.path = h.path) AS c"""),
    "change_kinds": ("Paths of each kind of change.", "SELECT kind, count(*) AS paths FROM {change_report} GROUP BY kind"),
}
