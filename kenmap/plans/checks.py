"""Second definitions of reports, for DuckDB alone.

Each is written from the definition of its report, not from the text of the operator: over lists, ordered aggregates and
QUALIFY where the operators use joins and windows.  The catalog's statements for the other engine take these
where they stand, so two texts and two engines must agree.
"""

from __future__ import annotations

from kenmap.plans.engine import Operator

_DAYS = "(epoch_us({0}) - epoch_us({1})) / 86400000000.0"
_AGE = _DAYS.format("TIMESTAMP :as_of", "{0}")
_W = {"recency": ":w_recency", "frequency": ":w_frequency", "blame": ":w_blame", "review": ":w_review", "survival": ":w_survival"}
_PAIRS = "[" + ", ".join(f"struct_pack(w := {w}, v := {s})" for s, w in _W.items()) + "]"

TEXTS: dict[str, str] = {
    "events": "SELECT path, author, sha, ts FROM {events_all} WHERE ts BETWEEN TIMESTAMP :as_of - to_days(:lookback_days) AND TIMESTAMP :as_of",
    "cadence": f"""
        SELECT path, list_aggregate(list_transform(range(1, len(t)), lambda i: {_DAYS.format('t[i + 1]', 't[i]')}), 'median') AS cadence_days
        FROM (SELECT path, list_sort(list_distinct(list(ts))) AS t FROM {{events}} GROUP BY path) WHERE len(t) > 1""",
    "contributions": """
        SELECT a.path, a.author, a.commits, CAST(a.commits AS DOUBLE) AS credit, a.last_commit, a.last_sha, len(list_filter(p.t, lambda x: x > a.last_commit)) AS later_commits, c.cadence_days
        FROM (SELECT path, author, count(*) AS commits, max(ts) AS last_commit, first(sha ORDER BY ts DESC, sha) AS last_sha FROM {events} GROUP BY ALL) AS a
        JOIN (SELECT path, list(ts) AS t FROM {events} GROUP BY path) AS p USING (path) LEFT JOIN {cadence} AS c USING (path)""",
    "author_index": "SELECT author, first(sha ORDER BY ts, sha, path) AS first_sha, len(list_distinct(list(path))) AS paths, len(list_distinct(list(sha))) AS commits FROM {events} GROUP BY author",
    "merge_strategy": """
        SELECT CASE WHEN 100 * m >= :merge_percent * n THEN 'merge' WHEN n > m AND 100 * s >= :squash_percent * (n - m) THEN 'squash' ELSE 'rebase' END AS strategy, m AS merges, s AS squashed, n AS commits
        FROM (SELECT count(*) AS n, count_if(parents >= 2) AS m, count_if(parents < 2 AND subject SIMILAR TO '.*\\(#[0-9]+\\)') AS s FROM {commits})""",
    "mechanical_authors": """
        WITH t AS (SELECT author, subject, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(subject), '\\b[0-9a-f]{7,}\\b', '', 'g'), '\\d+(\\.\\d+)*', '', 'g'), ' '), lambda w: w <> ''), ' ') AS template FROM {commits})
        SELECT author, count(*) AS commits, list_max(map_values(histogram(template))) AS most FROM t GROUP BY author
        HAVING count(*) >= :mass_floor AND (list_max(map_values(histogram(template))) / count(*) >= :mass_fraction OR count_if(starts_with(lower(subject), 'bump') OR starts_with(lower(subject), 'chore(deps)') OR starts_with(lower(subject), 'dependabot') OR starts_with(lower(subject), 'automated')) / count(*) >= :mass_fraction)""",
    "bot_authors": """
        SELECT DISTINCT author FROM {events_all}, (SELECT list(lower(author)) AS extra FROM {extra_bots})
        WHERE lower(author) SIMILAR TO '.*\\[bot\\].*|bot@.*|actions@github\\.com|(dependabot|renovate|github-actions|release-please)(@.*)?' OR list_contains(extra, lower(author))""",
    "kept_contributions": """
        SELECT c.path, c.author, c.commits, CASE WHEN m.author IS NULL THEN c.credit ELSE least(c.credit, 1.0) END AS credit, c.last_commit, c.last_sha, c.later_commits, c.cadence_days
        FROM {contributions} AS c LEFT JOIN {mechanical_authors} AS m USING (author) ANTI JOIN {bot_authors} AS b USING (author) SEMI JOIN {tracked} AS t USING (path) ANTI JOIN {excluded_paths} AS x USING (path)""",
    "excluded_paths": "SELECT path FROM {tracked}, (SELECT list(rx) AS all_rx FROM {exclude_rules}) WHERE len(list_filter(all_rx, lambda r: regexp_matches(path, r))) > 0",
    "cochange": """
        WITH s AS (SELECT list_distinct(list(path)) AS ps FROM {events} GROUP BY sha), p AS (SELECT unnest(ps) AS path, ps FROM s WHERE len(ps) <= :cochange_cap)
        SELECT path, len(list_distinct(flatten(list(ps)))) - 1 AS degree FROM p GROUP BY path HAVING len(list_distinct(flatten(list(ps)))) > 1""",
    "path_activity": """
        SELECT e.path, e.change_events, c.cadence_days, d.degree / (SELECT max(degree) FROM {cochange}) AS cochange_degree
        FROM (SELECT path, len(list_distinct(list(sha))) AS change_events FROM {events} GROUP BY path) AS e LEFT JOIN {cadence} AS c USING (path) LEFT JOIN {cochange} AS d USING (path)""",
    "recent_shas": "SELECT DISTINCT author, sha, ts FROM {events} QUALIFY dense_rank() OVER (PARTITION BY author ORDER BY ts DESC, sha) <= 5",
    "trend_points": f"""
        SELECT period, count(DISTINCT sha) AS commits, count(DISTINCT author) AS contributors, count(DISTINCT path) AS paths
        FROM (SELECT unnest(range(0, :periods)) AS period), {{events_all}} WHERE {_AGE.format('ts')} BETWEEN (:periods - 1 - period) * :period_days AND :periods * :period_days GROUP BY period""",
    "blame_share": "SELECT path, author, sum(n_lines) / (SELECT sum(n_lines) FROM {blame_lines} AS t WHERE t.path = b.path) AS share FROM {blame_lines} AS b GROUP BY path, author",
    "review_share": "WITH t AS (SELECT path, sum(n) AS n FROM {review_counts} GROUP BY path) SELECT r.path, r.author, sum(r.n) / any_value(t.n) AS share FROM {review_counts} AS r JOIN t USING (path) GROUP BY r.path, r.author",
    "survival": """
        SELECT t.path, t.author, least(1.0, coalesce((SELECT sum(n.n_lines) FROM {blame_lines} AS n WHERE n.path = t.path AND n.author = t.author), 0) / nullif(greatest(t.n_lines, 0), 0)) AS ratio FROM {blame_then} AS t""",
    "qualified": "SELECT k.*, coalesce(b.share, 0) AS blame_raw FROM {kept_contributions} AS k LEFT JOIN {blame_share} AS b USING (path, author) WHERE k.commits >= :min_commits OR b.share >= :blame_override",
    "signals": f"""
        WITH m AS (SELECT path, max(credit) AS most, max(last_commit) AS path_last FROM {{qualified}} GROUP BY path), l AS (SELECT DISTINCT path FROM {{blame_lines}}),
        q AS (SELECT q.*, m.path_last, m.most, if(q.cadence_days IS NULL, :half_life, least(:half_life_ceiling, greatest(:half_life_floor, q.cadence_days))) AS half_life FROM {{qualified}} AS q JOIN m USING (path))
        SELECT q.path, q.author, q.commits, q.later_commits, q.last_commit, q.last_sha, q.cadence_days, q.half_life, q.path_last, exp(-ln(2.0) * greatest(0.0, {_AGE.format('q.last_commit')}) / q.half_life) AS recency,
          CASE WHEN q.most > 0 THEN least(1.0, q.credit / (q.most + :frequency_prior)) ELSE 0.0 END AS frequency, if(l.path IS NULL, NULL, q.blame_raw) AS blame,
          CASE WHEN EXISTS (SELECT 1 FROM {{review_counts}}) THEN least(1.0, coalesce(r.share, 0.0)) END AS review, if(l.path IS NULL, NULL, s.ratio) AS survival
        FROM q LEFT JOIN l USING (path) LEFT JOIN {{review_share}} AS r USING (path, author) LEFT JOIN {{survival}} AS s USING (path, author)""",
    "scored": f"""
        WITH a AS (SELECT *, list_filter({_PAIRS}, lambda x: x.v IS NOT NULL) AS known, CAST(floor(greatest(0.0, {_AGE.format('last_commit')})) AS BIGINT) AS age FROM {{signals}})
        SELECT path, author, commits, last_commit, last_sha, cadence_days, half_life, recency, frequency, blame, review, survival,
          least(1.0, list_sum(list_transform(known, lambda x: x.w * x.v)) / list_sum(list_transform(known, lambda x: x.w))) AS score,
          :completeness * list_sum(list_transform(known, lambda x: x.w)) / ({' + '.join(_W.values())}) AS quality, commits / (commits + later_commits) AS historical,
          exp(-ln(2.0) * greatest(0.0, {_AGE.format('path_last')}) / half_life) AS maintenance,
          CASE WHEN later_commits > 0 AND survival < :superseded_cut OR survival IS NULL AND later_commits > commits THEN 'superseded'
            WHEN cadence_days IS NULL AND age <= :decay_days OR cadence_days IS NOT NULL AND (age <= half_life OR last_commit = path_last AND age <= :half_life_ceiling) THEN 'stable' ELSE 'inactive' END AS status, age
        FROM a""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, author) AS rank FROM {scored} WHERE score >= :threshold",
    "owners": "SELECT r.* FROM (SELECT unnest(list(s ORDER BY s.rank)[1:CAST(:top_n AS BIGINT)]) AS r FROM (SELECT x AS s FROM {ranked} AS x) GROUP BY s.path)",
    "path_summary": """
        SELECT o.*, a.change_events, a.cadence_days, a.cochange_degree FROM (
          SELECT path, count(*) AS qualified_owners, arg_min(author, rank) AS primary_owner, max(score) AS top_score, count_if(status IN ('inactive', 'superseded')) AS decaying FROM {owners} GROUP BY path) AS o LEFT JOIN {path_activity} AS a USING (path)""",
    "decay_warnings": """
        SELECT path, author, age AS days, CASE WHEN status = 'inactive' AND NOT bool_or(status = 'stable') OVER (PARTITION BY author) THEN 'departed' ELSE status END AS status FROM {owners} QUALIFY status <> 'stable' OR false""",
    "rescored": f"""
        SELECT path, author, least(1.0, list_sum(list_transform(known, lambda x: x.w * x.v)) / list_sum(list_transform(known, lambda x: x.w))) AS score FROM (SELECT path, author, list_filter({_PAIRS}, lambda x: x.v IS NOT NULL) AS known FROM {{signals}})""",
    "signal_completeness": "SELECT path, round(avg((2 + (blame IS NOT NULL)::INT + (review IS NOT NULL)::INT + (survival IS NOT NULL)::INT) / 5.0), 6) AS completeness FROM {owners} GROUP BY path",
    "expertise": "SELECT author, max(score) AS score, CAST(sum(commits) AS BIGINT) AS commits, max(last_commit) AS last_commit, count(*) AS paths FROM {ranked} WHERE starts_with(path || '/', :target || '/') GROUP BY author",
    "concentration": """
        WITH v AS (SELECT path, list_transform(s, lambda x: x / list_sum(s)) AS v FROM (SELECT path, list(score ORDER BY rank) AS s FROM {ranked} WHERE score > 0 GROUP BY path)),
        c AS (SELECT path, v, list_transform(range(1, len(v) + 1), lambda i: list_sum(v[1:i])) AS c FROM v)
        SELECT path, v[1] AS top_share, list_sum(list_transform(v, lambda x: x * x)) AS hhi, 1 / list_sum(list_transform(v, lambda x: x * x)) AS effective_owners, list_sum(list_transform(v, lambda x: x * ln(1 / x))) AS entropy,
          coalesce(list_position(list_transform(c, lambda x: x >= 0.5), true), len(v)) AS truck_50, coalesce(list_position(list_transform(c, lambda x: x >= 0.75), true), len(v)) AS truck_75, coalesce(list_position(list_transform(c, lambda x: x >= 0.9), true), len(v)) AS truck_90,
          coalesce(list_sum(list_filter(v, lambda x: x < :major_share)), 0) AS minor_share, len(list_filter(v, lambda x: x >= :major_share)) AS major_owners FROM c""",
    "path_weight": """
        SELECT path, coalesce(w, 1.0) AS weight, w AS configured FROM (
          SELECT path, list_filter(c, lambda x: regexp_matches(path, x.rx))[1].weight AS w FROM (SELECT DISTINCT path FROM {owners}), (SELECT list(struct_pack(rx, weight) ORDER BY ord) AS c FROM {criticality}))""",
    "owner_distribution": """
        WITH j AS (SELECT path, round(top_share, 4) AS s, weight AS w, qualified_owners AS q FROM {concentration} JOIN {path_weight} USING (path) JOIN {path_summary} USING (path)),
        r AS (SELECT s, sum(w) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING) AS below, sum(w) OVER () AS total FROM j)
        SELECT (SELECT min(s) FROM j) AS minimum, (SELECT min(s) FROM r WHERE below >= 0.1 * total) AS p10, (SELECT min(s) FROM r WHERE below >= 0.5 * total) AS median_share, (SELECT min(s) FROM r WHERE below >= 0.9 * total) AS p90,
          (SELECT round(sum(w * s) / sum(w), 6) FROM j) AS critical_path_risk, (SELECT round(coalesce(sum(w) FILTER (q <= :critical_owners), 0) / sum(w), 6) FROM j) AS knowledge_at_risk""",
    "repo_truck_factors": """
        WITH RECURSIVE c AS (SELECT author, count(*) AS n, list(path) AS p FROM {owners} GROUP BY author), t AS (SELECT count(DISTINCT path) AS n FROM {owners}),
        g(k, left_people) AS (SELECT 0, (SELECT list(author ORDER BY n DESC, author) FROM c) UNION ALL SELECT k + 1, left_people[2:] FROM g WHERE len(left_people) > 0),
        v AS (SELECT k, (SELECT count(DISTINCT path) FROM {owners} WHERE list_contains(left_people, author)) AS covered FROM g)
        SELECT q AS quantile, (SELECT min(k) FROM v, t WHERE covered < q * t.n) AS people FROM (SELECT unnest([0.5e0, 0.75e0, 0.9e0]) AS q)""",
    "tiers": "SELECT path, count(*) AS qualified_owners, CASE WHEN count(*) > :warn_owners THEN 'ok' WHEN count(*) > :critical_owners THEN 'warning' ELSE 'critical' END AS tier FROM {owners} GROUP BY path",
    "directory_best": "SELECT string_split(path, '/')[1] AS top, author, max(score) AS score FROM {owners} WHERE len(string_split(path, '/')) > 1 GROUP BY ALL",
    "backups": """
        WITH own AS (SELECT path, list(author) AS own FROM {owners} GROUP BY path),
        near AS (SELECT t.path, d.author, d.score FROM {tiers} AS t JOIN own USING (path) JOIN {directory_best} AS d ON d.top = string_split(t.path, '/')[1] AND contains(t.path, '/') WHERE t.tier <> 'ok' AND NOT list_contains(own.own, d.author)),
        best AS (SELECT author, max(score) AS score FROM {owners} GROUP BY author),
        far AS (SELECT t.path, b.author, b.score FROM {tiers} AS t JOIN own USING (path), best AS b WHERE t.tier <> 'ok' AND NOT list_contains(own.own, b.author) AND t.path NOT IN (SELECT path FROM near))
        SELECT path, author, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, author) AS place FROM (SELECT * FROM near UNION ALL SELECT * FROM far) QUALIFY place <= 3""",
    "removal_summary": """
        WITH p AS (SELECT path, list(author) AS a, list_filter(list(author), lambda x: x <> :removed) AS b FROM {ranked} GROUP BY path)
        SELECT count(*) AS paths, count_if(len(b) = 0) AS orphaned, count_if(len(b) = 1 AND len(a) = 2) AS down_to_one, round(count_if(len(b) = 0) / count(*), 6) AS orphaned_share FROM p""",
    "orphaned_directories": """
        WITH f AS (SELECT path, list_distinct(list(author)) = [:removed] AS gone, string_split(path, '/') AS s FROM {ranked} GROUP BY path),
        d AS (SELECT array_to_string(s[1:k], '/') AS dir, array_to_string(s[1:k - 1], '/') AS parent, gone FROM (SELECT s, gone, unnest(range(1, len(s))) AS k FROM f)),
        g AS (SELECT dir, any_value(parent) AS parent, count(*) AS files FROM d GROUP BY dir HAVING bool_and(gone))
        SELECT dir, files FROM g WHERE parent NOT IN (SELECT dir FROM g)""",
    "transfer_candidates": """
        SELECT p.path, d.author, d.score, row_number() OVER (PARTITION BY p.path ORDER BY d.score DESC, d.author) AS place
        FROM (SELECT path FROM {ranked} GROUP BY path HAVING bool_and(author = :removed)) AS p JOIN {directory_best} AS d ON d.top = string_split(p.path, '/')[1] AND d.author <> :removed QUALIFY place <= 2""",
    "rule_matches": "SELECT t.path, r.line_no FROM {tracked} AS t, {rules} AS r WHERE r.supported AND regexp_matches(t.path, r.rx)",
    "winners": "SELECT path, arg_max(line_no, line_no) AS line_no, arg_max(pattern, line_no) AS pattern, arg_max(owners, line_no) AS owners, arg_max(source, line_no) AS source FROM {rule_matches} JOIN {rules} USING (line_no) GROUP BY path",
    "coverage": "SELECT count(*) AS paths, count_if(l IS NOT NULL) AS covered, count_if(o <> '') AS assigned, round(count_if(l IS NOT NULL) / count(*), 6) AS share FROM (SELECT t.path, w.line_no AS l, w.owners AS o FROM {tracked} AS t LEFT JOIN {winners} AS w USING (path))",
    "dead_rules": "SELECT line_no, pattern FROM {rules} WHERE line_no NOT IN (SELECT line_no FROM {rule_matches})",
    "broad_rules": "SELECT line_no, count(*) AS paths FROM {rule_matches} GROUP BY line_no HAVING 2 * count(*) >= (SELECT count(*) FROM {tracked})",
    "duplicate_rules": "SELECT line_no, pattern FROM {rules} AS r WHERE EXISTS (SELECT 1 FROM {rules} AS e WHERE e.pattern = r.pattern AND e.line_no < r.line_no)",
    "shadowed_rules": "WITH m AS (SELECT path, list(line_no) AS l, max(line_no) AS top FROM {rule_matches} GROUP BY path) SELECT line_no, min(path) AS path, count(*) AS paths, min(top) AS by_line FROM (SELECT unnest(l) AS line_no, path, top FROM m) WHERE line_no < top GROUP BY line_no",
    "divergence": """
        WITH d AS (SELECT w.path, w.line_no, list_distinct(list_filter(string_split(lower(w.owners), ','), lambda x: x <> '')) AS d FROM {winners} AS w), o AS (SELECT path, list(lower(author)) AS o, map_from_entries(list((lower(author), score))) AS s FROM {owners} GROUP BY path)
        SELECT path, line_no, least(1.0, len(list_filter(d, lambda x: NOT list_contains(o, x))) + coalesce(list_sum(list_transform(list_filter(o, lambda x: NOT list_contains(d, x)), lambda x: s[x])), 0)) AS delta,
          round(len(list_intersect(d, o)) / len(list_distinct(list_concat(d, o))), 4) AS overlap, len(list_distinct(list_concat(d, o))) - len(list_intersect(d, o)) AS differing
        FROM d JOIN o USING (path) WHERE len(d) > 0""",
    "drift_missing": "SELECT 'missing' AS category, s.path, s.top_score AS delta, CAST(NULL AS INT) AS line_no, s.qualified_owners, s.decaying > 0 AS decay, 0e0 AS overlap FROM {path_summary} AS s ANTI JOIN {winners} AS w USING (path)",
    "drift_changed": """
        SELECT 'changed' AS category, r.pattern AS path, v.delta, v.line_no, v.qualified_owners, v.decay, v.overlap FROM (
          SELECT line_no, unnest(first(struct_pack(delta, overlap, qualified_owners, decay := decaying > 0) ORDER BY delta DESC, path)) FROM {divergence} JOIN {path_summary} USING (path) WHERE differing > 0 GROUP BY line_no) AS v
        JOIN {rules} AS r USING (line_no) WHERE v.delta >= :drift_min_delta""",
    "drift": """
        WITH d AS (SELECT * FROM {drift_missing} UNION ALL SELECT * FROM {drift_stale} UNION ALL SELECT * FROM {drift_changed}), c AS (SELECT list(struct_pack(rule_rx, weight)) AS c FROM {criticality}),
        w AS (SELECT d.*, least(1.0, coalesce(list_max(list_transform(list_filter(c, lambda x: regexp_matches(path, x.rule_rx)), lambda x: x.weight)), 0.0)) AS weight FROM d, c),
        s AS (SELECT *, 0.4 * (1 - overlap) + 0.25 * least(1.0, abs(delta)) + 0.15 * weight + 0.15 * decay::INT + 0.05 * coalesce(qualified_owners = 1, false)::INT AS score FROM w)
        SELECT category, path, delta, line_no, qualified_owners, decay, overlap, weight, score, ['info', 'low', 'medium', 'high', 'critical'][1 + (score >= 0.15)::INT + (score >= 0.35)::INT + (score >= 0.55)::INT + (score >= 0.75)::INT] AS severity FROM s""",
    "consolidated": """
        WITH s AS (SELECT path, string_agg(author, ',' ORDER BY author) AS owners, string_split(path, '/') AS p FROM {owners} GROUP BY path),
        a AS (SELECT path, owners, k, array_to_string(p[1:k], '/') AS dir, p[1] AS top FROM (SELECT path, owners, p, unnest(range(0, len(p))) AS k FROM s)),
        u AS (SELECT dir FROM a GROUP BY dir HAVING count(*) > 1 AND min(owners) = max(owners) AND (dir <> '' OR count(DISTINCT top) > 1)),
        f AS (SELECT path, owners, first(dir ORDER BY k) AS dir FROM a SEMI JOIN u USING (dir) GROUP BY path, owners)
        SELECT pattern, owners, count(*) AS files FROM (SELECT s.owners, CASE WHEN f.dir IS NULL THEN '/' || s.path WHEN f.dir = '' THEN '*' ELSE '/' || f.dir || '/' END AS pattern FROM s LEFT JOIN f USING (path)) GROUP BY ALL""",
    "risk_factors": """
        WITH d AS (SELECT path, first(recency ORDER BY score DESC, commits DESC, author DESC) AS recency FROM {ranked} GROUP BY path),
        f AS (SELECT s.path, s.primary_owner, c.top_share, CASE WHEN s.change_events > 1 THEN 7 / (7 + coalesce(s.cadence_days, 0)) WHEN s.change_events IS NULL THEN 7 / (7 + coalesce(s.cadence_days, 0)) ELSE 0.05 END AS frequency, nullif(s.cochange_degree, 0) AS coupling,
          coalesce(w.configured, CASE WHEN s.path IN (SELECT path FROM {manifests}) THEN 0.8 END) AS criticality, greatest(0.05, 1 - d.recency) AS decay, c.truck_50
          FROM {path_summary} AS s JOIN {concentration} AS c USING (path) JOIN {path_weight} AS w USING (path) JOIN d USING (path))
        SELECT path, primary_owner, """ + ", ".join(f"CASE WHEN {e} IS NOT NULL THEN least(1.0, greatest(0.0001, round({e}, 4))) END AS {n}" for e, n in (("top_share", "concentration"), ("frequency", "frequency"), ("coupling", "coupling"), ("criticality", "criticality"), ("decay", "decay"))) + """, truck_50 FROM f""",
    "manifests": """
        SELECT path FROM (SELECT path, string_split(path, '/') AS s FROM {tracked}) WHERE s[-1] IN ('Dockerfile', 'Procfile', 'Chart.yaml', 'fly.toml', 'serverless.yml') OR ends_with(s[-1], '.tf') OR list_has_any(s, ['k8s', 'deploy'])
          OR s[-1] SIMILAR TO '(docker-compose|compose)(\\.[^/]*)?\\.(yml|yaml)'""",
    "risk": """
        WITH g AS (SELECT *, list_filter([concentration, frequency, coupling, criticality, decay], lambda x: x IS NOT NULL) AS v FROM {risk_factors}),
        r AS (SELECT *, least(100, CAST(floor(100 * exp(list_avg(list_transform(v, lambda x: ln(x)))) + 0.5) AS BIGINT)) AS risk FROM g)
        SELECT path, risk, CASE WHEN risk < 25 THEN 'low' WHEN risk < 50 THEN 'medium' WHEN risk < 75 THEN 'high' ELSE 'critical' END AS tier, truck_50 = 1 AND concentration >= 0.6 AS single_expert, coalesce(frequency, 0) >= 0.6 AS high_churn, coalesce(coupling, 0) >= 0.6 AS coupled, coalesce(decay, 0) >= 0.6 AS stale_expertise FROM r""",
    "vacuum": "SELECT path, max(score) AS best, min(age) AS days FROM {owners} GROUP BY path HAVING bool_and(status <> 'stable')",
    "transfers": """
        WITH fresh AS (SELECT path, author, score, rank, string_split(path, '/') AS s FROM {owners} WHERE status = 'stable'),
        own AS (SELECT w.path, w.author, (SELECT arg_min(f.author, f.rank) FROM fresh AS f WHERE f.path = w.path) AS own FROM {decay_warnings} AS w),
        f2 AS (SELECT array_to_string(s[1:k], '/') AS dir, k, author, score FROM (SELECT s, author, score, unnest(range(1, len(s))) AS k FROM fresh)),
        w2 AS (SELECT path, author, array_to_string(s[1:k], '/') AS dir FROM (SELECT path, author, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')))) AS k FROM own WHERE own IS NULL)),
        near AS (SELECT w2.path, w2.author, first(f2.author ORDER BY f2.k DESC, f2.score DESC, f2.author) AS near FROM w2 JOIN f2 USING (dir) WHERE f2.author <> w2.author GROUP BY w2.path, w2.author)
        SELECT own.path, own.author, coalesce(own.own, near.near) AS successor FROM own LEFT JOIN near USING (path, author)""",
    "base_primary": f"""
        WITH g AS (SELECT path, author, count(*) AS n, max(ts) AS last FROM {{events_all}} WHERE {_AGE.format('ts')} BETWEEN 90 AND 90 + :lookback_days GROUP BY ALL),
        s AS (SELECT g.path, g.author, 0.6 * exp(-ln(2.0) * ({_AGE.format('g.last')} - 90) / :half_life) + 0.4 * g.n / (m.most + :frequency_prior) AS score FROM g JOIN (SELECT path, max(n) AS most FROM g GROUP BY path) AS m USING (path)),
        t AS (SELECT * FROM s WHERE score >= :threshold QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, author) <= :top_n)
        SELECT s.path, first(s.author ORDER BY s.score DESC, lower(s.author) DESC) AS author, max(s.score) AS score, any_value(c.n) AS qualified_owners FROM t AS s JOIN (SELECT path, count(*) AS n FROM t GROUP BY path) AS c USING (path) GROUP BY s.path""",
    "change_report": """
        WITH h AS (SELECT path, first(author ORDER BY score DESC, lower(author) DESC) AS author, count(*) AS n FROM {owners} GROUP BY path),
        c AS (SELECT coalesce(b.path, h.path) AS path, b.author AS before_owner, h.author AS after_owner, coalesce(b.qualified_owners, 0) AS before_count, coalesce(h.n, 0) AS after_count FROM {base_primary} AS b FULL JOIN h ON h.path = b.path)
        SELECT *, CASE WHEN after_count < before_count AND after_count <= :warn_owners THEN 'regression' WHEN before_owner IS NOT NULL AND after_owner IS NOT NULL AND lower(before_owner) <> lower(after_owner) THEN 'shift' WHEN before_owner IS NULL AND after_owner IS NOT NULL THEN 'new' WHEN after_count = 1 THEN 'single' ELSE 'ok' END AS kind FROM c""",
    "review_load": """
        WITH r AS (SELECT reviewer, count(closed) AS reviews, count(*) FILTER (closed IS NULL) AS waiting FROM {pulls} GROUP BY reviewer HAVING count(closed) > 0), a AS (SELECT round(avg(reviews), 2) AS average, round(avg(waiting), 2) AS wait FROM r)
        SELECT reviewer, reviews, average, waiting, CASE WHEN (average > 0 AND reviews >= 2 * average) OR (wait > 0 AND waiting >= 2 * wait) THEN 'high' WHEN reviews <= average AND waiting <= wait THEN 'low' ELSE 'typical' END AS band FROM r, a""",
    "review_monopolies": """
        WITH t AS (SELECT path, arg_max(author, (n, author)) AS author, max(n) AS top, sum(n) AS total FROM (SELECT path, author, sum(n) AS n FROM {review_counts} GROUP BY ALL) GROUP BY path)
        SELECT t.path, t.author, round(top / total, 4) AS share, k.n AS knowledgeable FROM t JOIN (SELECT path, count(*) AS n FROM {owners} GROUP BY path) AS k USING (path) WHERE top / total >= 0.72 AND k.n > 1""",
    "pair_weights": """
        WITH o AS (SELECT path, author, score, review, array_to_string(string_split(path, '/')[1:-2], '/') AS dir FROM {owners}),
        d AS (SELECT dir, list_sort(list_distinct(list(author))) AS l FROM o WHERE dir <> '' GROUP BY dir), x AS (SELECT l, l[i] AS a, unnest(l[i + 1:]) AS b FROM (SELECT l, unnest(range(1, len(l))) AS i FROM d)),
        p AS (SELECT x.author AS a, y.author AS b, least(x.score, y.score) + coalesce(CASE WHEN x.review IS NOT NULL AND y.review IS NOT NULL THEN least(x.review, y.review) END, 0) AS w FROM o AS x JOIN o AS y ON x.path = y.path AND x.author < y.author UNION ALL SELECT a, b, 0.25 FROM x)
        SELECT a, b, sum(w) AS weight FROM p GROUP BY ALL""",
    "team_closure": """
        WITH RECURSIVE up(slug, above) AS (SELECT slug, slug FROM {teams} UNION SELECT u.slug, t.parent FROM up AS u JOIN {teams} AS t ON t.slug = u.above WHERE t.parent IS NOT NULL)
        SELECT DISTINCT u.above AS slug, m.login FROM up AS u JOIN {team_members} AS m ON m.slug = u.slug SEMI JOIN {teams} AS k ON k.slug = u.above""",
    "narrowest_team": """
        WITH t AS (SELECT slug, list(login) AS l FROM {team_closure} GROUP BY slug), o AS (SELECT path, list(author) AS a FROM {owners} GROUP BY path)
        SELECT path, first(slug ORDER BY len(l), slug) AS slug FROM o, t WHERE list_has_all(l, a) GROUP BY path""",
    "contributor_status": f"""
        SELECT e.author, coalesce(r.status, CASE WHEN e.author IN (SELECT author FROM {{bot_authors}}) THEN 'bot' WHEN starts_with(e.author, '@') AND lower(e.author[2:]) NOT IN (SELECT lower(login) FROM {{org_members}}) THEN 'external' WHEN e.age IS NULL THEN CASE WHEN starts_with(e.author, '@') THEN 'inactive' ELSE 'unknown' END WHEN trunc(e.age) > :decay_days THEN 'inactive' ELSE 'active' END) AS status
        FROM (SELECT author, min({_AGE.format('ts')}) FILTER (ts <= TIMESTAMP :as_of) AS age FROM {{events_all}} GROUP BY author) AS e LEFT JOIN {{roster_status}} AS r ON lower(replace(r.identity, '@', '')) = lower(replace(e.author, '@', ''))""",
    "mass_commits": "WITH n AS (SELECT sha, count(*) AS modified FROM {modifications} GROUP BY sha) SELECT sha, modified FROM n WHERE modified / (SELECT count(*) FROM {tracked}) >= 0.5",
    "assessment": """
        WITH d AS (SELECT path, list_filter(string_split(lower(owners), ','), lambda x: x <> '') AS d FROM {winners}), m AS (SELECT lower(slug) AS slug, list(lower(login)) AS l FROM {team_closure} GROUP BY ALL),
        t AS (SELECT d.path, flatten(list(m.l)) AS l FROM (SELECT path, unnest(list_filter(d, lambda x: contains(x, '/'))) AS team FROM d) AS d JOIN m ON m.slug = string_split(d.team, '/')[-1] GROUP BY d.path),
        o AS (SELECT path, list(lower(author)) AS o FROM {owners} GROUP BY path)
        SELECT o.path, CASE WHEN coalesce(len(d.d), 0) = 0 THEN 'unverifiable' WHEN list_has_any(o.o, list_concat(d.d, coalesce(t.l, []))) THEN 'aligned' ELSE 'diverged' END AS verdict FROM o LEFT JOIN d USING (path) LEFT JOIN t USING (path)""",
    "phantom_owners": """
        SELECT w.path, w.owner FROM (SELECT path, unnest(list_distinct(list_filter(string_split(lower(owners), ','), lambda x: x <> ''))) AS owner FROM {winners} SEMI JOIN {owners} USING (path)) AS w
        ANTI JOIN (SELECT path, lower(author) AS owner FROM {scored} WHERE commits > 0 OR review > 0) AS s USING (path, owner)""",
    # facts read once more, from what they mean
    "subject_templates": r"""
        SELECT author, trim(regexp_replace(array_to_string(regexp_split_to_array(lower(subject), '\b[0-9a-f]{7,}\b|[0-9]+([.][0-9]+)*'), ''), ' +', ' ', 'g')) AS template, count(*) AS n FROM {commits} GROUP BY ALL""",
    "trend_scores": f"""
        WITH e AS (SELECT p.period, (:periods - 1 - p.period) * :period_days AS back, e.path, e.author, count(*) AS n, min(e.age) AS age FROM (SELECT unnest(range(0, :periods)) AS period) AS p JOIN (SELECT path, author, {_AGE.format('ts')} AS age FROM {{events_all}}) AS e
          ON e.age BETWEEN (:periods - 1 - p.period) * :period_days AND :periods * :period_days GROUP BY ALL),
        m AS (SELECT period, path, max(n) AS most FROM e GROUP BY ALL),
        s AS (SELECT period, path, max((:w_recency * pow(2, -greatest(0, age - back) / :half_life) + :w_frequency * least(1, n / (most + :frequency_prior))) / (:w_recency + :w_frequency)) AS top FROM e JOIN m USING (period, path) GROUP BY ALL)
        SELECT period, round(avg(top), 4) AS mean_top_score, count(*) AS scored_paths FROM s GROUP BY period""",
    "trend_report": f"""
        WITH e AS (SELECT p.period, (:periods - 1 - p.period) * :period_days AS back, e.path, e.author, e.sha, e.age FROM (SELECT unnest(range(0, :periods)) AS period) AS p JOIN (SELECT path, author, sha, {_AGE.format('ts')} AS age FROM {{events_all}}) AS e
          ON e.age BETWEEN (:periods - 1 - p.period) * :period_days AND :periods * :period_days),
        g AS (SELECT period, path, list(struct_pack(n := n, age := age - back)) AS l, max(n) AS most FROM (SELECT period, back, path, author, count(*) AS n, min(age) AS age FROM e GROUP BY ALL) GROUP BY ALL),
        s AS (SELECT period, list_transform(l, lambda x: (:w_recency * pow(2, -greatest(0, x.age) / :half_life) + :w_frequency * least(1, x.n / (most + :frequency_prior))) / (:w_recency + :w_frequency)) AS scores FROM g),
        q AS (SELECT period, list_max(scores) AS top, least(:top_n, len(list_filter(scores, lambda x: x >= :threshold))) AS n FROM s),
        a AS (SELECT period, count(DISTINCT sha) AS commits, count(DISTINCT author) AS contributors, count(DISTINCT path) AS paths FROM e GROUP BY ALL)
        SELECT period, commits, contributors, paths, round(avg(top), 4) AS mean_top_score, round(avg(n), 4) AS mean_qualified, count(*) FILTER (n <= :critical_owners) AS critical_paths, count(*) AS scored_paths FROM q JOIN a USING (period) GROUP BY ALL""",
    "explanations": """
        WITH s AS (SELECT path, list(struct_pack(a := author, s := score, q := quality) ORDER BY score DESC, author) AS l, CAST(sum(commits) AS BIGINT) AS commits FROM {scored} GROUP BY path),
        x AS (SELECT path, commits, list_filter(l[1:3], lambda p: p.s >= :threshold) AS own, list_filter(l, lambda p: p.s < :threshold) AS below FROM s),
        d AS (SELECT path, array_to_string(list_sort(list_distinct(list(owner))), ',') AS declared FROM {declared} GROUP BY path)
        SELECT path, array_to_string(list_sort(list_transform(own, lambda p: p.a)), ',') AS owners, array_to_string(list_sort(list_transform(below, lambda p: p.a)), ',') AS candidates, round(list_max(list_transform(own, lambda p: p.q)), 4) AS quality, commits,
          coalesce(declared, '') AS declared, (SELECT max(w.line_no) FROM {winners} AS w WHERE w.path = x.path) AS rule_line, coalesce((SELECT max(a.verdict) FROM {assessment} AS a WHERE a.path = x.path), 'unverifiable') AS assessment
        FROM x LEFT JOIN d USING (path)""",
    "rule_owners": "SELECT line_no, unnest(list_filter(string_split(owners, ','), lambda x: x <> '')) AS owner FROM {rules}",
    "review_counts_total": """
        SELECT reviewer, count(*) AS reviews, len(list_distinct(list(number))) AS pulls, CAST(sum(lines) AS BIGINT) AS lines, round(quantile_cont(date_diff('second', opened, closed) / 3600, 0.5), 2) AS median_hours, round(quantile_cont(CAST(lines AS DOUBLE), 0.5), 2) AS median_lines
        FROM {pulls} WHERE closed IS NOT NULL GROUP BY reviewer""",
    "duplicate_identities": """
        WITH s AS (SELECT identity, 'name' AS reason, lower(name) AS sign FROM {identities} WHERE name <> '' UNION ALL SELECT identity, 'local part', lower(string_split(email, '@')[1]) FROM {identities} WHERE email <> ''),
        g AS (SELECT reason, list(identity) AS l FROM s GROUP BY reason, sign HAVING count(*) > 1)
        SELECT unnest(list_filter(l, lambda x: x <> list_min(l))) AS identity, list_min(l) AS first_identity, reason, len(l) AS members FROM g""",
    "handles": """
        SELECT email, CASE WHEN contains(lower(email), '@users.noreply.') THEN split_part(split_part(lower(email), '@', 1), '+', -1) ELSE 'email:' || left(sha256(lower(email)), 16) END AS handle FROM {identities}""",
    "pseudonyms": "SELECT identity, 'person-' || left(sha256(concat_ws(chr(10), :repo_id, lower(identity))), 12) AS pseudonym FROM {identities}",
    "rename_commits": "SELECT sha, len(list(similarity)) AS renames, list_min(list(similarity)) AS similarity FROM {moves} GROUP BY sha",
    "invalid_rules": "SELECT line_no, pattern, CASE WHEN starts_with(pattern, '!') THEN 'negation' ELSE 'brackets' END AS problem FROM {rules} WHERE starts_with(pattern, '!') OR contains(pattern, '[')",
    "expired_suppressions": "SELECT rule, path FROM {suppressions} WHERE date_diff('day', expires, CAST(TIMESTAMP :as_of AS DATE)) > 0",
    "redacted_subjects": "SELECT sha, regexp_replace(regexp_replace(subject, '#[0-9]+', '#', 'g'), '[a-zA-Z0-9+._-]+@[a-zA-Z0-9.-]+', '[address]', 'g') AS subject FROM {commits}",
    "waiting_reviews": "SELECT reviewer, count(*) FILTER (closed IS NULL) AS waiting FROM {pulls} GROUP BY reviewer HAVING bool_or(closed IS NULL)",
    "first_response": "SELECT number, min(date_diff('second', opened, closed)) / 3600 AS hours FROM {pulls} GROUP BY number HAVING max(closed) IS NOT NULL",
    "last_written": "SELECT t.path, max(r.line_no) AS line_no FROM {tracked} AS t, {rules} AS r WHERE regexp_matches(t.path, r.rx) GROUP BY t.path",
    "star_owners": "SELECT unnest(list_filter(string_split(arg_max(owners, line_no), ','), lambda x: x <> '')) AS owner FROM {rules} WHERE pattern IN ('*', '/')",
    "nearest_owners": """
        WITH n AS (SELECT t.path, arg_max(f.dir, len(f.dir)) AS dir FROM {tracked} AS t JOIN {owners_files} AS f ON f.dir = '' OR starts_with(t.path, f.dir || '/') GROUP BY t.path)
        SELECT n.path, n.dir, f.owner FROM n JOIN {owners_files} AS f USING (dir)""",
    "nested_owners": """
        WITH b AS (SELECT t.path, max(struct_pack(n := len(r.dir), line := r.line, dir := r.dir, owner := r.owner)) AS b FROM {tracked} AS t JOIN {nested_rules} AS r ON starts_with(t.path, r.dir || '/') AND (regexp_matches(t.path[len(r.dir) + 2:], r.rx) OR regexp_matches(t.path, r.rx)) GROUP BY t.path)
        SELECT path, b.dir AS dir, b.line AS line, b.owner AS owner FROM b""",
    "attribute_values": """
        WITH b AS (SELECT t.path, a.attr, max(struct_pack(n := len(a.dir), line := a.line, v := a.value)) AS b FROM {tracked} AS t JOIN {attr_rules} AS a ON a.dir = '' AND regexp_matches(t.path, a.rx) OR a.dir <> '' AND starts_with(t.path, a.dir || '/') AND regexp_matches(t.path[len(a.dir) + 2:], a.rx) GROUP BY ALL)
        SELECT path, attr, b.v AS value FROM b""",
    "dependencies": "SELECT dependent, dependency FROM {import_edges} SEMI JOIN {tracked} AS a ON a.path = dependent SEMI JOIN {tracked} AS b ON b.path = dependency WHERE dependent <> dependency GROUP BY ALL",
    "resolved": """
        WITH x AS (SELECT i.identity, i.email, o.handle AS a, h.handle AS b, h.source AS hit, CASE WHEN contains(lower(i.email), '@users.noreply.') THEN split_part(split_part(lower(i.email), '@', 1), '+', -1) END AS c
          FROM {identities} AS i LEFT JOIN {overrides} AS o ON lower(o.identity) = lower(i.identity) LEFT JOIN {hits} AS h ON lower(h.identity) = lower(i.identity)),
        y AS (SELECT identity, email, coalesce(a, b, c) AS handle, coalesce(CASE WHEN a IS NOT NULL THEN 'override' END, CASE WHEN b IS NOT NULL THEN hit END, CASE WHEN c IS NOT NULL THEN 'noreply' END, 'none') AS source FROM x)
        SELECT identity, handle, source, CAST(CASE WHEN source = 'search' THEN 0.5 WHEN source = 'none' AND contains(email, '@') THEN 0.75 ELSE 1 END AS DOUBLE) AS factor FROM y""",
    "cached_handles": """
        SELECT identity, handle, coalesce(CASE WHEN handle IS NOT NULL THEN 'hit' END, CASE WHEN date_diff('second', seen, TIMESTAMP :as_of) <= 86400 * :miss_days THEN 'miss' END, 'expired') AS state FROM {handle_cache}""",
    "merges": """
        WITH g AS (SELECT handle, list(struct_pack(i := identity, s := source) ORDER BY identity) AS l FROM {resolved} WHERE handle IS NOT NULL AND factor = 1 GROUP BY handle HAVING count(*) > 1),
        m AS (SELECT handle, l[1].i AS first_identity, unnest(l[2:]) AS x FROM g)
        SELECT handle, first_identity, x.i AS identity, x.s AS source FROM m WHERE list_sort([lower(first_identity), lower(x.i)]) NOT IN (SELECT list_sort([lower(a), lower(b)]) FROM {separations} WHERE a IS NOT NULL AND b IS NOT NULL)""",
    "audit_identities": """
        SELECT i.identity, i.email, o.handle AS override_handle, CASE WHEN o.identity IS NULL THEN 'seen only' ELSE 'both' END AS state FROM {identities} AS i LEFT JOIN {overrides} AS o ON lower(o.identity) = lower(i.identity)
        UNION ALL SELECT identity, NULL, handle, 'override only' FROM {overrides} WHERE lower(identity) NOT IN (SELECT lower(identity) FROM {identities})""",
    "dirty_paths": """
        SELECT b.path, CASE WHEN b.path NOT IN (SELECT path FROM {blobs_before}) THEN 'new' WHEN EXISTS (SELECT 1 FROM {blobs_before} AS p WHERE p.path = b.path AND p.blob = b.blob) THEN 'reused' ELSE 'changed' END AS state FROM {blobs} AS b""",
    "mixed_blame": """
        WITH l AS (SELECT path, author, sum(n_lines) AS n, false AS old FROM {blame_lines} GROUP BY ALL UNION ALL SELECT path, author, sum(n_lines), true FROM {blame_before} GROUP BY ALL),
        t AS (SELECT path, old, sum(n) AS n FROM l GROUP BY ALL) SELECT l.path, l.author, l.n / t.n AS share, d.state FROM l JOIN t USING (path, old) JOIN {dirty_paths} AS d USING (path) WHERE l.old = (d.state = 'reused')""",
    "review_window": "SELECT reviewer, count(*) AS pulls FROM {pulls} WHERE coalesce(closed, opened) BETWEEN TIMESTAMP :as_of - to_days(:lookback_days) AND TIMESTAMP :as_of GROUP BY reviewer",
    # findings and teams
    "findings": """
        WITH o AS (SELECT line_no, array_to_string(list_sort(string_split(lower(owners), ',')), ',') AS owners FROM {rules}),
        f AS (SELECT category || '-drift' AS rule, path, coalesce(owners, '') AS owners FROM {drift} LEFT JOIN o USING (line_no) UNION SELECT 'single-expert', path, '' FROM {tiers} WHERE tier = 'critical' UNION SELECT 'shadowed-rule', pattern, o.owners FROM {rules} AS r SEMI JOIN {shadowed_rules} USING (line_no) JOIN o USING (line_no))
        SELECT *, sha256(concat_ws('|', rule, path, owners)) AS fingerprint FROM f""",
    "new_findings": """
        SELECT * FROM {findings} WHERE (rule, path, owners) NOT IN (SELECT (rule, path, owners) FROM {baseline}) AND (rule, path) NOT IN (SELECT (rule, path) FROM {suppressed})""",
    "settled_findings": "SELECT rule, path, owners FROM {baseline} EXCEPT ALL SELECT rule, path, owners FROM {findings}",
    "team_drift": """
        WITH o AS (SELECT line_no, list_distinct(list(lower(a.author))) AS seen FROM {winners} AS w JOIN {owners} AS a USING (path) GROUP BY line_no),
        r AS (SELECT line_no, list_filter(string_split(lower(owners), ','), lambda x: x <> '') AS named FROM {rules}),
        m AS (SELECT lower(slug) AS team, list(lower(login)) AS l FROM {team_closure} GROUP BY ALL),
        t AS (SELECT r.line_no, unnest(list_filter(named, lambda x: contains(x, '/'))) AS team, list_filter(named, lambda x: NOT contains(x, '/')) AS beside FROM r),
        x AS (SELECT t.line_no, t.team, string_split(t.team, '/')[-1] AS slug, beside, o.seen FROM t JOIN o USING (line_no)),
        y AS (SELECT x.*, slug IN (SELECT lower(slug) FROM {teams}) AS known, slug IN (SELECT lower(parent) FROM {teams} WHERE parent IS NOT NULL) AS nested, coalesce(m.l, []) AS members FROM x LEFT JOIN m ON m.team = x.slug)
        SELECT line_no, team, CASE WHEN NOT known THEN 'invisible' WHEN nested THEN 'nested' WHEN len(members) = 0 THEN 'empty' WHEN len(list_filter(seen, lambda p: NOT list_contains(list_concat(members, beside), p))) > 0 THEN 'partial-drift' ELSE 'aligned' END AS status,
          CASE WHEN known THEN round(len(list_filter(seen, lambda p: list_contains(list_concat(members, beside), p))) / len(seen), 4) END AS coverage,
          CASE WHEN known THEN array_to_string(list_sort(list_filter(members, lambda p: NOT list_contains(seen, p))), ',') ELSE '' END AS inactive,
          CASE WHEN known THEN array_to_string(list_sort(list_filter(seen, lambda p: NOT list_contains(list_concat(members, beside), p))), ',') ELSE '' END AS outside FROM y""",
    # people, evidence and departures
    "shares": """
        WITH t AS (SELECT path, list(struct_pack(a := author, s := score, r := rank) ORDER BY rank) AS l, sum(score) AS whole FROM {ranked} WHERE score > 0 GROUP BY path),
        u AS (SELECT path, l, whole, unnest(range(1, len(l) + 1)) AS i FROM t)
        SELECT path, l[i].a AS author, l[i].s AS score, l[i].s / whole AS share, l[i].r AS rank, list_sum(list_transform(l[:i], lambda x: x.s)) / whole AS covered FROM u""",
    "evidence": "SELECT path, author, kind, value FROM {signals} UNPIVOT (value FOR kind IN (recency, frequency, blame, review, survival))",
    "tier_counts": "SELECT t.tier, len(list_filter(x.l, lambda y: y = t.tier)) AS paths FROM (SELECT DISTINCT tier FROM {tiers}) AS t, (SELECT list(tier) AS l FROM {tiers}) AS x",
    "removal": "SELECT path, len(l) AS before_count, len(list_filter(l, lambda a: a <> :removed)) AS after_count FROM (SELECT path, list(author) AS l FROM {ranked} GROUP BY path)",
    "person_load": """
        SELECT DISTINCT author, count(*) OVER w AS paths, CAST(sum(commits) OVER w AS BIGINT) AS commits, first_value(score) OVER (w ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM {ranked} WINDOW w AS (PARTITION BY author)""",
    "person_best": "SELECT author, x.path, -x.score AS score, -x.commits AS commits FROM (SELECT author, min(struct_pack(score := -score, commits := -commits, path := path)) AS x FROM {ranked} GROUP BY author)",
    "owner_sets": "SELECT path, array_to_string(list_sort(list_distinct(list(author))), ',') AS owners FROM {owners} GROUP BY path",
    "co_owners": """
        WITH p AS (SELECT path, list(struct_pack(a := author, s := score)) AS l FROM {owners} GROUP BY path), x AS (SELECT unnest(l) AS x, l FROM p), y AS (SELECT x, unnest(l) AS y FROM x)
        SELECT x.a AS author, y.a AS other, max(y.s) AS best, count(*) AS paths FROM y WHERE x.a <> y.a GROUP BY ALL""",
    "person_dirs": "SELECT DISTINCT author, regexp_replace(path, '/[^/]*$', '') AS dir FROM {owners} WHERE regexp_matches(path, '/')",
    "last_activity": "SELECT path, CAST(list_min(list(age)) AS BIGINT) AS days FROM {owners} GROUP BY path",
    "former_share": """
        SELECT round(coalesce((SELECT sum(score) FROM {ranked} WHERE score > 0 AND author IN (SELECT author FROM {contributor_status} WHERE status = 'former')), 0) / (SELECT sum(score) FROM {ranked} WHERE score > 0 AND author IN (SELECT author FROM {contributor_status})), 6) AS share""",
    "weighted_degree": "SELECT person, sum(weight) AS degree FROM (SELECT unnest([a, b]) AS person, weight FROM {pair_weights}) GROUP BY person",
    "modularity": """
        WITH t AS (SELECT sum(weight) AS m FROM {pair_weights}), k AS (SELECT login, slug, coalesce((SELECT sum(weight) FROM {pair_weights} WHERE a = login OR b = login), 0) AS k FROM {team_members})
        SELECT sum(coalesce((SELECT sum(weight) FROM {pair_weights} WHERE (a = x.login AND b = y.login) OR (a = y.login AND b = x.login)), 0) / (2 * m) - x.k * y.k / (4 * m * m)) AS modularity FROM k AS x JOIN k AS y ON x.slug = y.slug, t WHERE x.k > 0 AND y.k > 0""",
    "team_coverage": """
        WITH s AS (SELECT slug, list(DISTINCT login) AS l FROM {team_members} GROUP BY slug), d AS (SELECT top, list(DISTINCT author) AS seen FROM {directory_best} GROUP BY top)
        SELECT top, slug, round(len(list_intersect(l, seen)) / len(l), 6) AS coverage FROM d, s WHERE list_has_any(l, seen)""",
    "capped_contributions": "SELECT * REPLACE (CASE WHEN author IN (SELECT author FROM {mechanical_authors}) AND credit > 1 THEN 1.0 ELSE credit END AS credit) FROM {contributions}",
    "active_paths": "SELECT DISTINCT path FROM {kept_contributions} WHERE commits >= :min_commits",
    # rules, drift and risk
    "declared": """
        SELECT w.path, w.line_no, lower(o.owner) AS owner FROM {winners} AS w, (SELECT line_no, unnest(list_filter(string_split(owners, ','), lambda x: x <> '')) AS owner FROM {rules}) AS o WHERE o.line_no = w.line_no AND w.path IN (SELECT path FROM {owners})""",
    "drift_severity": """
        SELECT coalesce((list_filter(['critical', 'high', 'medium', 'low', 'info'], lambda s: list_contains(l, s)))[1], 'info') AS severity, n AS entries, high AS high_entries
        FROM (SELECT coalesce(list(severity), []) AS l, count(*) AS n, count_if(coalesce(delta >= 0.7, false) OR coalesce(qualified_owners <= :critical_owners, false) OR coalesce(decay, false)) AS high FROM {drift})""",
    "suppressed": """
        SELECT DISTINCT rule, path FROM {findings} AS f WHERE EXISTS (SELECT 1 FROM {suppressions} AS s WHERE s.rule = f.rule AND coalesce(s.expires, DATE '9999-12-31') >= CAST(TIMESTAMP :as_of AS DATE) AND (s.path = f.path OR regexp_matches(f.path, s.rx)))""",
    "risk_summary": "SELECT DISTINCT tier, count(*) OVER w AS paths, max(risk) OVER w AS worst FROM {risk} WINDOW w AS (PARTITION BY tier)",
    "worst_risk": "SELECT path, risk, tier FROM {risk} QUALIFY row_number() OVER (ORDER BY list_position(['critical', 'high', 'medium'], tier) NULLS LAST, risk DESC, path) = 1",
    "shadow_experts": """
        WITH d AS (SELECT path, list(owner) AS l FROM {declared} GROUP BY path) SELECT o.path, o.author, o.score FROM {owners} AS o JOIN d USING (path) WHERE o.rank = 1 AND NOT list_contains(d.l, lower(o.author))""",
    "role_divergence": """
        WITH s AS (SELECT path, min(struct_pack(v := -blame, a := author)) FILTER (WHERE blame > 0) AS w, min(struct_pack(v := -review, a := author)) FILTER (WHERE review > 0) AS r FROM {scored} GROUP BY path), d AS (SELECT path, list(owner) AS l FROM {declared} GROUP BY path)
        SELECT path, w.a AS writer, r.a AS reviewer FROM s JOIN d USING (path) WHERE w.a <> r.a AND NOT list_has_any(d.l, [lower(w.a), lower(r.a)])""",
    "pathologies": """
        WITH k AS (SELECT path, list_concat(coalesce(v.l, []), coalesce(p.l, []), coalesce(s.l, []), coalesce(r.l, [])) AS l FROM (SELECT path, list('vacuum') AS l FROM {vacuum} GROUP BY path) AS v
          FULL JOIN (SELECT path, list('phantom') AS l FROM {phantom_owners} GROUP BY path) AS p USING (path) FULL JOIN (SELECT path, list('shadow') AS l FROM {shadow_experts} GROUP BY path) AS s USING (path) FULL JOIN (SELECT path, list('divergence') AS l FROM {role_divergence} GROUP BY path) AS r USING (path))
        SELECT path, kind, len(list_filter(l, lambda x: x = kind)) AS n FROM (SELECT path, l, unnest(list_distinct(l)) AS kind FROM k)""",
    "change_kinds": "SELECT unnest(map_keys(h)) AS kind, unnest(map_values(h)) AS paths FROM (SELECT histogram(kind) AS h FROM {change_report})",
    "declared_teams": """
        WITH o AS (SELECT DISTINCT unnest(string_split(lower(owners), ',')) AS owner FROM {rules}), t AS (SELECT owner, string_split(owner, '/')[-1] AS slug FROM o WHERE contains(owner, '/'))
        SELECT owner, slug IN (SELECT lower(slug) FROM {teams}) AS known, (SELECT count(DISTINCT login) FROM {team_closure} AS c WHERE lower(c.slug) = t.slug AND t.slug IN (SELECT lower(slug) FROM {teams})) AS members FROM t""",
    # graphs and identities
    "graph_degree": "SELECT node, count(*) AS degree FROM (SELECT unnest([src, dst]) AS node FROM {graph_edges}) GROUP BY node",
    "orphan_groups": "SELECT regexp_extract(path, '^[^/]*') AS dir, count(*) AS paths FROM {vacuum} GROUP BY ALL",
    "orphan_dependents": "SELECT dependency AS path, count(*) AS dependents FROM {dependencies} SEMI JOIN (SELECT path AS dependency FROM {vacuum}) USING (dependency) GROUP BY dependency",
    "identity_matches": """
        WITH q AS (SELECT query, ltrim(lower(query), '@') AS full_, string_split(ltrim(lower(query), '@'), '@')[1] AS part FROM {queries}), a AS (SELECT author, ltrim(lower(author), '@') AS full_, string_split(ltrim(lower(author), '@'), '@')[1] AS part FROM {author_index})
        SELECT query, author FROM q JOIN a ON q.full_ = a.full_ UNION SELECT query, author FROM q JOIN a ON q.part = a.full_ UNION SELECT query, author FROM q JOIN a ON q.full_ = a.part""",
    "unresolved": "SELECT identity, email FROM {identities} WHERE strpos(email, '@') > 0 AND identity IN (SELECT identity FROM {resolved} WHERE source = 'none')",
    # policy, the target and completeness
    "drift_stale": """
        SELECT 'stale' AS category, pattern AS path, 1e0 AS delta, line_no, CAST(NULL AS BIGINT) AS qualified_owners, false AS decay, CAST(owners = '' AS INT) * 1e0 AS overlap FROM {rules} WHERE line_no IN (SELECT line_no FROM {dead_rules})""",
    "lineage_confidence": "SELECT o.path, author, score, quality * least(100, coalesce((SELECT min(similarity) FROM {moves} AS m WHERE m.path = o.path), 100)) / 100.0 AS quality FROM {owners} AS o",
    "security_findings": """
        WITH x AS (SELECT s.path, c.effective_owners < 2 AS few, coalesce(w.owners, '') = '' AS bare, s.decaying = s.qualified_owners AS stale FROM {path_summary} AS s JOIN {concentration} AS c USING (path) LEFT JOIN {winners} AS w USING (path), (SELECT list(rx) AS l FROM {security}) AS r
          WHERE len(list_filter(r.l, lambda p: regexp_matches(s.path, p))) > 0)
        SELECT path, CAST(coalesce(few, false) AS INT) + 2 * CAST(bare AS INT) + 4 * CAST(coalesce(stale, false) AS INT) AS problems FROM x WHERE few OR bare OR stale""",
    "shadowed_generated": """
        WITH g AS (SELECT m.path, list(m.line_no) AS l FROM {rule_matches} AS m JOIN {rules} AS r USING (line_no) WHERE r.source = 'generated' GROUP BY m.path),
        x AS (SELECT w.line_no, w.path, list_filter(g.l, lambda n: n < w.line_no) AS l FROM {winners} AS w JOIN g USING (path) WHERE w.source = 'manual')
        SELECT line_no, max(list_max(l)) AS hidden_line, count(*) AS paths FROM x WHERE len(l) > 0 GROUP BY line_no""",
    "match_chain": "SELECT path, l[i] AS line_no, i AS step FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, list_sort(list(line_no)) AS l FROM {rule_matches} WHERE starts_with(path, :target || '/') GROUP BY path))",
    "explanation": """
        WITH t AS (SELECT author, list(struct_pack(score := score, recency := recency, frequency := frequency, blame := blame, review := review, survival := survival, status := status) ORDER BY score DESC, commits, path) AS l FROM {scored} WHERE starts_with(path, :target || '/') GROUP BY author)
        SELECT author, l[1].score AS score, l[1].recency AS recency, l[1].frequency AS frequency, l[1].blame AS blame, l[1].review AS review, l[1].survival AS survival, l[1].status AS status, len(l) AS paths FROM t""",
    "why_not": """
        WITH s AS (SELECT * FROM {scored} ANTI JOIN {owners} USING (path, author) WHERE starts_with(path, :target || '/'))
        SELECT author, count(*) AS paths, count(*) FILTER (score < :threshold) AS below_threshold, count(*) FILTER (score >= :threshold) AS beyond_top, max(score) AS best FROM s GROUP BY author""",
    "outside_window": """
        WITH t AS (SELECT author, max(ts) AS last_commit FROM {events_all} WHERE starts_with(path, :target || '/') GROUP BY author) SELECT * FROM t WHERE last_commit < TIMESTAMP :as_of - to_days(:lookback_days)""",
    "layers": """
        WITH d AS (SELECT string_split(path, '/')[1] AS top, list_sort(list_distinct(list(owner))) AS l FROM {declared} GROUP BY ALL), o AS (SELECT string_split(path, '/')[1] AS top, list_sort(list_distinct(list(author))) AS l FROM {owners} WHERE rank = 1 GROUP BY ALL)
        SELECT top, array_to_string(o.l, ',') AS observed, coalesce(array_to_string(d.l, ','), '') AS declared FROM o LEFT JOIN d USING (top)""",
    "without_person": "SELECT path, len(l) AS owners, list_max(l) AS top_score FROM (SELECT path, list(score) FILTER (lower(author) <> lower(:removed)) AS l FROM {ranked} GROUP BY path) WHERE l IS NOT NULL",
    "private_owners": "SELECT path, 'person-' || left(sha256(concat(:repo_id, chr(10), lower(author))), 12) AS person, score FROM {owners}",
    "completeness": "SELECT round(1 - len(l) / 13.0, 4) AS completeness, len(l) AS gaps FROM (SELECT coalesce(list(DISTINCT code), []) AS l FROM {gap_list})",
    "reviewer_suggestions": """
        SELECT author, max(score) AS score, count(*) AS covered, max(last_commit) AS last_commit, CAST(author IN (SELECT reviewer FROM {review_load} WHERE band = 'high') AS INT) AS overloaded FROM {owners} WHERE starts_with(path, :target || '/') GROUP BY author""",
    "stale_declared": "SELECT path, d.owner, x.status FROM {declared} AS d JOIN (SELECT path, unnest(list(struct_pack(who := lower(author), status := status))) AS x FROM {decay_warnings} GROUP BY path) USING (path) WHERE x.who = d.owner",
    "solo_repository": "SELECT len(l) AS people, len(l) < 2 AS solo FROM (SELECT coalesce(list_distinct(list(author)), []) AS l FROM {owners})",
    "single_owner_paths": "SELECT path, CAST(path IN (SELECT path FROM {backups}) AS INT) AS has_backup FROM {tiers} WHERE qualified_owners = 1",
    "team_status": """
        WITH c AS (SELECT w.line_no, m.slug, len(list_distinct(list(o.path))) AS paths FROM {winners} AS w JOIN {owners} AS o USING (path) JOIN {team_members} AS m ON m.login = o.author GROUP BY ALL)
        SELECT line_no, x.slug, -x.paths AS paths FROM (SELECT line_no, min(struct_pack(paths := -paths, slug := slug)) AS x FROM c GROUP BY line_no)""",
    "mentors": "SELECT x.author, -x.paths AS paths, -x.commits AS commits FROM (SELECT unnest(list_sort(list(struct_pack(paths := -paths, commits := -commits, author := author)))[1:3]) AS x FROM {expertise})",
    "removal_distribution": """
        WITH x AS (SELECT list(before_top) AS b, list(after_top) FILTER (after_top IS NOT NULL) AS a FROM {left_shares})
        SELECT round(list_avg(b), 6) AS before_mean, round(list_avg(a), 6) AS after_mean, round(list_max(b), 6) AS before_most, round(list_max(a), 6) AS after_most, len(list_filter(b, lambda v: round(v, 9) >= 0.5)) AS before_concentrated, len(list_filter(a, lambda v: round(v, 9) >= 0.5)) AS after_concentrated, len(b) AS before_paths, len(a) AS after_paths FROM x""",
}

OPERATORS = {name: Operator(name, text, "Second definition.") for name, text in TEXTS.items()}
