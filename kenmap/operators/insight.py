"""Reports on top of the others: drift entries and teams, layers, attributes, dependencies, departures, reuse, identities, findings of all kinds.

Facts besides the others: import_edges(dependent, dependency), attr_rules(dir, line, rx, attr, value), owners_files(dir, owner),
nested_rules(dir, line, rx, owner), blobs(path, blob), blobs_before(path, blob), policy(check_name, level),
overrides(identity, handle), handle_cache(identity, handle, seen), separations(a, b), hits(identity, handle, source), queries(query).
"""

_REASONS = (("truck_50 <= 1", "concentration", "single expert"), ("frequency IS NOT NULL", "frequency", "high churn"), ("coupling IS NOT NULL", "coupling", "dependency criticality"),
            ("decay IS NOT NULL", "decay", "stale expertise"), ("criticality <= 0.2e0", "1e0 - criticality", "low criticality"))

SQL = {
    # rules and drift
    "last_written": ("The last rule of the file that matches a path, whether this engine supports it or not.", """
        SELECT path, max(line_no) AS line_no FROM (
          SELECT t.path, r.line_no FROM {tracked} AS t JOIN {rules} AS r ON split_part(t.path, '/', 1) = r.top AND @matches(t.path, r.rx)
          UNION ALL SELECT t.path, r.line_no FROM {tracked} AS t JOIN {rules} AS r ON @matches(t.path, r.rx) WHERE r.top IS NULL) AS m GROUP BY path"""),
    "drift_entries": ("Every drift entry with its kind, what to do, and its place by the size of the delta.", """
        SELECT category, path, line_no, kind, CASE WHEN kind = 'stale_rule' THEN 'remove_stale_rule' ELSE 'review_codeowners_rule' END AS action, delta, severity,
          row_number() OVER (PARTITION BY category ORDER BY round(abs(delta), 9) DESC, path, line_no) AS place
        FROM (SELECT d.*, CASE WHEN category = 'stale' THEN 'stale_rule' WHEN category = 'missing' THEN 'missing_rule' WHEN overlap = 0e0 THEN 'complete_ownership_replacement' WHEN decay THEN 'stale_declared_owner' ELSE 'owner_mismatch' END AS kind FROM {drift} AS d) AS k"""),
    "drift_digest": ("Entries of each category: how many, how many a bounded list leaves out, the worst severity.", """
        SELECT category, count(*) AS entries, greatest(count(*) - 50, 0) AS left_out, max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS worst FROM {drift} GROUP BY category"""),
    "path_signals": ("Per rule: fewest qualified owners, any decay, and the owners seen on its paths.", """
        SELECT w.line_no, min(s.qualified_owners) AS qualified_owners, max(CASE WHEN s.decaying > 0 THEN 1 ELSE 0 END) = 1 AS decay, count(*) AS paths FROM {winners} AS w JOIN {path_summary} AS s ON w.path = s.path GROUP BY w.line_no"""),
    "rule_observed": ("Best entry of each person on the paths of a rule.", """
        SELECT line_no, owner, score, author FROM (
          SELECT w.line_no, lower(o.author) AS owner, o.score, o.author, row_number() OVER (PARTITION BY w.line_no, lower(o.author) ORDER BY o.score DESC, o.author) AS n FROM {winners} AS w JOIN {owners} AS o ON w.path = o.path) AS r WHERE n = 1"""),
    "rule_teams": ("The teams that rules name, with the known team of that name and whether it has teams below it.", """
        SELECT r.line_no, lower(r.owner) AS team, d.slug, c.parent IS NOT NULL AS nested FROM {rule_owners} AS r LEFT JOIN (SELECT DISTINCT slug FROM {teams}) AS d ON lower(d.slug) = @replace_all(lower(r.owner), '^.*/', '')
        LEFT JOIN (SELECT DISTINCT parent FROM {teams}) AS c ON c.parent = d.slug WHERE @contains(r.owner, '/')"""),
    "rule_people": ("For each team of a rule who counts as declared: its members, and the people whom the rule names beside it.", """
        SELECT t.line_no, t.team, lower(m.login) AS login, 1 AS member FROM {rule_teams} AS t JOIN {team_closure} AS m ON t.slug = m.slug
        UNION ALL SELECT t.line_no, t.team, lower(r.owner), 0 FROM {rule_teams} AS t JOIN {rule_owners} AS r ON t.line_no = r.line_no WHERE NOT @contains(r.owner, '/')"""),
    "team_drift": ("Rules that name a team: aligned, partial-drift (someone outside is seen), nested, empty or invisible; the share of the people seen that are declared, members not seen, people seen from outside.", """
        SELECT t.line_no, t.team, CASE WHEN t.slug IS NULL THEN 'invisible' WHEN t.nested THEN 'nested' WHEN coalesce(a.members, 0) = 0 THEN 'empty' WHEN b.outside <> '' THEN 'partial-drift' ELSE 'aligned' END AS status,
          CASE WHEN t.slug IS NOT NULL THEN round(b.declared * 1.0e0 / b.seen, 4) END AS coverage, CASE WHEN t.slug IS NULL THEN '' ELSE coalesce(a.inactive, '') END AS inactive, CASE WHEN t.slug IS NULL THEN '' ELSE b.outside END AS outside
        FROM {rule_teams} AS t JOIN (
          SELECT t.line_no, t.team, count(DISTINCT o.owner) AS seen, count(DISTINCT d.login) AS declared, @joined(CASE WHEN d.login IS NULL THEN o.owner END) AS outside
          FROM {rule_teams} AS t JOIN {rule_observed} AS o ON t.line_no = o.line_no LEFT JOIN {rule_people} AS d ON d.line_no = o.line_no AND d.team = t.team AND d.login = o.owner GROUP BY t.line_no, t.team) AS b ON t.line_no = b.line_no AND t.team = b.team
        LEFT JOIN (
          SELECT d.line_no, d.team, count(*) AS members, @joined(CASE WHEN o.owner IS NULL THEN d.login END) AS inactive
          FROM {rule_people} AS d LEFT JOIN {rule_observed} AS o ON d.line_no = o.line_no AND d.login = o.owner WHERE d.member = 1 GROUP BY d.line_no, d.team) AS a ON t.line_no = a.line_no AND t.team = a.team"""),
    "manual_review": ("Manual rules that disagree with what is observed, with the generated rule that each hides.", """
        SELECT e.line_no, e.path AS pattern, e.kind, e.delta, h.hidden_line FROM {drift_entries} AS e JOIN {rules} AS r ON e.line_no = r.line_no LEFT JOIN {shadowed_generated} AS h ON e.line_no = h.line_no WHERE r.source = 'manual' AND e.category = 'changed'"""),
    "star_owners": ("Owners of the last catch-all rule.", """
        SELECT o.owner FROM {rule_owners} AS o JOIN (SELECT max(line_no) AS line_no FROM {rules} WHERE pattern IN ('*', '/')) AS s ON o.line_no = s.line_no"""),
    "finding_levels": ("New findings with the check they belong to and the level that the policy gives it.", """
        SELECT f.rule, f.path, f.owners, k.check_name, coalesce(p.level, 'warn') AS level, coalesce(p.level, 'warn') = 'block' AS blocks
        FROM {new_findings} AS f
        JOIN (VALUES ('stale-drift', 'drift'), ('changed-drift', 'drift'), ('missing-drift', 'unowned'), ('single-expert', 'single_expert'), ('shadowed-rule', 'none')) AS k(rule, check_name) ON f.rule = k.rule
        LEFT JOIN {policy} AS p ON k.check_name = p.check_name"""),
    "report_rows": ("Findings of the rule file, the bus factor, gaps and the audit as rows of one report.", """
        SELECT 'invalid-owner' AS rule, 'error' AS level, pattern AS path, line_no, problem AS message FROM {invalid_rules}
        UNION ALL SELECT 'single-expert', 'warning', path, CAST(NULL AS INT), 'one qualified owner' FROM {tiers} WHERE qualified_owners = 1
        UNION ALL SELECT 'evidence-gap', 'note', code, CAST(ord AS INT), 'evidence is missing' FROM {gap_list}
        UNION ALL SELECT item, CASE status WHEN 'fail' THEN 'error' ELSE 'warning' END, '', CAST(NULL AS INT), 'audit' FROM {audit} WHERE status IN ('warn', 'fail')"""),
    "actionable": ("Whether anything needs an action: drift, critical paths, decay.", """
        SELECT d.n AS drift, t.n AS critical, w.n AS decay, d.n + t.n + w.n > 0 AS actionable
        FROM (SELECT count(*) AS n FROM {drift}) AS d CROSS JOIN (SELECT count(*) AS n FROM {tiers} WHERE tier = 'critical') AS t CROSS JOIN (SELECT count(*) AS n FROM {decay_warnings}) AS w"""),
    "decay_digest": ("Decay warnings by status: how many, and the longest silence.", "SELECT status, count(*) AS reports, greatest(count(*) - 50, 0) AS left_out, max(days) AS longest FROM {decay_warnings} GROUP BY status"),
    "balance_digest": ("Reviewers of each load band.", "SELECT band, count(*) AS reviewers, CAST(sum(reviews) AS BIGINT) AS reviews, CAST(sum(waiting) AS BIGINT) AS waiting FROM {review_load} GROUP BY band"),
    # risk
    "risk_labels": ("Change frequency in words, and the strongest reasons of each path's risk.", """
        SELECT f.path, CASE WHEN f.frequency >= 0.85e0 THEN 'very high' WHEN f.frequency >= 0.6e0 THEN 'high' WHEN f.frequency >= 0.3e0 THEN 'medium' WHEN f.frequency >= 0.1e0 THEN 'low' WHEN f.frequency IS NOT NULL THEN 'very low' END AS churn,
          coalesce(max(CASE WHEN r.place = 1 THEN r.label END), 'low criticality') AS first_reason, count(CASE WHEN r.value >= 0.6e0 THEN 1 END) AS strong_reasons
        FROM {risk_factors} AS f LEFT JOIN (
          SELECT path, label, value, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN value >= 0.6e0 THEN 0 ELSE 1 END, value DESC, CASE WHEN value >= 0.6e0 THEN label END, label DESC) AS place FROM (
            """ + " UNION ALL ".join(f"SELECT path, round({value}, 4) AS value, '{label}' AS label FROM {{risk_factors}} WHERE {test}" for test, value, label in _REASONS) + """) AS u) AS r ON f.path = r.path
        GROUP BY f.path, f.frequency"""),
    "worst_risk": ("The riskiest path of the worst tier.", "SELECT path, risk, tier FROM {risk} ORDER BY CASE tier WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, risk DESC, path LIMIT 1"),
    "criticality_known": ("Whether any path has a criticality: configured, a manifest, or coupled.", "SELECT count(criticality) AS critical, count(coupling) AS coupled, count(criticality) + count(coupling) = 0 AS unavailable FROM {risk_factors}"),
    "last_activity": ("Days since the latest touch of each path by one of its owners.", "SELECT path, CAST(min(age) AS BIGINT) AS days FROM {owners} GROUP BY path"),
    # departures
    "affected_paths": ("Paths that lose an owner by a departure: primary owner and owner count before and after.", """
        SELECT r.path, max(CASE WHEN r.rank = 1 THEN r.author END) AS before_owner, max(CASE WHEN r.author <> :removed AND r.left_rank = 1 THEN r.author END) AS after_owner, count(*) AS before_count, count(CASE WHEN r.author <> :removed THEN 1 END) AS after_count
        FROM (SELECT path, author, rank, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN author = :removed THEN 1 ELSE 0 END, rank) AS left_rank FROM {ranked}) AS r
        GROUP BY r.path HAVING count(CASE WHEN r.author = :removed THEN 1 END) > 0"""),
    "left_shares": ("Top share and truck factor of each path before and after a departure; a path without owners has none.", """
        SELECT path, max(CASE WHEN before_total > 0 THEN score / before_total END) AS before_top, max(CASE WHEN author <> :removed AND after_total > 0 THEN score / after_total END) AS after_top
        FROM (SELECT path, author, score, sum(score) OVER (PARTITION BY path) AS before_total, sum(CASE WHEN author <> :removed THEN score ELSE 0e0 END) OVER (PARTITION BY path) AS after_total FROM {ranked} WHERE score > 0) AS s GROUP BY path"""),
    "removal_distribution": ("Distribution of top shares before and after a departure.", """
        SELECT round(avg(before_top), 6) AS before_mean, round(avg(after_top), 6) AS after_mean, round(max(before_top), 6) AS before_most, round(max(after_top), 6) AS after_most,
          count(CASE WHEN round(before_top, 9) >= 0.5e0 THEN 1 END) AS before_concentrated, count(CASE WHEN round(after_top, 9) >= 0.5e0 THEN 1 END) AS after_concentrated, count(before_top) AS before_paths, count(after_top) AS after_paths
        FROM {left_shares}"""),
    "person_best": ("Best path of each person.", """
        SELECT author, path, score, commits FROM (SELECT author, path, score, commits, row_number() OVER (PARTITION BY author ORDER BY score DESC, commits DESC, path) AS n FROM {ranked}) AS b WHERE n = 1"""),
    # layers and attributes
    "tracked_dirs": ("All directories above each tracked path.", "SELECT path, depth, @prefix(path, depth) AS dir FROM (SELECT path, @explode(@series(1, @depth(path))) AS depth FROM {tracked} WHERE @contains(path, '/')) AS d"),
    "nearest_owners": ("For each tracked path the owners that the nearest directory with an owners file names.", """
        SELECT n.path, n.dir, o.owner FROM (
          SELECT path, dir, row_number() OVER (PARTITION BY path ORDER BY depth DESC) AS n FROM (
            SELECT d.path, d.dir, d.depth FROM {tracked_dirs} AS d JOIN (SELECT DISTINCT dir FROM {owners_files} WHERE dir <> '') AS f ON d.dir = f.dir
            UNION ALL SELECT t.path, '', 0 FROM {tracked} AS t JOIN (SELECT DISTINCT dir FROM {owners_files} WHERE dir = '') AS f ON true) AS c) AS n
        JOIN {owners_files} AS o ON n.dir = o.dir WHERE n.n = 1"""),
    "nested_owners": ("For each tracked path the last matching rule of the deepest nested rule file above it.", """
        SELECT path, dir, line, owner FROM (
          SELECT t.path, r.dir, r.line, r.owner, row_number() OVER (PARTITION BY t.path ORDER BY length(r.dir) DESC, r.line DESC) AS n
          FROM {tracked_dirs} AS t JOIN {nested_rules} AS r ON t.dir = r.dir AND (@matches(substr(t.path, length(r.dir) + 2), r.rx) OR @matches(t.path, r.rx))) AS m WHERE n = 1"""),
    "layer_rows": ("Per top directory: owners named by the nearest files, by the global rules, and observed.", """
        SELECT d.top, coalesce(l.owners, '') AS declared_local, coalesce(g.owners, '') AS declared_global, coalesce(o.owners, '') AS observed FROM (SELECT DISTINCT split_part(path, '/', 1) AS top FROM {tracked}) AS d
        LEFT JOIN (SELECT split_part(path, '/', 1) AS top, @joined(owner) AS owners FROM {nearest_owners} GROUP BY 1) AS l ON d.top = l.top
        LEFT JOIN (SELECT split_part(path, '/', 1) AS top, @joined(owner) AS owners FROM {declared} GROUP BY 1) AS g ON d.top = g.top
        LEFT JOIN (SELECT split_part(path, '/', 1) AS top, @joined(author) AS owners FROM {owners} GROUP BY 1) AS o ON d.top = o.top"""),
    "attribute_values": ("Value of each attribute on each tracked path that a rule names: deeper directories and later lines win.", """
        SELECT path, attr, value FROM (
          SELECT t.path, a.attr, a.value, row_number() OVER (PARTITION BY t.path, a.attr ORDER BY length(a.dir) DESC, a.line DESC) AS n
          FROM (SELECT path, dir FROM {tracked_dirs} UNION ALL SELECT path, '' FROM {tracked}) AS t JOIN {attr_rules} AS a ON t.dir = a.dir AND @matches(CASE WHEN a.dir = '' THEN t.path ELSE substr(t.path, length(a.dir) + 2) END, a.rx)) AS m WHERE n = 1"""),
    "linguist_excluded": ("Tracked paths that their attributes mark as generated or vendored.", "SELECT DISTINCT path FROM {attribute_values} WHERE attr IN ('linguist-generated', 'linguist-vendored') AND value"),
    # dependencies
    "dependencies": ("Import edges between tracked files, each once, none to itself.", """
        SELECT DISTINCT e.dependent, e.dependency FROM {import_edges} AS e JOIN {tracked} AS a ON e.dependent = a.path JOIN {tracked} AS b ON e.dependency = b.path WHERE e.dependent <> e.dependency"""),
    "orphan_dependents": ("Files that depend on files without a fresh owner.", "SELECT v.path, count(*) AS dependents FROM {vacuum} AS v JOIN {dependencies} AS d ON v.path = d.dependency GROUP BY v.path"),
    "prerequisites": ("For each file of the target the files of the target that it imports.", "SELECT dependent AS path, dependency AS prerequisite FROM {dependencies} WHERE dependent LIKE :target || '/%' AND dependency LIKE :target || '/%'"),
    "onboarding_complexity": ("easy, medium or hard for each step of onboarding, by its third and the number of qualified owners.", """
        SELECT o.path, o.step, CASE WHEN o.step <= t.third THEN CASE WHEN o.qualified_owners <= 1 THEN 'medium' ELSE 'easy' END WHEN o.step <= 2 * t.third THEN CASE WHEN o.qualified_owners <= 1 THEN 'hard' ELSE 'medium' END ELSE 'hard' END AS complexity
        FROM {onboarding} AS o CROSS JOIN (SELECT greatest(1, CAST(floor(count(*) / 3e0) AS BIGINT)) AS third FROM {onboarding}) AS t"""),
    "knowledge_edges": ("The knowledge graph with rules and imports: person, path, rule, owner and team nodes, relations of one pair joined.", """
        SELECT src, dst, @joined(relation) AS relations FROM (
          SELECT 'person:' || src AS src, 'path:' || dst AS dst, relations AS relation FROM {graph_edges} WHERE @matches(relations, 'authored|observed|reviews|decaying')
          UNION ALL SELECT 'rule:' || @str(line_no), 'path:' || path, 'governs' FROM {winners} WHERE owners <> ''
          UNION ALL SELECT 'owner:' || owner, 'rule:' || @str(line_no), 'declared' FROM {rule_owners}
          UNION ALL SELECT 'path:' || dependent, 'path:' || dependency, 'imports' FROM {dependencies}
          UNION ALL SELECT 'team:' || slug, 'person:' || login, 'member' FROM {team_members}) AS e GROUP BY src, dst"""),
    # people
    "identity_matches": ("Authors that a query names: equal names, or one equal to the other's local part.", """
        SELECT q.query, a.author FROM {queries} AS q JOIN {author_index} AS a ON lower(@replace_all(q.query, '^@+', '')) = lower(@replace_all(a.author, '^@+', '')) OR split_part(lower(@replace_all(q.query, '^@+', '')), '@', 1) = lower(@replace_all(a.author, '^@+', '')) OR split_part(lower(@replace_all(a.author, '^@+', '')), '@', 1) = lower(@replace_all(q.query, '^@+', ''))"""),
    "resolved": ("Handle and source of each identity: an override, else a hit, else a noreply address, else none; and how far its evidence counts.", """
        SELECT identity, handle, source, CASE WHEN source = 'search' THEN 0.5e0 WHEN source = 'none' AND @contains(email, '@') THEN 0.75e0 ELSE 1e0 END AS factor FROM (
          SELECT i.identity, i.email, CASE WHEN o.handle IS NOT NULL THEN o.handle WHEN h.handle IS NOT NULL THEN h.handle WHEN substr(n.handle, 1, 6) <> 'email:' THEN n.handle END AS handle,
            CASE WHEN o.handle IS NOT NULL THEN 'override' WHEN h.handle IS NOT NULL THEN h.source WHEN substr(n.handle, 1, 6) <> 'email:' THEN 'noreply' ELSE 'none' END AS source
          FROM {identities} AS i LEFT JOIN {overrides} AS o ON lower(i.identity) = lower(o.identity) LEFT JOIN {hits} AS h ON lower(i.identity) = lower(h.identity) LEFT JOIN (SELECT DISTINCT email, handle FROM {handles}) AS n ON i.email = n.email) AS r"""),
    "cached_handles": ("What the handle cache says of each identity: a handle, a miss that still counts, or nothing any more.", """
        SELECT identity, handle, CASE WHEN handle IS NOT NULL THEN 'hit' WHEN @days(TIMESTAMP :as_of, seen) <= :miss_days THEN 'miss' ELSE 'expired' END AS state FROM {handle_cache}"""),
    "unresolved": ("Identities that are an address without a handle.", "SELECT r.identity, i.email FROM {resolved} AS r JOIN {identities} AS i ON r.identity = i.identity WHERE r.source = 'none' AND @contains(i.email, '@')"),
    "merges": ("Certain merges: handles to which several identities resolve, but for pairs that are kept apart.", """
        SELECT g.handle, g.first_identity, m.identity, m.source FROM (SELECT handle, min(identity) AS first_identity FROM {resolved} WHERE handle IS NOT NULL AND factor = 1e0 GROUP BY handle HAVING count(*) > 1) AS g
        JOIN {resolved} AS m ON g.handle = m.handle AND m.identity <> g.first_identity AND m.factor = 1e0
        WHERE NOT EXISTS (SELECT 1 FROM {separations} AS s WHERE lower(s.a) IN (lower(g.first_identity), lower(m.identity)) AND lower(s.b) IN (lower(g.first_identity), lower(m.identity)))"""),
    "audit_identities": ("Identities and overrides side by side.", """
        SELECT coalesce(i.identity, o.identity) AS identity, i.email, o.handle AS override_handle, CASE WHEN i.identity IS NULL THEN 'override only' WHEN o.identity IS NULL THEN 'seen only' ELSE 'both' END AS state
        FROM {identities} AS i FULL OUTER JOIN {overrides} AS o ON lower(i.identity) = lower(o.identity)"""),
    "outsider_blame": ("Largest line share over the target of people who do not own any of its files.", """
        SELECT b.author, max(b.share) AS share FROM {blame_share} AS b WHERE b.path LIKE :target || '/%' AND NOT EXISTS (SELECT 1 FROM {owners} AS o WHERE o.author = b.author AND o.path LIKE :target || '/%') GROUP BY b.author"""),
    "threshold_knobs": ("What would change who is named in the target: scores just below the threshold, owners beyond the top, a missing signal.", """
        SELECT count(CASE WHEN s.score < :threshold THEN 1 END) AS below_threshold, max(CASE WHEN s.score < :threshold THEN s.score END) AS best_below, count(CASE WHEN s.score >= :threshold AND o.author IS NULL THEN 1 END) AS beyond_top, count(CASE WHEN s.review IS NULL THEN 1 END) AS without_review
        FROM {scored} AS s LEFT JOIN {owners} AS o ON s.path = o.path AND s.author = o.author WHERE s.path LIKE :target || '/%'"""),
    "review_criticality": ("Largest configured weight over the paths that a reviewer owns.", """
        SELECT o.author, max(c.weight) AS criticality FROM {owners} AS o JOIN {criticality} AS c ON @matches(o.path, c.rx) GROUP BY o.author"""),
    "team_resolution": ("Owners of the target who belong to a team that its rules name; the first team counts.", """
        SELECT author, min(owner) AS team FROM (
          SELECT o.author, x.owner FROM {owners} AS o JOIN {declared} AS x ON o.path = x.path AND @contains(x.owner, '/') JOIN {team_closure} AS m ON lower(m.slug) = @replace_all(x.owner, '^.*/', '') AND lower(m.login) = lower(o.author)) AS t GROUP BY author"""),
    # incremental runs
    "dirty_paths": ("Tracked paths whose lines must be read again, and those that can be reused.", """
        SELECT b.path, CASE WHEN p.path IS NULL THEN 'new' WHEN p.blob <> b.blob THEN 'changed' ELSE 'reused' END AS state FROM {blobs} AS b LEFT JOIN {blobs_before} AS p ON b.path = p.path"""),
    "reused_share": ("How much of the line attribution a run can reuse.", "SELECT count(*) AS paths, count(CASE WHEN state = 'reused' THEN 1 END) AS reused, round(count(CASE WHEN state = 'reused' THEN 1 END) * 1.0e0 / greatest(count(*), 1), 6) AS share FROM {dirty_paths}"),
    "mixed_blame": ("Line shares with reused paths from the run before and others read again.", """
        SELECT b.path, b.author, b.share, d.state FROM {blame_share} AS b JOIN {dirty_paths} AS d ON b.path = d.path WHERE d.state <> 'reused'
        UNION ALL SELECT b.path, b.author, b.n_lines / sum(b.n_lines) OVER (PARTITION BY b.path), d.state FROM (SELECT path, author, sum(n_lines) AS n_lines FROM {blame_before} GROUP BY path, author) AS b JOIN {dirty_paths} AS d ON b.path = d.path WHERE d.state = 'reused'"""),
    "review_window": ("Completed reviews inside the lookback window: those closed in it, or opened in it where they are not closed.", """
        SELECT reviewer, count(*) AS pulls FROM {pulls} WHERE coalesce(closed, opened) <= TIMESTAMP :as_of AND coalesce(closed, opened) >= TIMESTAMP :as_of - INTERVAL :lookback_days DAYS GROUP BY reviewer"""),
}
