"""Ownership rules against paths, declared against observed owners, findings.

Facts besides the others: rules(line_no, pattern, rx, top, supported, owners, source), baseline(rule, path),
suppressions(rule, path, rx, expires), criticality(ord, rx, rule_rx, weight)
with ``rule_rx`` in the language of rules.  ``owners`` is a comma-joined list.  The match is joined on the rule's literal
first directory where it has one, so that only floating rules meet all paths.
"""

SQL = {
    "rule_matches": ("Every rule that matches a tracked path.", """
        SELECT t.path, r.line_no FROM {tracked} AS t JOIN {rules} AS r ON split_part(t.path, '/', 1) = r.top AND @matches(t.path, r.rx) WHERE r.supported
        UNION ALL SELECT t.path, r.line_no FROM {tracked} AS t JOIN {rules} AS r ON @matches(t.path, r.rx) WHERE r.supported AND r.top IS NULL"""),
    "winners": ("The last matching rule of each path.", """
        SELECT m.path, r.line_no, r.pattern, r.owners, r.source FROM (SELECT path, max(line_no) AS line_no FROM {rule_matches} GROUP BY path) AS m JOIN {rules} AS r ON m.line_no = r.line_no"""),
    "rule_owners": ("Owners of each rule as rows.", """
        SELECT line_no, owner FROM (SELECT line_no, @explode(@parts(owners, ',')) AS owner FROM {rules}) AS o WHERE owner <> ''"""),
    "coverage": ("Share of tracked paths that a rule covers, and that a rule assigns.", """
        SELECT count(*) AS paths, count(w.path) AS covered, count(CASE WHEN w.owners <> '' THEN 1 END) AS assigned, round(count(w.path) * 1.0e0 / count(*), 6) AS share FROM {tracked} AS t LEFT JOIN {winners} AS w ON t.path = w.path"""),
    "dead_rules": ("Rules that match no tracked path.", """
        SELECT line_no, pattern FROM {rules} AS r WHERE NOT EXISTS (SELECT 1 FROM {rule_matches} AS m WHERE m.line_no = r.line_no)"""),
    "broad_rules": ("Rules that match half of the tracked paths or more.", """
        SELECT m.line_no, count(*) AS paths FROM {rule_matches} AS m GROUP BY m.line_no HAVING count(*) * 2 >= (SELECT count(*) FROM {tracked})"""),
    "duplicate_rules": ("Second and later rules of one pattern.", """
        SELECT line_no, pattern FROM (SELECT line_no, pattern, row_number() OVER (PARTITION BY pattern ORDER BY line_no) AS n FROM {rules}) AS d WHERE n > 1"""),
    "shadowed_rules": ("Rules that lose a path to a later rule, with the first such path.", """
        SELECT m.line_no, min(m.path) AS path, count(*) AS paths, min(w.line_no) AS by_line FROM {rule_matches} AS m JOIN {winners} AS w ON m.path = w.path AND m.line_no < w.line_no GROUP BY m.line_no"""),
    "drift_missing": ("Observed paths that no rule covers.", """
        SELECT 'missing' AS category, s.path, s.top_score AS delta, CAST(NULL AS INT) AS line_no, s.qualified_owners, s.decaying > 0 AS decay, 0e0 AS overlap
        FROM {path_summary} AS s LEFT JOIN {winners} AS w ON s.path = w.path WHERE w.path IS NULL"""),
    "drift_stale": ("Rules without any path.", """
        SELECT 'stale' AS category, pattern AS path, 1e0 AS delta, line_no, CAST(NULL AS BIGINT) AS qualified_owners, false AS decay, CASE WHEN owners = '' THEN 1e0 ELSE 0e0 END AS overlap FROM (SELECT r.* FROM {rules} AS r JOIN {dead_rules} AS d ON r.line_no = d.line_no) AS s"""),
    "declared": ("Declared owners of each observed path.", """
        SELECT w.path, w.line_no, lower(o.owner) AS owner FROM {winners} AS w JOIN {rule_owners} AS o ON w.line_no = o.line_no WHERE EXISTS (SELECT 1 FROM {owners} AS x WHERE x.path = w.path)"""),
    "divergence": ("Per observed and assigned path: how far declared and observed owners are apart.", """
        SELECT path, max(line_no) AS line_no, least(1e0, sum(CASE WHEN declared = 0 THEN score WHEN observed = 0 THEN 1e0 ELSE 0e0 END)) AS delta,
          round(sum(declared * observed) * 1.0e0 / count(*), 4) AS overlap, sum(CASE WHEN declared <> observed THEN 1 ELSE 0 END) AS differing
        FROM (
          SELECT path, owner, max(line_no) AS line_no, max(declared) AS declared, max(observed) AS observed, max(score) AS score FROM (
            SELECT path, owner, line_no, 1 AS declared, 0 AS observed, 0e0 AS score FROM {declared}
            UNION ALL SELECT o.path, lower(o.author), NULL, 0, 1, o.score FROM {owners} AS o WHERE EXISTS (SELECT 1 FROM {declared} AS d WHERE d.path = o.path)) AS u
          GROUP BY path, owner) AS g
        GROUP BY path"""),
    "drift_changed": ("Rules whose owners diverge from those observed: the first file with the greatest delta tells how.", """
        SELECT 'changed' AS category, r.pattern AS path, d.delta, d.line_no, d.qualified_owners, d.decay, d.overlap FROM (
          SELECT v.line_no, v.delta, v.overlap, s.qualified_owners, s.decaying > 0 AS decay, row_number() OVER (PARTITION BY v.line_no ORDER BY v.delta DESC, v.path) AS n
          FROM {divergence} AS v JOIN {path_summary} AS s ON v.path = s.path WHERE v.differing > 0) AS d
        JOIN {rules} AS r ON d.line_no = r.line_no WHERE d.n = 1 AND d.delta >= :drift_min_delta"""),
    "drift": ("All drift with its score and severity.", """
        SELECT category, path, delta, line_no, qualified_owners, decay, overlap, weight, score,
          CASE WHEN score < 0.15e0 THEN 'info' WHEN score < 0.35e0 THEN 'low' WHEN score < 0.55e0 THEN 'medium' WHEN score < 0.75e0 THEN 'high' ELSE 'critical' END AS severity FROM (
          SELECT u.*, 0.40e0 * (1e0 - overlap) + 0.25e0 * least(1e0, abs(delta)) + 0.15e0 * weight + CASE WHEN decay THEN 0.15e0 ELSE 0e0 END + CASE WHEN qualified_owners = 1 THEN 0.05e0 ELSE 0e0 END AS score FROM (
            SELECT d.*, least(1e0, coalesce(w.weight, 0e0)) AS weight FROM (SELECT * FROM {drift_missing} UNION ALL SELECT * FROM {drift_stale} UNION ALL SELECT * FROM {drift_changed}) AS d
            LEFT JOIN (
              SELECT e.path, max(c.weight) AS weight FROM (SELECT path FROM {drift_missing} UNION SELECT path FROM {drift_stale} UNION SELECT path FROM {drift_changed}) AS e JOIN {criticality} AS c ON @matches(e.path, c.rule_rx) GROUP BY e.path) AS w
            ON d.path = w.path) AS u) AS s"""),
    "drift_severity": ("The worst severity of all drift.", """
        SELECT CASE coalesce(max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END), 0) WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity,
          count(*) AS entries, count(CASE WHEN delta >= 0.7e0 OR qualified_owners <= :critical_owners OR decay THEN 1 END) AS high_entries FROM {drift}"""),
    "findings": ("Findings with their identity: rule, path and sorted owners (none for single experts), and a digest of it.", """
        SELECT rule, path, owners, @sha(rule || '|' || path || '|' || owners) AS fingerprint FROM (
          SELECT d.category || '-drift' AS rule, d.path, coalesce(@sorted_list(lower(r.owners)), '') AS owners FROM {drift} AS d LEFT JOIN {rules} AS r ON d.line_no = r.line_no
          UNION ALL SELECT 'single-expert', path, '' FROM {tiers} WHERE tier = 'critical'
          UNION ALL SELECT 'shadowed-rule', pattern, @sorted_list(lower(owners)) FROM {rules} AS r JOIN {shadowed_rules} AS s ON r.line_no = s.line_no) AS f
        GROUP BY rule, path, owners"""),
    "suppressed": ("Findings that an unexpired suppression covers, by path or pattern.", """
        SELECT DISTINCT f.rule, f.path FROM {findings} AS f JOIN {suppressions} AS s ON f.rule = s.rule AND (f.path = s.path OR @matches(f.path, s.rx)) WHERE s.expires IS NULL OR s.expires >= CAST(TIMESTAMP :as_of AS DATE)"""),
    "new_findings": ("Findings neither suppressed nor accepted before; one whose owners have changed since is new.", """
        SELECT f.* FROM {findings} AS f WHERE NOT EXISTS (SELECT 1 FROM {suppressed} AS s WHERE s.rule = f.rule AND s.path = f.path) AND NOT EXISTS (SELECT 1 FROM {baseline} AS b WHERE b.rule = f.rule AND b.path = f.path AND b.owners = f.owners)"""),
    "settled_findings": ("Accepted findings that no longer occur.", """
        SELECT b.rule, b.path, b.owners FROM {baseline} AS b WHERE NOT EXISTS (SELECT 1 FROM {findings} AS f WHERE f.rule = b.rule AND f.path = b.path AND f.owners = b.owners)"""),
    "consolidated": ("For each path the shortest directory all of whose files have one owner set (two files at least), else the path; the root only where it spans several entries.", """
        SELECT pattern, owners, count(*) AS files FROM (
          SELECT p.path, p.owners, CASE WHEN u.depth IS NULL THEN '/' || p.path WHEN u.depth = 0 THEN '*' ELSE '/' || @prefix(p.path, u.depth) || '/' END AS pattern
          FROM {owner_sets} AS p LEFT JOIN (
            SELECT a.path, min(a.depth) AS depth FROM {set_dirs} AS a JOIN {uniform_dirs} AS d ON a.dir = d.dir GROUP BY a.path) AS u ON p.path = u.path) AS c
        GROUP BY pattern, owners"""),
    "set_dirs": ("All directories above each owned path, the root among them.", """
        SELECT path, owners, depth, CASE WHEN depth = 0 THEN '' ELSE @prefix(path, depth) END AS dir FROM (SELECT path, owners, @explode(@series(0, @depth(path))) AS depth FROM {owner_sets}) AS d"""),
    "owner_sets": ("The owners of each path as one sorted list.", "SELECT path, @joined(author) AS owners FROM {owners} GROUP BY path"),
    "uniform_dirs": ("Directories of two files or more with one owner set.", """
        SELECT dir FROM {set_dirs} GROUP BY dir HAVING count(*) >= 2 AND count(DISTINCT owners) = 1 AND (dir <> '' OR min(split_part(path, '/', 1)) <> max(split_part(path, '/', 1)))"""),
    "audit": ("One row for each check of the rules, of the platform and of inference: ok, warn, fail or unverifiable.", """
        SELECT 'branch' AS item, 'unverifiable' AS status, 0 AS n FROM {repository}
        UNION ALL SELECT 'file-size', CASE WHEN file_bytes > :file_limit THEN 'fail' ELSE 'ok' END, file_bytes FROM {repository}
        UNION ALL SELECT 'invalid-owner', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'fail' END, count(*) FROM {invalid_rules}
        UNION ALL SELECT 'owner-access', 'unverifiable', 0 FROM {repository}
        UNION ALL SELECT 'invisible-team', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {declared_teams} WHERE NOT known
        UNION ALL SELECT 'empty-team', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {declared_teams} WHERE known AND members = 0
        UNION ALL SELECT 'shadowed-rule', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {shadowed_rules}
        UNION ALL SELECT 'unowned-file', CASE WHEN paths = 0 THEN 'unverifiable' WHEN covered = paths THEN 'ok' ELSE 'warn' END, paths - covered FROM {coverage}
        UNION ALL SELECT 'dead-rule', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {dead_rules}
        UNION ALL SELECT 'bus-factor', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {tiers} WHERE tier = 'critical'
        UNION ALL SELECT 'duplicate-rule', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {duplicate_rules}
        UNION ALL SELECT 'broad-rule', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {broad_rules}
        UNION ALL SELECT 'self-protection', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {rules} WHERE supported AND @matches(:rule_file, rx)
        UNION ALL SELECT 'ruleset', CASE review WHEN 'required' THEN 'ok' WHEN 'unknown' THEN 'unverifiable' ELSE 'warn' END, 0 FROM {repository}
        UNION ALL SELECT 'drift', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {drift}
        UNION ALL SELECT 'single-expert', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {concentration} WHERE round(top_share, 4) >= 0.5e0
        UNION ALL SELECT 'decay', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {stale_declared}
        UNION ALL SELECT 'orphaned-owner', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM {owners} AS o JOIN {contributor_status} AS s ON o.author = s.author WHERE o.rank = 1 AND s.status = 'former'
        UNION ALL SELECT 'observed-unowned', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM (SELECT DISTINCT path FROM {scored}) AS c WHERE NOT EXISTS (SELECT 1 FROM {owners} AS o WHERE o.path = c.path)"""),
    "declared_teams": ("Teams that rules name, whether they are known, and how many members they and the teams below them have.", """
        SELECT t.owner, max(CASE WHEN k.slug IS NULL THEN 0 ELSE 1 END) = 1 AS known, count(DISTINCT m.login) AS members
        FROM (SELECT DISTINCT lower(owner) AS owner FROM {rule_owners} WHERE @contains(owner, '/')) AS t
        LEFT JOIN {teams} AS k ON lower(k.slug) = @replace_all(t.owner, '^.*/', '') LEFT JOIN {team_closure} AS m ON m.slug = k.slug GROUP BY t.owner"""),
}
