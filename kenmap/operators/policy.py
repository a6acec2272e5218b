"""Policy, explanation, layers, identity merges, privacy, completeness.

Facts besides the others: security(rx), roster(identity, handle, certain), moves(sha, similarity, old_path, path),
modifications(sha, path): files that a commit modifies, flags(code): evidence that a run could not collect.
"""

SQL = {
    "mass_commits": ("Commits that modify at least the given fraction of all tracked paths.", """
        SELECT m.sha, m.modified FROM (SELECT sha, count(*) AS modified FROM {modifications} GROUP BY sha) AS m CROSS JOIN (SELECT count(*) AS n FROM {tracked}) AS t
        WHERE t.n > 0 AND m.modified >= :mass_refactor * t.n"""),
    "rename_commits": ("Commits that contain a rename, and the least similarity.", "SELECT sha, count(*) AS renames, min(similarity) AS similarity FROM {moves} GROUP BY sha"),
    "lineage_confidence": ("Evidence quality scaled by the similarity of a path's renames; the score is not.", """
        SELECT o.path, o.author, o.score, o.quality * coalesce(m.similarity, 100) / 100e0 AS quality FROM {owners} AS o LEFT JOIN (SELECT path, min(similarity) AS similarity FROM {moves} GROUP BY path) AS m ON o.path = m.path"""),
    "security_findings": ("Security paths with too few effective owners, no declared owner, or no active expert.", """
        SELECT s.path, CASE WHEN c.effective_owners < 2e0 THEN 1 ELSE 0 END + CASE WHEN w.owners IS NULL OR w.owners = '' THEN 2 ELSE 0 END + CASE WHEN s.decaying = s.qualified_owners THEN 4 ELSE 0 END AS problems
        FROM {path_summary} AS s JOIN {concentration} AS c ON s.path = c.path LEFT JOIN {winners} AS w ON s.path = w.path
        WHERE EXISTS (SELECT 1 FROM {security} AS x WHERE @matches(s.path, x.rx)) AND (c.effective_owners < 2e0 OR w.owners IS NULL OR w.owners = '' OR s.decaying = s.qualified_owners)"""),
    "invalid_rules": ("Rules that this engine or the dialect does not support.", "SELECT line_no, pattern, CASE WHEN substr(pattern, 1, 1) = '!' THEN 'negation' ELSE 'brackets' END AS problem FROM {rules} WHERE NOT supported"),
    "blocking_findings": ("New findings that a policy lets block: critical drift, and single experts on security paths.", """
        SELECT f.rule, f.path FROM {new_findings} AS f JOIN (SELECT DISTINCT t.path FROM {tracked} AS t JOIN {security} AS x ON @matches(t.path, x.rx)) AS s ON f.path = s.path WHERE f.rule = 'single-expert'
        UNION SELECT f.rule, f.path FROM {new_findings} AS f JOIN (SELECT path FROM {drift} WHERE severity IN ('high', 'critical')) AS d ON f.path = d.path WHERE f.rule LIKE '%-drift'"""),
    "expired_suppressions": ("Suppressions past their day.", "SELECT rule, path FROM {suppressions} WHERE expires < CAST(TIMESTAMP :as_of AS DATE)"),
    "shadowed_generated": ("For each manual winner the latest generated rule that it hides.", """
        SELECT w.line_no, max(m.line_no) AS hidden_line, count(DISTINCT w.path) AS paths FROM {winners} AS w JOIN {rule_matches} AS m ON w.path = m.path AND m.line_no < w.line_no JOIN {rules} AS r ON m.line_no = r.line_no
        WHERE w.source = 'manual' AND r.source = 'generated' GROUP BY w.line_no"""),
    "match_chain": ("All rules that match the paths of the target, in order.", "SELECT m.path, m.line_no, row_number() OVER (PARTITION BY m.path ORDER BY m.line_no) AS step FROM {rule_matches} AS m WHERE m.path LIKE :target || '/%'"),
    "explanation": ("Owners of the target with each signal, best row of each person.", """
        SELECT author, score, recency, frequency, blame, review, survival, status, paths FROM (
          SELECT *, count(*) OVER (PARTITION BY author) AS paths, row_number() OVER (PARTITION BY author ORDER BY score DESC, commits, path) AS n FROM {scored} WHERE path LIKE :target || '/%') AS e WHERE n = 1"""),
    "why_not": ("Why people who touched the target do not own its paths.", """
        SELECT s.author, count(*) AS paths, count(CASE WHEN s.score < :threshold THEN 1 END) AS below_threshold, count(CASE WHEN s.score >= :threshold AND o.author IS NULL THEN 1 END) AS beyond_top, max(s.score) AS best
        FROM {scored} AS s LEFT JOIN {owners} AS o ON s.path = o.path AND s.author = o.author WHERE s.path LIKE :target || '/%' AND o.author IS NULL GROUP BY s.author"""),
    "explanations": ("Each scored path in one row: owners and candidates below the threshold, the evidence behind the owners, who is declared and by which rule, and the verdict.", """
        SELECT s.path, s.owners, s.candidates, s.quality, s.commits, coalesce(d.declared, '') AS declared, w.line_no AS rule_line, coalesce(a.verdict, 'unverifiable') AS assessment
        FROM (
          SELECT path, @joined(CASE WHEN score >= :threshold AND place <= :top_n THEN author END) AS owners, @joined(CASE WHEN score < :threshold THEN author END) AS candidates,
            round(max(CASE WHEN score >= :threshold AND place <= :top_n THEN quality END), 4) AS quality, CAST(sum(commits) AS BIGINT) AS commits
          FROM (SELECT path, author, score, quality, commits, row_number() OVER (PARTITION BY path ORDER BY score DESC, author) AS place FROM {scored}) AS p GROUP BY path) AS s
        LEFT JOIN (SELECT path, @joined(owner) AS declared FROM {declared} GROUP BY path) AS d ON s.path = d.path
        LEFT JOIN {winners} AS w ON s.path = w.path LEFT JOIN {assessment} AS a ON s.path = a.path"""),
    "outside_window": ("People whose last touch of the target lies before the window.", """
        SELECT e.author, max(e.ts) AS last_commit FROM {events_all} AS e WHERE e.path LIKE :target || '/%' AND NOT EXISTS (SELECT 1 FROM {events} AS w WHERE w.author = e.author AND w.path LIKE :target || '/%') GROUP BY e.author"""),
    "assessment": ("aligned where declared and observed owners, or members of a declared team, have one person in common; else diverged; unverifiable where nobody is declared.", """
        SELECT s.path, CASE WHEN d.path IS NULL THEN 'unverifiable' WHEN c.path IS NOT NULL THEN 'aligned' ELSE 'diverged' END AS verdict
        FROM {path_summary} AS s LEFT JOIN (SELECT DISTINCT path FROM {declared}) AS d ON s.path = d.path
        LEFT JOIN (
          SELECT DISTINCT o.path FROM {owners} AS o JOIN (
            SELECT path, owner FROM {declared} UNION SELECT x.path, lower(m.login) FROM {declared} AS x JOIN {team_closure} AS m ON @contains(x.owner, '/') AND lower(m.slug) = @replace_all(x.owner, '^.*/', '')) AS w
          ON o.path = w.path AND lower(o.author) = w.owner) AS c ON s.path = c.path"""),
    "layers": ("Declared and observed owners of each top directory.", """
        SELECT o.top, o.observed, coalesce(d.declared, '') AS declared FROM (SELECT split_part(path, '/', 1) AS top, @joined(author) AS observed FROM {owners} WHERE rank = 1 GROUP BY 1) AS o
        LEFT JOIN (SELECT split_part(path, '/', 1) AS top, @joined(owner) AS declared FROM {declared} GROUP BY 1) AS d ON o.top = d.top"""),
    "merged_owners": ("Owners under their resolved handles: certain addresses merge, others keep their name.", """
        SELECT path, handle, max(score) AS score, CAST(sum(commits) AS BIGINT) AS commits, max(last_commit) AS last_commit, min(quality) AS quality, count(*) AS merged FROM (
          SELECT r.path, CASE WHEN i.certain THEN i.handle ELSE r.author END AS handle, r.score, r.commits, r.last_commit, r.quality FROM {ranked} AS r LEFT JOIN {roster} AS i ON lower(r.author) = lower(i.identity)) AS m
        GROUP BY path, handle"""),
    "without_person": ("Owners recounted without an excluded contributor.", "SELECT path, count(*) AS owners, max(score) AS top_score FROM {ranked} WHERE lower(author) <> lower(:removed) GROUP BY path"),
    "private_owners": ("Owners under pseudonyms.", "SELECT path, 'person-' || substr(@sha(:repo_id || chr(10) || lower(author)), 1, 12) AS person, score FROM {owners}"),
    "redacted_subjects": ("Subjects with addresses and numbers hidden.", "SELECT sha, @replace_all(@replace_all(subject, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+', '[address]'), '#[0-9]+', '#') AS subject FROM {commits}"),
    "completeness": ("Share of the thirteen kinds of evidence without a gap.", "SELECT round((13 - count(*)) / 13e0, 4) AS completeness, count(*) AS gaps FROM {gap_list}"),
    "gap_list": ("Gaps of the evidence, each kind once, in the order of the catalog.", """
        SELECT k.ord, k.code FROM (VALUES (1, 'shallow_history'), (2, 'insufficient_history'), (3, 'absent_token'), (4, 'review_history'), (5, 'api_rate_limit'), (6, 'api_budget'), (7, 'runtime_budget'),
          (8, 'team_membership'), (9, 'ambiguous_identity'), (10, 'excluded_files'), (11, 'unresolved_renames'), (12, 'missing_mailmap'), (13, 'missing_ignore_revs')) AS k(ord, code)
        JOIN (SELECT DISTINCT code FROM (
          SELECT code FROM {flags}
          UNION ALL SELECT 'insufficient_history' FROM (SELECT count(*) AS n FROM {events}) AS e WHERE n = 0
          UNION ALL SELECT 'review_history' FROM (SELECT count(*) AS n FROM {review_counts}) AS r WHERE n = 0
          UNION ALL SELECT 'team_membership' FROM (SELECT count(*) AS n FROM {team_members}) AS t WHERE n = 0
          UNION ALL SELECT 'ambiguous_identity' FROM (SELECT count(*) AS n FROM {duplicate_identities}) AS i WHERE n > 0
          UNION ALL SELECT 'excluded_files' FROM (SELECT count(*) AS n FROM {excluded_paths}) AS x WHERE n > 0
          UNION ALL SELECT 'unresolved_renames' FROM (SELECT count(*) AS n FROM {moves}) AS m WHERE n > 0) AS g) AS d ON k.code = d.code"""),
    "reviewer_suggestions": ("Reviewers of the target's paths: score, paths covered, latest change, own load.", """
        SELECT o.author, max(o.score) AS score, count(*) AS covered, max(o.last_commit) AS last_commit, max(CASE WHEN l.band = 'high' THEN 1 ELSE 0 END) AS overloaded
        FROM {owners} AS o LEFT JOIN {review_load} AS l ON o.author = l.reviewer WHERE o.path LIKE :target || '/%' GROUP BY o.author"""),
    "waiting_reviews": ("Open requests of each reviewer.", "SELECT reviewer, count(*) AS waiting FROM {pulls} WHERE closed IS NULL GROUP BY reviewer"),
    "first_response": ("Hours from request to the first review of a pull.", "SELECT number, min(24e0 * @days(closed, opened)) AS hours FROM {pulls} WHERE closed IS NOT NULL GROUP BY number"),
    "stale_declared": ("Declared owners whose knowledge of the path has decayed.", "SELECT d.path, d.owner, w.status FROM {declared} AS d JOIN {decay_warnings} AS w ON d.path = w.path AND d.owner = lower(w.author)"),
    "solo_repository": ("Whether one person at most qualifies anywhere.", "SELECT count(DISTINCT author) AS people, count(DISTINCT author) <= 1 AS solo FROM {owners}"),
    "single_owner_paths": ("Paths with one owner, those without a backup first.", """
        SELECT t.path, CASE WHEN b.path IS NULL THEN 0 ELSE 1 END AS has_backup FROM {tiers} AS t LEFT JOIN (SELECT DISTINCT path FROM {backups}) AS b ON t.path = b.path WHERE t.qualified_owners = 1"""),
    "team_status": ("Rules' owners against the team of most of the covered paths' owners.", """
        SELECT line_no, slug, paths FROM (
          SELECT w.line_no, m.slug, count(DISTINCT o.path) AS paths, row_number() OVER (PARTITION BY w.line_no ORDER BY count(DISTINCT o.path) DESC, m.slug) AS n
          FROM {winners} AS w JOIN {owners} AS o ON w.path = o.path JOIN {team_members} AS m ON o.author = m.login GROUP BY w.line_no, m.slug) AS s WHERE n = 1"""),
}
