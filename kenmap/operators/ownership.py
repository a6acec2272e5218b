"""Scoring: five signals with availability per path, quality, freshness, gate, top owners, evidence.

Facts besides those of ``history``: blame_lines(path, author, n_lines), blame_then(path, author, n_lines),
review_counts(path, author, n).
"""

_SIGNALS = ("recency", "frequency", "blame", "review", "survival")

SQL = {
    "blame_share": ("Share of each path's lines per author.", """
        SELECT path, author, n_lines / sum(n_lines) OVER (PARTITION BY path) AS share FROM (SELECT path, author, sum(n_lines) AS n_lines FROM {blame_lines} GROUP BY path, author) AS b"""),
    "review_share": ("Share of each path's (pull, reviewer) incidences per reviewer.", """
        SELECT path, author, n * 1.0e0 / sum(n) OVER (PARTITION BY path) AS share FROM (SELECT path, author, sum(n) AS n FROM {review_counts} GROUP BY path, author) AS r"""),
    "survival": ("Lines an author has now against those at the author's last commit; none where that is unknown.", """
        SELECT t.path, t.author, CASE WHEN t.n_lines > 0 THEN least(1e0, coalesce(n.n_lines, 0e0) / t.n_lines) END AS ratio
        FROM {blame_then} AS t LEFT JOIN (SELECT path, author, sum(n_lines) AS n_lines FROM {blame_lines} GROUP BY path, author) AS n ON t.path = n.path AND t.author = n.author"""),
    "qualified": ("Contributions of authors with enough commits, or with a strong share of the lines.", """
        SELECT c.*, coalesce(b.share, 0e0) AS blame_raw FROM {kept_contributions} AS c LEFT JOIN {blame_share} AS b ON c.path = b.path AND c.author = b.author
        WHERE c.commits >= :min_commits OR coalesce(b.share, 0e0) >= :blame_override"""),
    "signals": ("The five signals of each path and author; null where a signal is not available on that path.", """
        SELECT q.path, q.author, q.commits, q.later_commits, q.last_commit, q.last_sha, q.cadence_days, q.half_life, q.path_last,
          power(0.5e0, greatest(0e0, @days(TIMESTAMP :as_of, q.last_commit)) / q.half_life) AS recency,
          CASE WHEN q.most > 0 THEN least(1e0, q.credit / (q.most + :frequency_prior)) ELSE 0e0 END AS frequency,
          CASE WHEN bp.path IS NOT NULL THEN q.blame_raw END AS blame,
          CASE WHEN rc.n > 0 THEN least(1e0, coalesce(r.share, 0e0)) END AS review,
          CASE WHEN bp.path IS NOT NULL THEN s.ratio END AS survival
        FROM (
          SELECT *, CASE WHEN cadence_days IS NULL THEN :half_life ELSE least(greatest(cadence_days, :half_life_floor), :half_life_ceiling) END AS half_life,
            max(credit) OVER (PARTITION BY path) AS most, max(last_commit) OVER (PARTITION BY path) AS path_last
          FROM {qualified}) AS q
        CROSS JOIN (SELECT count(*) AS n FROM {review_counts}) AS rc
        LEFT JOIN (SELECT DISTINCT path FROM {blame_lines}) AS bp ON q.path = bp.path
        LEFT JOIN {review_share} AS r ON q.path = r.path AND q.author = r.author
        LEFT JOIN {survival} AS s ON q.path = s.path AND q.author = s.author"""),
    "scored": ("Score, evidence quality and freshness of each path and author.", """
        SELECT path, author, commits, last_commit, last_sha, cadence_days, half_life, recency, frequency, blame, review, survival,
          least(1e0, (""" + " + ".join(f"CASE WHEN {s} IS NOT NULL THEN :w_{s} * {s} ELSE 0e0 END" for s in _SIGNALS) + """) / (""" + " + ".join(f"CASE WHEN {s} IS NOT NULL THEN :w_{s} ELSE 0e0 END" for s in _SIGNALS) + """)) AS score,
          :completeness * (""" + " + ".join(f"CASE WHEN {s} IS NOT NULL THEN :w_{s} ELSE 0e0 END" for s in _SIGNALS) + """) / (""" + " + ".join(f":w_{s}" for s in _SIGNALS) + """) AS quality,
          commits * 1.0e0 / (commits + later_commits) AS historical,
          power(0.5e0, greatest(0e0, @days(TIMESTAMP :as_of, path_last)) / half_life) AS maintenance,
          CASE WHEN survival IS NULL AND later_commits > commits THEN 'superseded'
               WHEN survival < :superseded_cut AND later_commits > 0 THEN 'superseded'
               WHEN cadence_days IS NULL THEN CASE WHEN age > :decay_days THEN 'inactive' ELSE 'stable' END
               WHEN age <= half_life THEN 'stable'
               WHEN last_commit = path_last AND age <= :half_life_ceiling THEN 'stable'
               ELSE 'inactive' END AS status, age
        FROM (SELECT *, floor(greatest(0e0, @days(TIMESTAMP :as_of, last_commit))) AS age FROM {signals}) AS s"""),
    "ranked": ("Owners at or above the threshold, in rank order.", """
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, author) AS rank FROM {scored} WHERE score >= :threshold"""),
    "owners": ("The top owners of each path.", """
        SELECT * FROM {ranked} WHERE rank <= :top_n"""),
    "path_summary": ("Per path: qualified owners, primary owner, activity, decay.", """
        SELECT o.path, count(*) AS qualified_owners, max(CASE WHEN o.rank = 1 THEN o.author END) AS primary_owner, max(o.score) AS top_score,
          count(CASE WHEN o.status <> 'stable' THEN 1 END) AS decaying, max(a.change_events) AS change_events, max(a.cadence_days) AS cadence_days, max(a.cochange_degree) AS cochange_degree
        FROM {owners} AS o LEFT JOIN {path_activity} AS a ON o.path = a.path GROUP BY o.path"""),
    "decay_warnings": ("Top owners whose knowledge is no longer fresh; inactive people without a fresh path anywhere are departed.", """
        SELECT o.path, o.author, CAST(o.age AS BIGINT) AS days, CASE WHEN o.status = 'inactive' AND a.author IS NULL THEN 'departed' ELSE o.status END AS status
        FROM {owners} AS o LEFT JOIN (SELECT DISTINCT author FROM {owners} WHERE status = 'stable') AS a ON o.author = a.author
        WHERE o.status <> 'stable'"""),
    "evidence": ("All signals as evidence rows.", "\n UNION ALL ".join(f"SELECT path, author, '{s}' AS kind, {s} AS value FROM {{signals}} WHERE {s} IS NOT NULL" for s in _SIGNALS)),
    "rescored": ("Scores computed again from the evidence rows alone.", """
        SELECT path, author, least(1e0, sum(w * value) / sum(w)) AS score FROM (
          SELECT path, author, value, CASE kind """ + " ".join(f"WHEN '{s}' THEN :w_{s}" for s in _SIGNALS) + """ END AS w FROM {evidence}) AS e
        GROUP BY path, author"""),
    "signal_completeness": ("Share of signals that are available over the owners of each path.", """
        SELECT path, round(sum(CASE WHEN blame IS NULL THEN 0 ELSE 1 END + CASE WHEN review IS NULL THEN 0 ELSE 1 END + CASE WHEN survival IS NULL THEN 0 ELSE 1 END + 2) / (5.0e0 * count(*)), 6) AS completeness FROM {owners} GROUP BY path"""),
    "expertise": ("Best score, commits and latest change of each person over a target directory.", """
        SELECT author, max(score) AS score, CAST(sum(commits) AS BIGINT) AS commits, max(last_commit) AS last_commit, count(*) AS paths
        FROM {ranked} WHERE path = :target OR path LIKE :target || '/%' GROUP BY author"""),
}
