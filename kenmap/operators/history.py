"""Operators on change events: windows, filters, aggregates, activity.

Facts: events_all(path, author, sha, ts), commits(sha, author, ts, parents, subject), tracked(path),
extra_bots(author): service accounts that the user names.
"""

SQL = {
    "events": ("Events of the lookback window that ends at the analysis instant.", """
        SELECT path, author, sha, ts FROM {events_all}
        WHERE ts <= TIMESTAMP :as_of AND ts >= TIMESTAMP :as_of - INTERVAL :lookback_days DAYS"""),
    "gaps": ("Days between neighbouring distinct instants of each path.", """
        SELECT path, @days(ts, before) AS gap
        FROM (SELECT path, ts, lag(ts) OVER (PARTITION BY path ORDER BY ts) AS before FROM (SELECT DISTINCT path, ts FROM {events}) AS d) AS l
        WHERE before IS NOT NULL"""),
    "cadence": ("Exact median gap of each path; none where a path has one instant.", """
        SELECT path, median(gap) AS cadence_days FROM {gaps} GROUP BY path"""),
    "contributions": ("Per path and author: commits, credit, latest commit, commits by others after it, cadence.", """
        SELECT a.path, a.author, a.commits, a.commits * 1.0e0 AS credit, a.last_commit, a.last_sha, a.later_commits, c.cadence_days
        FROM (
          SELECT path, author, count(*) AS commits, max(ts) AS last_commit, min(CASE WHEN newest = 1 THEN sha END) AS last_sha, min(later) AS later_commits
          FROM (
            SELECT path, author, sha, ts, rank() OVER (PARTITION BY path ORDER BY ts DESC) - 1 AS later, row_number() OVER (PARTITION BY path, author ORDER BY ts DESC, sha) AS newest
            FROM {events}) AS r
          GROUP BY path, author) AS a
        LEFT JOIN {cadence} AS c ON a.path = c.path"""),
    "author_index": ("First commit and number of paths of each author.", """
        SELECT author, min(CASE WHEN oldest = 1 THEN sha END) AS first_sha, count(DISTINCT path) AS paths, count(DISTINCT sha) AS commits
        FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ts, sha, path) AS oldest FROM {events}) AS o GROUP BY author"""),
    "merge_strategy": ("merge, squash or rebase, by shares of merge commits and of squash subjects.", """
        SELECT CASE WHEN merges * 100 >= :merge_percent * n THEN 'merge' WHEN squashed * 100 >= :squash_percent * (n - merges) AND n > merges THEN 'squash' ELSE 'rebase' END AS strategy, merges, squashed, n AS commits
        FROM (SELECT count(*) AS n, count(CASE WHEN parents > 1 THEN 1 END) AS merges, count(CASE WHEN parents <= 1 AND @matches(subject, '[(]#[0-9]+[)]$') THEN 1 END) AS squashed FROM {commits}) AS c"""),
    "subject_templates": ("Subjects without hashes and versions, per author.", """
        SELECT author, trim(@replace_all(@replace_all(@replace_all(lower(subject), @raw('\\b[0-9a-f]{7,}\\b'), ''), '[0-9]+([.][0-9]+)*', ''), '[ ]+', ' ')) AS template, count(*) AS n
        FROM {commits} GROUP BY 1, 2"""),
    "mechanical_authors": ("Authors of many commits that mostly follow one template or a mechanical prefix.", """
        SELECT author, CAST(sum(n) AS BIGINT) AS commits, max(n) AS most
        FROM {subject_templates} GROUP BY author
        HAVING sum(n) >= :mass_floor AND (max(n) >= :mass_fraction * sum(n) OR sum(CASE WHEN @matches(template, '^(bump|chore[(]deps[)]|dependabot|automated)') THEN n ELSE 0 END) >= :mass_fraction * sum(n))"""),
    "capped_contributions": ("Contributions with the credit of mechanical authors capped at one.", """
        SELECT c.path, c.author, c.commits, CASE WHEN m.author IS NOT NULL THEN least(c.credit, 1e0) ELSE c.credit END AS credit, c.last_commit, c.last_sha, c.later_commits, c.cadence_days
        FROM {contributions} AS c LEFT JOIN {mechanical_authors} AS m ON c.author = m.author"""),
    "bot_authors": ("Authors that are bots by name.", """
        SELECT DISTINCT author FROM {events_all}
        WHERE @contains(lower(author), '[bot]') OR lower(author) LIKE 'bot@%' OR lower(author) = 'actions@github.com' OR split_part(lower(author), '@', 1) IN ('dependabot', 'renovate', 'github-actions', 'release-please')
          OR lower(author) IN (SELECT lower(author) FROM {extra_bots})"""),
    "kept_contributions": ("Contributions to tracked, not excluded paths by people; filters follow the aggregates, which count everyone.", """
        SELECT c.* FROM {capped_contributions} AS c
        WHERE NOT EXISTS (SELECT 1 FROM {bot_authors} AS b WHERE b.author = c.author)
          AND EXISTS (SELECT 1 FROM {tracked} AS t WHERE t.path = c.path)
          AND NOT EXISTS (SELECT 1 FROM {excluded_paths} AS x WHERE x.path = c.path)"""),
    "excluded_paths": ("Tracked paths that an exclude pattern matches (whole-path globs).", """
        SELECT DISTINCT t.path FROM {tracked} AS t JOIN {exclude_rules} AS x ON @matches(t.path, x.rx)"""),
    "active_paths": ("Paths with an author of at least the least commits (threshold strategy).", """
        SELECT path FROM {kept_contributions} GROUP BY path HAVING max(commits) >= :min_commits"""),
    "cochange": ("For each path the number of other paths changed with it, commits of more files than the cap left out.", """
        SELECT path, count(DISTINCT other) AS degree FROM (
          SELECT a.path, b.path AS other FROM {small_commits} AS a JOIN {small_commits} AS b ON a.sha = b.sha AND a.path <> b.path) AS p
        GROUP BY path"""),
    "small_commits": ("Paths of commits within the co-change cap.", """
        SELECT DISTINCT e.path, e.sha FROM {events} AS e
        JOIN (SELECT sha FROM {events} GROUP BY sha HAVING count(DISTINCT path) <= :cochange_cap) AS s ON e.sha = s.sha"""),
    "path_activity": ("Change events, cadence and normalised co-change degree of each path.", """
        SELECT e.path, e.change_events, c.cadence_days, CASE WHEN m.most > 0 THEN d.degree * 1.0e0 / m.most END AS cochange_degree
        FROM (SELECT path, count(DISTINCT sha) AS change_events FROM {events} GROUP BY path) AS e
        LEFT JOIN {cadence} AS c ON e.path = c.path LEFT JOIN {cochange} AS d ON e.path = d.path
        CROSS JOIN (SELECT max(degree) AS most FROM {cochange}) AS m"""),
    "recent_shas": ("The five newest commits of each author.", """
        SELECT author, sha, ts FROM (
          SELECT author, sha, ts, row_number() OVER (PARTITION BY author ORDER BY ts DESC, sha) AS n FROM (SELECT DISTINCT author, sha, ts FROM {events}) AS d) AS r
        WHERE n <= 5"""),
    "trend_points": ("Cumulative snapshots of the periods that end at the analysis instant.", """
        SELECT p.period, count(DISTINCT e.sha) AS commits, count(DISTINCT e.author) AS contributors, count(DISTINCT e.path) AS paths
        FROM {periods} AS p JOIN {events_all} AS e ON @days(TIMESTAMP :as_of, e.ts) >= p.ends_before AND @days(TIMESTAMP :as_of, e.ts) <= :periods * :period_days
        GROUP BY p.period"""),
    "periods": ("Period numbers, oldest first, with the days between their end and the instant.", """
        SELECT n AS period, (:periods - 1 - n) * :period_days AS ends_before FROM (SELECT @explode(@series(0, :periods - 1)) AS n) AS v"""),
    "trend_report": ("Each period with its activity, the mean of the top scores and of the qualified owners (counted up to the cap of shown owners), and the paths that hang on too few of them.", """
        SELECT t.period, p.commits, p.contributors, p.paths, round(avg(t.top), 4) AS mean_top_score, round(avg(t.qualified), 4) AS mean_qualified, count(CASE WHEN t.qualified <= :critical_owners THEN 1 END) AS critical_paths, count(*) AS scored_paths
        FROM (
          SELECT period, path, max(score) AS top, least(:top_n, count(CASE WHEN score >= :threshold THEN 1 END)) AS qualified FROM (
            SELECT period, path, (:w_recency * power(0.5e0, greatest(0e0, @days(TIMESTAMP :as_of, last_commit) - ends_before) / :half_life) + :w_frequency * least(1e0, commits / (max(commits) OVER (PARTITION BY period, path) + :frequency_prior))) / (:w_recency + :w_frequency) AS score
            FROM (
              SELECT p.period, p.ends_before, e.path, e.author, count(*) AS commits, max(e.ts) AS last_commit
              FROM {periods} AS p JOIN {events_all} AS e ON @days(TIMESTAMP :as_of, e.ts) >= p.ends_before AND @days(TIMESTAMP :as_of, e.ts) <= :periods * :period_days
              GROUP BY p.period, p.ends_before, e.path, e.author) AS g) AS s
          GROUP BY period, path) AS t
        JOIN {trend_points} AS p ON t.period = p.period GROUP BY t.period, p.commits, p.contributors, p.paths"""),
    "trend_scores": ("Mean top score by recency and frequency of each period.", """
        SELECT period, round(avg(top), 4) AS mean_top_score, count(*) AS scored_paths FROM (
          SELECT period, path, max((:w_recency * power(0.5e0, greatest(0e0, @days(TIMESTAMP :as_of, last_commit) - ends_before) / :half_life) + :w_frequency * least(1e0, commits / (most + :frequency_prior))) / (:w_recency + :w_frequency)) AS top
          FROM (
            SELECT *, max(commits) OVER (PARTITION BY period, path) AS most FROM (
              SELECT p.period, p.ends_before, e.path, e.author, count(*) AS commits, max(e.ts) AS last_commit
              FROM {periods} AS p JOIN {events_all} AS e ON @days(TIMESTAMP :as_of, e.ts) >= p.ends_before AND @days(TIMESTAMP :as_of, e.ts) <= :periods * :period_days
              GROUP BY p.period, p.ends_before, e.path, e.author) AS g) AS m
          GROUP BY period, path) AS t
        GROUP BY period"""),
}
