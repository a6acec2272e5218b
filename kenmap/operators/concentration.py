"""Concentration of knowledge: shares, indices, truck factors, distributions, qualified owners, departures.

Facts besides the others: criticality(ord, rx, weight).
"""

SQL = {
    "shares": ("Share of each owner in a path's scores, with the running sum from the largest.", """
        SELECT path, author, score, share, rank, sum(share) OVER (PARTITION BY path ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS covered FROM (
          SELECT path, author, score, rank, score / sum(score) OVER (PARTITION BY path) AS share FROM {ranked} WHERE score > 0) AS s"""),
    "concentration": ("Top share, Herfindahl index, effective owners, entropy, truck factors, minor and major owners of each path.", """
        SELECT path, max(share) AS top_share, sum(share * share) AS hhi, 1e0 / sum(share * share) AS effective_owners, sum(share * ln(1e0 / share)) AS entropy,
          coalesce(min(CASE WHEN covered >= 0.5e0 THEN rank END), count(*)) AS truck_50, coalesce(min(CASE WHEN covered >= 0.75e0 THEN rank END), count(*)) AS truck_75,
          coalesce(min(CASE WHEN covered >= 0.9e0 THEN rank END), count(*)) AS truck_90,
          sum(CASE WHEN share < :major_share THEN share ELSE 0e0 END) AS minor_share, count(CASE WHEN share >= :major_share THEN 1 END) AS major_owners
        FROM {shares} GROUP BY path"""),
    "path_weight": ("Weight of each path: that of the first criticality pattern that matches, else one.", """
        SELECT p.path, coalesce(w.weight, 1e0) AS weight, w.weight AS configured FROM (SELECT DISTINCT path FROM {owners}) AS p
        LEFT JOIN (
          SELECT path, weight FROM (SELECT t.path, c.weight, row_number() OVER (PARTITION BY t.path ORDER BY c.ord) AS n FROM (SELECT DISTINCT path FROM {owners}) AS t JOIN {criticality} AS c ON @matches(t.path, c.rx)) AS m WHERE n = 1) AS w
        ON p.path = w.path"""),
    "weighted_shares": ("Weight of each top share that occurs, with running weights in ascending order.", """
        SELECT top_share, weight, risky, sum(weight) OVER (ORDER BY top_share ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, sum(weight) OVER () AS total FROM (
          SELECT round(c.top_share, 4) AS top_share, sum(w.weight) AS weight, sum(CASE WHEN s.qualified_owners <= :critical_owners THEN w.weight ELSE 0e0 END) AS risky
          FROM {concentration} AS c JOIN {path_weight} AS w ON c.path = w.path JOIN {path_summary} AS s ON c.path = s.path GROUP BY 1) AS j"""),
    "owner_distribution": ("Weighted minimum, percentiles and risk shares over all paths; percentiles are shares that occur.", """
        SELECT min(top_share) AS minimum, min(CASE WHEN running >= 0.1e0 * total THEN top_share END) AS p10, min(CASE WHEN running >= 0.5e0 * total THEN top_share END) AS median_share,
          min(CASE WHEN running >= 0.9e0 * total THEN top_share END) AS p90, round(sum(weight * top_share) / max(total), 6) AS critical_path_risk,
          round(sum(risky) / max(total), 6) AS knowledge_at_risk
        FROM {weighted_shares}"""),
    "tiers": ("critical, warning or ok, by the number of qualified owners.", """
        SELECT path, qualified_owners, CASE WHEN qualified_owners <= :critical_owners THEN 'critical' WHEN qualified_owners <= :warn_owners THEN 'warning' ELSE 'ok' END AS tier FROM {path_summary}"""),
    "tier_counts": ("Paths of each tier.", "SELECT tier, count(*) AS paths FROM {tiers} GROUP BY tier"),
    "directory_best": ("Best score of each owner below a top directory: adjacency at any depth means one top directory.", """
        SELECT split_part(path, '/', 1) AS top, author, max(score) AS score FROM {owners} WHERE @contains(path, '/') GROUP BY 1, 2"""),
    "directory_leaders": ("The best people of each top directory: three more than a path can have owners.", """
        SELECT top, author, score FROM (SELECT top, author, score, row_number() OVER (PARTITION BY top ORDER BY score DESC, author) AS n FROM {directory_best}) AS l WHERE n <= :top_n + 3"""),
    "leaders": ("The best people of the repository: as many as can be left when the owners of a path are taken out.", "SELECT author, max(score) AS score FROM {owners} GROUP BY author ORDER BY score DESC, author LIMIT :top_n + 3"),
    "backups": ("Up to three people who do not own the path, best first: of the same top directory, else of the whole repository.", """
        SELECT path, author, score, place FROM (
          SELECT path, author, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, author) AS place FROM (
            SELECT path, author, score, near, max(near) OVER (PARTITION BY path) AS any_near FROM (
              SELECT p.path, d.author, d.score, 1 AS near FROM (SELECT path, split_part(path, '/', 1) AS top FROM {tiers} WHERE tier <> 'ok' AND @contains(path, '/')) AS p JOIN {directory_leaders} AS d ON p.top = d.top
              UNION ALL SELECT p.path, l.author, l.score, 0 FROM (SELECT path FROM {tiers} WHERE tier <> 'ok') AS p CROSS JOIN {leaders} AS l) AS c
            WHERE NOT EXISTS (SELECT 1 FROM {owners} AS o WHERE o.path = c.path AND o.author = c.author)) AS a
          WHERE near = any_near) AS b
        WHERE place <= 3"""),
    "removal": ("Owners of each path before and after a person leaves.", """
        SELECT path, count(*) AS before_count, count(CASE WHEN author <> :removed THEN 1 END) AS after_count FROM {ranked} GROUP BY path"""),
    "removal_summary": ("What a departure leaves behind.", """
        SELECT count(*) AS paths, count(CASE WHEN after_count = 0 THEN 1 END) AS orphaned, count(CASE WHEN after_count = 1 AND before_count > 1 THEN 1 END) AS down_to_one,
          round(count(CASE WHEN after_count = 0 THEN 1 END) * 1.0e0 / count(*), 6) AS orphaned_share FROM {removal}"""),
    "orphaned_directories": ("Topmost directories all of whose files a departure orphans.", """
        SELECT d.dir, d.files FROM {orphan_dirs} AS d LEFT JOIN {orphan_dirs} AS u ON u.dir = @prefix(d.dir, @depth(d.dir)) AND @depth(d.dir) > 0 WHERE u.dir IS NULL"""),
    "orphan_dirs": ("Directories without a file that keeps an owner.", """
        SELECT dir, count(*) AS files FROM (
          SELECT @prefix(path, d) AS dir, after_count FROM (SELECT path, after_count, @explode(@series(1, @depth(path))) AS d FROM {removal} WHERE @contains(path, '/')) AS x) AS a
        GROUP BY dir HAVING max(after_count) = 0"""),
    "transfer_candidates": ("Two best remaining people of each orphaned path's top directory.", """
        SELECT r.path, d.author, d.score, d.place FROM {removal} AS r JOIN (
          SELECT top, author, score, row_number() OVER (PARTITION BY top ORDER BY score DESC, author) AS place FROM {directory_best} WHERE author <> :removed) AS d
        ON split_part(r.path, '/', 1) = d.top WHERE r.after_count = 0 AND d.place <= 2"""),
    "person_load": ("Paths, commits and best score of each person.", """
        SELECT author, count(*) AS paths, CAST(sum(commits) AS BIGINT) AS commits, max(score) AS best FROM {ranked} GROUP BY author"""),
    "departure_order": ("People in the order in which a greedy departure takes them: most owned paths first.", """
        SELECT author, row_number() OVER (ORDER BY n DESC, author) AS place FROM (SELECT author, count(*) AS n FROM {owners} GROUP BY author) AS c"""),
    "departure_steps": ("For each departure how many paths lose their last owner by it.", """
        SELECT last_place, count(*) AS paths FROM (SELECT o.path, max(d.place) AS last_place FROM {owners} AS o JOIN {departure_order} AS d ON o.author = d.author GROUP BY o.path) AS l GROUP BY last_place"""),
    "repo_truck_factors": ("How many people must leave, each time the one who owns most paths, before fewer than a share of the paths have an owner.", """
        SELECT q.quantile, min(s.last_place) AS people FROM (
          SELECT last_place, sum(paths) OVER () - sum(paths) OVER (ORDER BY last_place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS covered, sum(paths) OVER () AS total FROM {departure_steps}) AS s
        JOIN (VALUES (0.5e0), (0.75e0), (0.9e0)) AS q(quantile) ON s.covered < q.quantile * s.total GROUP BY q.quantile"""),
}
