"""People: reviews and load, teams, identities, privacy, the collaboration graph.

Facts besides the others: pulls(number, reviewer, opened, closed, lines), teams(slug, parent), team_members(slug, login),
identities(identity, email, name).
"""

SQL = {
    "review_counts_total": ("Completed reviews, distinct pulls, lines and median hours of each reviewer.", """
        SELECT reviewer, count(*) AS reviews, count(DISTINCT number) AS pulls, CAST(sum(lines) AS BIGINT) AS lines, round(median(24e0 * @days(closed, opened)), 2) AS median_hours, round(median(lines), 2) AS median_lines FROM {pulls} WHERE closed IS NOT NULL GROUP BY reviewer"""),
    "review_load": ("Load of each reviewer against the averages of completed and of waiting reviews: high, low or typical.", """
        SELECT reviewer, reviews, average, waiting, CASE WHEN average > 0 AND reviews >= :overload * average OR waiting_average > 0 AND waiting >= :overload * waiting_average THEN 'high'
          WHEN reviews <= average AND waiting <= waiting_average THEN 'low' ELSE 'typical' END AS band FROM (
          SELECT r.reviewer, r.reviews, coalesce(w.waiting, 0) AS waiting, a.average, round(t.waiting * 1.0e0 / a.reviewers, 2) AS waiting_average
          FROM {review_counts_total} AS r LEFT JOIN {waiting_reviews} AS w ON r.reviewer = w.reviewer
          CROSS JOIN (SELECT round(avg(reviews), 2) AS average, count(*) AS reviewers FROM {review_counts_total}) AS a
          CROSS JOIN (SELECT coalesce(sum(v.waiting), 0) AS waiting FROM {waiting_reviews} AS v JOIN {review_counts_total} AS x ON v.reviewer = x.reviewer) AS t) AS l"""),
    "review_monopolies": ("Paths where one reviewer holds most reviews although two owners or more know the path.", """
        SELECT path, author, round(share, 4) AS share, knowledgeable FROM (
          SELECT r.path, r.author, r.share, k.n AS knowledgeable, row_number() OVER (PARTITION BY r.path ORDER BY r.share DESC, r.author DESC) AS n
          FROM {review_share} AS r JOIN (SELECT path, count(*) AS n FROM {owners} GROUP BY path HAVING count(*) >= 2) AS k ON r.path = k.path) AS m
        WHERE n = 1 AND share >= :monopoly"""),
    "co_owners": ("Ordered pairs of people who own a path together, with the best score of the second.", """
        SELECT a.author, b.author AS other, max(b.score) AS best, count(*) AS paths FROM {owners} AS a JOIN {owners} AS b ON a.path = b.path AND a.author <> b.author GROUP BY a.author, b.author"""),
    "rebalance": ("For each overloaded reviewer the best colleague who is not, with how many reviews to shift.", """
        SELECT author, other, round(best, 6) AS confidence, least(greatest(1, CAST(floor(other_reviews * :max_increase) AS BIGINT)), greatest(1, CAST(floor(reviews / 4e0) AS BIGINT))) AS shift FROM (
          SELECT c.author, c.other, c.best, h.reviews, coalesce(l.reviews, 0) AS other_reviews,
            row_number() OVER (PARTITION BY c.author ORDER BY CASE WHEN l.band IS NULL OR l.band = 'low' THEN 0 ELSE 1 END, p.best DESC, coalesce(l.reviews, 0), lower(c.other)) AS n
          FROM {co_owners} AS c JOIN {review_load} AS h ON c.author = h.reviewer AND h.band = 'high' LEFT JOIN {review_load} AS l ON c.other = l.reviewer JOIN {person_load} AS p ON c.other = p.author
          WHERE l.band IS NULL OR l.band <> 'high') AS r WHERE n = 1"""),
    "pair_weights": ("Collaboration of two people: smaller scores and smaller review shares over common paths, and a quarter for each common directory.", """
        SELECT least_name AS a, greatest_name AS b, sum(w) AS weight FROM (
          SELECT a.author AS least_name, b.author AS greatest_name, least(a.score, b.score) + CASE WHEN a.review IS NULL OR b.review IS NULL THEN 0e0 ELSE least(a.review, b.review) END AS w
          FROM {owners} AS a JOIN {owners} AS b ON a.path = b.path AND a.author < b.author
          UNION ALL SELECT a.author, b.author, 0.25e0 FROM {person_dirs} AS a JOIN {person_dirs} AS b ON a.dir = b.dir AND a.author < b.author) AS p GROUP BY 1, 2"""),
    "person_dirs": ("Directories in which a person owns a file.", "SELECT DISTINCT author, @prefix(path, @depth(path)) AS dir FROM {owners} WHERE @contains(path, '/')"),
    "modularity": ("Newman modularity of the collaboration graph under the declared teams.", """
        SELECT sum(inside / total - (degree / (2e0 * total)) * (degree / (2e0 * total))) AS modularity FROM (
          SELECT m.slug, coalesce(max(i.inside), 0e0) AS inside, sum(d.degree) AS degree, max(t.total) AS total
          FROM {team_members} AS m JOIN {weighted_degree} AS d ON m.login = d.person
          LEFT JOIN (SELECT x.slug, sum(p.weight) AS inside FROM {pair_weights} AS p JOIN {team_members} AS x ON p.a = x.login JOIN {team_members} AS y ON p.b = y.login AND x.slug = y.slug GROUP BY x.slug) AS i ON m.slug = i.slug
          CROSS JOIN (SELECT sum(weight) AS total FROM {pair_weights}) AS t GROUP BY m.slug) AS g"""),
    "weighted_degree": ("Total collaboration weight of each person.", "SELECT person, sum(weight) AS degree FROM (SELECT a AS person, weight FROM {pair_weights} UNION ALL SELECT b, weight FROM {pair_weights}) AS w GROUP BY person"),
    "team_closure": ("Members of each team and of all teams below it, whatever the depth; teams that hold each other hold the same people.", """
        SELECT DISTINCT b.slug, m.login FROM {teams_below} AS b JOIN {team_members} AS m ON m.slug = b.inner_slug"""),
    "teams_below": ("Each team with itself and all teams below it; on Spark a closure by rounds (``components.below``), as its recursive statements end by depth only.", """
        WITH RECURSIVE below(slug, inner_slug) AS (SELECT slug, slug FROM {teams} UNION SELECT b.slug, c.slug FROM below AS b JOIN {teams} AS c ON c.parent = b.inner_slug)
        SELECT slug, inner_slug FROM below"""),
    "narrowest_team": ("For each path the smallest team that holds all its owners.", """
        SELECT path, slug FROM (
          SELECT o.path, m.slug, row_number() OVER (PARTITION BY o.path ORDER BY z.members, m.slug) AS n
          FROM {owners} AS o JOIN {team_closure} AS m ON o.author = m.login JOIN (SELECT slug, count(*) AS members FROM {team_closure} GROUP BY slug) AS z ON m.slug = z.slug
          JOIN (SELECT path, count(*) AS owners FROM {owners} GROUP BY path) AS k ON o.path = k.path
          GROUP BY o.path, m.slug, z.members, k.owners HAVING count(*) = k.owners) AS r WHERE n = 1"""),
    "team_coverage": ("Share of a team's members seen as owners in each top directory.", """
        SELECT d.top, m.slug, round(count(DISTINCT d.author) * 1.0e0 / max(z.members), 6) AS coverage FROM {directory_best} AS d JOIN {team_members} AS m ON d.author = m.login
        JOIN (SELECT slug, count(*) AS members FROM {team_members} GROUP BY slug) AS z ON m.slug = z.slug GROUP BY d.top, m.slug"""),
    "contributor_status": ("Status of each person: as the roster says, bot, external (a handle that is no member), else active or inactive by the latest event.", """
        SELECT a.author, CASE WHEN r.status IS NOT NULL THEN r.status WHEN b.author IS NOT NULL THEN 'bot'
          WHEN substr(a.author, 1, 1) = '@' AND o.login IS NULL THEN 'external'
          WHEN a.age IS NULL THEN CASE WHEN substr(a.author, 1, 1) = '@' THEN 'inactive' ELSE 'unknown' END WHEN floor(a.age) <= :decay_days THEN 'active' ELSE 'inactive' END AS status
        FROM (SELECT author, min(CASE WHEN ts <= TIMESTAMP :as_of THEN @days(TIMESTAMP :as_of, ts) END) AS age FROM {events_all} GROUP BY author) AS a
        LEFT JOIN {roster_status} AS r ON lower(@replace_all(a.author, '^@+', '')) = lower(@replace_all(r.identity, '^@+', '')) LEFT JOIN {bot_authors} AS b ON a.author = b.author
        LEFT JOIN {org_members} AS o ON lower(@replace_all(a.author, '^@+', '')) = lower(o.login)"""),
    "former_share": ("Share of all positive scores that former people hold.", """
        SELECT round(coalesce(sum(CASE WHEN s.status = 'former' THEN r.score ELSE 0e0 END) / sum(r.score), 0e0), 6) AS share FROM {ranked} AS r JOIN {contributor_status} AS s ON r.author = s.author WHERE r.score > 0"""),
    "duplicate_identities": ("Identities that share a name or a local part with others, each with the first of its group.", """
        SELECT g.identity, g.first_identity, g.reason, g.members FROM (
          SELECT identity, min(identity) OVER (PARTITION BY reason, sign) AS first_identity, reason, count(*) OVER (PARTITION BY reason, sign) AS members FROM (
            SELECT identity, 'name' AS reason, lower(name) AS sign FROM {identities} WHERE name <> '' UNION ALL SELECT identity, 'local part', split_part(lower(email), '@', 1) FROM {identities} WHERE email <> '') AS s) AS g
        WHERE g.members > 1 AND g.identity <> g.first_identity"""),
    "handles": ("Login of each address: of a noreply address its login, else its token.", """
        SELECT email, CASE WHEN @matches(lower(email), '^([0-9]+[+])?[a-z0-9-]+@users[.]noreply[.]') THEN @extract(lower(email), '^(?:[0-9]+[+])?([a-z0-9-]+)@', 1) ELSE 'email:' || substr(@sha(lower(email)), 1, 16) END AS handle FROM {identities}"""),
    "pseudonyms": ("Stable names that hide who a person is, salted by the repository.", """
        SELECT identity, 'person-' || substr(@sha(:repo_id || chr(10) || lower(identity)), 1, 12) AS pseudonym FROM {identities}"""),
    "graph_edges": ("Edges of the knowledge graph, relations of one pair joined.", """
        SELECT src, dst, @joined(relation) AS relations, count(*) AS n FROM (
          SELECT author AS src, path AS dst, 'observed' AS relation FROM {owners}
          UNION ALL SELECT author, path, 'authored' FROM {owners} WHERE commits > 0
          UNION ALL SELECT author, path, 'reviews' FROM {owners} WHERE review > 0
          UNION ALL SELECT author, path, 'decaying' FROM {owners} WHERE status <> 'stable'
          UNION ALL SELECT DISTINCT split_part(path, '/', 1), path, 'contains' FROM {owners}
          UNION ALL SELECT slug, login, 'member' FROM {team_members}) AS e
        GROUP BY src, dst"""),
    "graph_degree": ("Neighbours of each node.", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {graph_edges} UNION ALL SELECT dst FROM {graph_edges}) AS n GROUP BY node"),
    "orphan_groups": ("Paths without a fresh owner, by top directory.", "SELECT split_part(path, '/', 1) AS dir, count(*) AS paths FROM {vacuum} GROUP BY 1"),
    "mentors": ("Three people with most owned paths of the target.", "SELECT author, paths, commits FROM {expertise} ORDER BY paths DESC, commits DESC, author LIMIT 3"),
    "onboarding": ("Paths of the target in learning order: few owners, many events, weight.", """
        SELECT path, row_number() OVER (ORDER BY qualified_owners, coalesce(change_events, 0) DESC, path) AS step, qualified_owners, primary_owner FROM {path_summary} WHERE path LIKE :target || '/%'"""),
}
