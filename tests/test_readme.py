from pathlib import Path

import __spark_entry__ as entry


def test_every_query_has_a_statement_or_is_known_not_to():
    folds = {"person_graph", "topology", "knowledge_betweenness", "community_levels", "clusters", "team_comparisons", "onboarding_plan", "path_lineage", "parsed_rules", "pipeline"}
    without = {n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op")}
    assert without <= folds


def test_readme_lists_the_layout():
    text = (Path(__file__).resolve().parents[1] / "README.md").read_text()
    assert all(f"kenmap/{d}" in text for d in ("plans", "operators", "functions", "sources", "sinks", "streaming"))
