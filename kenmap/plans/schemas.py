"""Columns and types of every report: what ``catalog.rounded`` returns (doubles to six digits, whole numbers as bigint, time stamps as text)."""

SCHEMAS: dict[str, str] = {
    "events": "path string, author string, sha bigint, ts timestamp",
    "cadence": "path string, cadence_days double",
    "contributions": "path string, author string, commits bigint, credit double, last_commit timestamp, last_sha bigint, later_commits bigint, cadence_days double",
    "author_index": "author string, first_sha bigint, paths bigint, commits bigint",
    "merge_strategy": "strategy string, merges bigint, squashed bigint, commits bigint",
    "subject_templates": "author string, template string, n bigint",
    "mechanical_authors": "author string, commits bigint, most bigint",
    "capped_contributions": "path string, author string, commits bigint, credit double, last_commit timestamp, last_sha bigint, later_commits bigint, cadence_days double",
    "bot_authors": "author string",
    "kept_contributions": "path string, author string, commits bigint, credit double, last_commit timestamp, last_sha bigint, later_commits bigint, cadence_days double",
    "excluded_paths": "path string",
    "active_paths": "path string",
    "cochange": "path string, degree bigint",
    "path_activity": "path string, change_events bigint, cadence_days double, cochange_degree double",
    "recent_shas": "author string, sha bigint, ts timestamp",
    "trend_points": "period bigint, commits bigint, contributors bigint, paths bigint",
    "trend_report": "period bigint, commits bigint, contributors bigint, paths bigint, mean_top_score double, mean_qualified double, critical_paths bigint, scored_paths bigint",
    "explanations": "path string, owners string, candidates string, quality double, commits bigint, declared string, rule_line bigint, assessment string",
    "trend_scores": "period bigint, mean_top_score double, scored_paths bigint",
    "blame_share": "path string, author string, share double",
    "review_share": "path string, author string, share double",
    "survival": "path string, author string, ratio double",
    "qualified": "path string, author string, commits bigint, credit double, last_commit timestamp, last_sha bigint, later_commits bigint, cadence_days double, blame_raw double",
    "signals": "path string, author string, commits bigint, later_commits bigint, last_commit timestamp, last_sha bigint, cadence_days double, half_life double, path_last timestamp, recency double, frequency double, blame double, review double, survival double",
    "scored": "path string, author string, commits bigint, last_commit timestamp, last_sha bigint, cadence_days double, half_life double, recency double, frequency double, blame double, review double, survival double, score double, quality double, historical double, maintenance double, status string, age bigint",
    "ranked": "path string, author string, commits bigint, last_commit timestamp, last_sha bigint, cadence_days double, half_life double, recency double, frequency double, blame double, review double, survival double, score double, quality double, historical double, maintenance double, status string, age bigint, rank bigint",
    "owners": "path string, author string, commits bigint, last_commit timestamp, last_sha bigint, cadence_days double, half_life double, recency double, frequency double, blame double, review double, survival double, score double, quality double, historical double, maintenance double, status string, age bigint, rank bigint",
    "path_summary": "path string, qualified_owners bigint, primary_owner string, top_score double, decaying bigint, change_events bigint, cadence_days double, cochange_degree double",
    "decay_warnings": "path string, author string, days bigint, status string",
    "evidence": "path string, author string, kind string, value double",
    "rescored": "path string, author string, score double",
    "signal_completeness": "path string, completeness double",
    "expertise": "author string, score double, commits bigint, last_commit timestamp, paths bigint",
    "shares": "path string, author string, score double, share double, rank bigint, covered double",
    "concentration": "path string, top_share double, hhi double, effective_owners double, entropy double, truck_50 bigint, truck_75 bigint, truck_90 bigint, minor_share double, major_owners bigint",
    "path_weight": "path string, weight double, configured double",
    "owner_distribution": "minimum double, p10 double, median_share double, p90 double, critical_path_risk double, knowledge_at_risk double",
    "tiers": "path string, qualified_owners bigint, tier string",
    "tier_counts": "tier string, paths bigint",
    "directory_best": "top string, author string, score double",
    "backups": "path string, author string, score double, place bigint",
    "removal": "path string, before_count bigint, after_count bigint",
    "removal_summary": "paths bigint, orphaned bigint, down_to_one bigint, orphaned_share double",
    "orphaned_directories": "dir string, files bigint",
    "transfer_candidates": "path string, author string, score double, place bigint",
    "person_load": "author string, paths bigint, commits bigint, best double",
    "rule_matches": "path string, line_no bigint",
    "winners": "path string, line_no bigint, pattern string, owners string, source string",
    "rule_owners": "line_no bigint, owner string",
    "coverage": "paths bigint, covered bigint, assigned bigint, share double",
    "dead_rules": "line_no bigint, pattern string",
    "broad_rules": "line_no bigint, paths bigint",
    "duplicate_rules": "line_no bigint, pattern string",
    "shadowed_rules": "line_no bigint, path string, paths bigint, by_line bigint",
    "drift_missing": "category string, path string, delta double, line_no bigint, qualified_owners bigint, decay boolean, overlap double",
    "drift_stale": "category string, path string, delta double, line_no bigint, qualified_owners bigint, decay boolean, overlap double",
    "declared": "path string, line_no bigint, owner string",
    "divergence": "path string, line_no bigint, delta double, overlap double, differing bigint",
    "drift_changed": "category string, path string, delta double, line_no bigint, qualified_owners bigint, decay boolean, overlap double",
    "drift": "category string, path string, delta double, line_no bigint, qualified_owners bigint, decay boolean, overlap double, weight double, score double, severity string",
    "drift_severity": "severity string, entries bigint, high_entries bigint",
    "findings": "rule string, path string, owners string, fingerprint string",
    "suppressed": "rule string, path string",
    "new_findings": "rule string, path string, owners string, fingerprint string",
    "settled_findings": "rule string, path string, owners string",
    "consolidated": "pattern string, owners string, files bigint",
    "owner_sets": "path string, owners string",
    "audit": "item string, status string, n bigint",
    "risk_factors": "path string, primary_owner string, concentration double, frequency double, coupling double, criticality double, decay double, truck_50 bigint",
    "risk": "path string, risk bigint, tier string, single_expert boolean, high_churn boolean, coupled boolean, stale_expertise boolean",
    "risk_summary": "tier string, paths bigint, worst bigint",
    "vacuum": "path string, best double, days bigint",
    "phantom_owners": "path string, owner string",
    "shadow_experts": "path string, author string, score double",
    "role_divergence": "path string, writer string, reviewer string",
    "pathologies": "path string, kind string, n bigint",
    "transfers": "path string, author string, successor string",
    "base_primary": "path string, author string, score double, qualified_owners bigint",
    "change_report": "path string, before_owner string, after_owner string, before_count bigint, after_count bigint, kind string",
    "change_kinds": "kind string, paths bigint",
    "review_counts_total": "reviewer string, reviews bigint, pulls bigint, lines bigint, median_hours double, median_lines double",
    "review_load": "reviewer string, reviews bigint, average double, waiting bigint, band string",
    "review_monopolies": "path string, author string, share double, knowledgeable bigint",
    "co_owners": "author string, other string, best double, paths bigint",
    "rebalance": "author string, other string, confidence double, shift bigint",
    "pair_weights": "a string, b string, weight double",
    "person_dirs": "author string, dir string",
    "modularity": "modularity double",
    "weighted_degree": "person string, degree double",
    "team_closure": "slug string, login string",
    "narrowest_team": "path string, slug string",
    "team_coverage": "top string, slug string, coverage double",
    "contributor_status": "author string, status string",
    "former_share": "share double",
    "duplicate_identities": "identity string, first_identity string, reason string, members bigint",
    "handles": "email string, handle string",
    "pseudonyms": "identity string, pseudonym string",
    "graph_edges": "src string, dst string, relations string, n bigint",
    "graph_degree": "node string, degree bigint",
    "orphan_groups": "dir string, paths bigint",
    "mentors": "author string, paths bigint, commits bigint",
    "onboarding": "path string, step bigint, qualified_owners bigint, primary_owner string",
    "mass_commits": "sha bigint, modified bigint",
    "rename_commits": "sha bigint, renames bigint, similarity bigint",
    "lineage_confidence": "path string, author string, score double, quality double",
    "security_findings": "path string, problems bigint",
    "invalid_rules": "line_no bigint, pattern string, problem string",
    "blocking_findings": "rule string, path string",
    "expired_suppressions": "rule string, path string",
    "shadowed_generated": "line_no bigint, hidden_line bigint, paths bigint",
    "match_chain": "path string, line_no bigint, step bigint",
    "explanation": "author string, score double, recency double, frequency double, blame double, review double, survival double, status string, paths bigint",
    "why_not": "author string, paths bigint, below_threshold bigint, beyond_top bigint, best double",
    "outside_window": "author string, last_commit timestamp",
    "assessment": "path string, verdict string",
    "layers": "top string, observed string, declared string",
    "merged_owners": "path string, handle string, score double, commits bigint, last_commit timestamp, quality double, merged bigint",
    "without_person": "path string, owners bigint, top_score double",
    "private_owners": "path string, person string, score double",
    "redacted_subjects": "sha bigint, subject string",
    "completeness": "completeness double, gaps bigint",
    "reviewer_suggestions": "author string, score double, covered bigint, last_commit timestamp, overloaded bigint",
    "waiting_reviews": "reviewer string, waiting bigint",
    "first_response": "number bigint, hours double",
    "stale_declared": "path string, owner string, status string",
    "solo_repository": "people bigint, solo boolean",
    "single_owner_paths": "path string, has_backup bigint",
    "team_status": "line_no bigint, slug string, paths bigint",
    "gap_list": "ord bigint, code string",
    "manifests": "path string",
    "declared_teams": "owner string, known boolean, members bigint",
    "last_written": "path string, line_no bigint",
    "drift_entries": "category string, path string, line_no bigint, kind string, action string, delta double, severity string, place bigint",
    "drift_digest": "category string, entries bigint, left_out bigint, worst bigint",
    "path_signals": "line_no bigint, qualified_owners bigint, decay boolean, paths bigint",
    "rule_observed": "line_no bigint, owner string, score double, author string",
    "team_drift": "line_no bigint, team string, status string, coverage double, inactive string, outside string",
    "manual_review": "line_no bigint, pattern string, kind string, delta double, hidden_line bigint",
    "star_owners": "owner string",
    "finding_levels": "rule string, path string, owners string, check_name string, level string, blocks boolean",
    "report_rows": "rule string, level string, path string, line_no bigint, message string",
    "actionable": "drift bigint, critical bigint, decay bigint, actionable boolean",
    "decay_digest": "status string, reports bigint, left_out bigint, longest bigint",
    "balance_digest": "band string, reviewers bigint, reviews bigint, waiting bigint",
    "risk_labels": "path string, churn string, first_reason string, strong_reasons bigint",
    "worst_risk": "path string, risk bigint, tier string",
    "criticality_known": "critical bigint, coupled bigint, unavailable boolean",
    "last_activity": "path string, days bigint",
    "affected_paths": "path string, before_owner string, after_owner string, before_count bigint, after_count bigint",
    "removal_distribution": "before_mean double, after_mean double, before_most double, after_most double, before_concentrated bigint, after_concentrated bigint, before_paths bigint, after_paths bigint",
    "person_best": "author string, path string, score double, commits bigint",
    "nearest_owners": "path string, dir string, owner string",
    "nested_owners": "path string, dir string, line bigint, owner string",
    "layer_rows": "top string, declared_local string, declared_global string, observed string",
    "attribute_values": "path string, attr string, value boolean",
    "linguist_excluded": "path string",
    "dependencies": "dependent string, dependency string",
    "orphan_dependents": "path string, dependents bigint",
    "prerequisites": "path string, prerequisite string",
    "onboarding_complexity": "path string, step bigint, complexity string",
    "knowledge_edges": "src string, dst string, relations string",
    "identity_matches": "query string, author string",
    "resolved": "identity string, handle string, source string, factor double",
    "unresolved": "identity string, email string",
    "merges": "handle string, first_identity string, identity string, source string",
    "audit_identities": "identity string, email string, override_handle string, state string",
    "outsider_blame": "author string, share double",
    "threshold_knobs": "below_threshold bigint, best_below double, beyond_top bigint, without_review bigint",
    "review_criticality": "author string, criticality double",
    "team_resolution": "author string, team string",
    "dirty_paths": "path string, state string",
    "reused_share": "paths bigint, reused bigint, share double",
    "mixed_blame": "path string, author string, share double, state string",
    "review_window": "reviewer string, pulls bigint",
    "repo_truck_factors": "quantile double, people bigint",
    "cached_handles": "identity string, handle string, state string",
}
