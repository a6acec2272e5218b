"""Parameters of an analysis; the defaults are the fixed values of the method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    as_of: str = "2001-08-01 00:00:00"
    lookback_days: int = 365
    min_commits: int = 1
    top_n: int = 3
    threshold: float = 0.3
    blame_override: float = 0.5
    w_recency: float = 0.30
    w_frequency: float = 0.20
    w_blame: float = 0.20
    w_review: float = 0.15
    w_survival: float = 0.15
    half_life: float = 90.0
    half_life_floor: float = 14.0
    half_life_ceiling: float = 730.0
    frequency_prior: float = 3.0
    superseded_cut: float = 0.2
    decay_days: int = 180
    critical_owners: int = 1
    warn_owners: int = 2
    major_share: float = 0.05
    drift_min_delta: float = 0.2
    cochange_cap: int = 20
    merge_percent: int = 5
    squash_percent: int = 50
    mass_floor: int = 20
    mass_fraction: float = 0.8
    mass_refactor: float = 0.5
    periods: int = 6
    period_days: int = 30
    monopoly: float = 0.72
    overload: float = 2.0
    max_increase: float = 0.3
    inferred_criticality: float = 0.8
    miss_days: int = 7
    file_limit: int = 3145728
    rule_file: str = "CODEOWNERS"
    removed: str = "NATION_1"
    target: str = "Brand#1"
    completeness: float = 1.0
    repo_id: str = "example/repo"
