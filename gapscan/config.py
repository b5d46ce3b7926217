"""Weights, limits and thresholds of the operators; every default can be replaced."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # fixed values
    line_weight: int = 3
    branch_weight: int = 5
    any_miss_weight: int = 2
    risk_penalty: dict[str, int] = field(default_factory=lambda: {"high": 30, "medium": 10, "low": 0})
    other_risk_penalty: int = 10
    affected_boost: int = 20
    failure_penalty: int = 5
    target_line_weight: int = 2
    target_branch_weight: int = 3
    impact_depth: int = 3
    collaborator_methods: int = 10
    digest_size: int = 8
    import_cap: int = 40
    factor_from: int = 3
    tokens_per_byte: float = 0.25
    chars_per_token: int = 4
    pack_ceiling: int = 4000
    hash_attempts: int = 2
    case_attempts: int = 3
    stall_cycles: int = 2
    fail_rate: float = 0.5
    fail_window: int = 4
    max_cycles: int = 20
    max_minutes: int = 10
    advance_high: float = 0.80
    advance_low: float = 0.50
    errors_kept: int = 200
    evidence_kept: int = 50
    recommendations: int = 5


DEFAULT = Config()
