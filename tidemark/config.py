"""Settings of the engine, with the thresholds that its gates use."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class EngineConfig:
    """Boundaries of the training and holdout periods, and every gate's threshold."""

    train_start: date = date(2015, 4, 1)
    train_end: date = date(2024, 11, 30)
    holdout_start: date = date(2025, 3, 1)
    holdout_end: date = date(2025, 11, 30)
    purge_days: int = 7
    folds: int = 5
    min_fold_rows: int = 200
    max_quote_age_seconds: int = 600
    min_coverage: float = 0.85
    high_coverage: float = 0.95
    min_books: int = 2
    stale_after_hours: int = 6
    clip: float = 1e-6
    shrink_strength: float = 20.0
    shrink_cap: float = 60.0
    min_group_rows: int = 50
    drift_gap: float = 0.07
    drift_bin_rows: int = 20
    drift_rows: int = 200
    drift_min_rows: int = 100
    member_gain: float = 0.005
    holdout_log_loss_gain: float = 0.001
    holdout_brier_gain: float = 0.0005
    time_zone: str = "America/New_York"


DEFAULT = EngineConfig()
