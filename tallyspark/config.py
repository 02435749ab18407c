"""Engine parameters with their defaults."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Validated once; operators take the numbers they need."""

    window_ids: int = 50
    compete_above: int = 40
    least_per_validator: int = 1
    least_validators: int = 2
    margin: float = 0.02
    stake_exponent: float = 0.25
    pass_score: float = 0.9
    clone_share: float = 0.95
    commit_lock: int = 8_270_310
    commits_after_lock: int = 2
    active_hours: int = 24
    least_stake: float = 0.0
    cycle_length: int = 150
    cycle_offset: int = 15
    cycle_tolerance: int = 2
    least_file_bytes: int = 50 << 20
    rate_limit: int = 100
    rate_window: float = 1800.0
    replay_ttl: float = 300.0

    def __post_init__(self) -> None:
        if not (math.isfinite(self.stake_exponent) and self.stake_exponent >= 0):
            raise ValueError("stake_exponent must be finite and not negative")


DEFAULTS = Settings()
