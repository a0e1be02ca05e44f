"""Settings of the forecasting engine, as checked frozen dataclasses."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Study:
    """One forecasting study. Minutes and days are counts; levels are central coverages."""

    bar_minutes: int = 60
    coarse_bars: int = 4
    session_split_minute: int = 720
    half_life_minutes: int = 720
    rolling_bars: int = 24
    history_days: int = 10
    min_history: int = 20
    levels: tuple[float, ...] = (0.9, 0.95, 0.99)
    season_days: int = 20
    season_min_days: int = 5
    season_min_obs: int = 3
    refit_days: int = 5
    block_days: int = 5
    replicates: int = 200
    pit_bins: int = 10
    seed: int = 20260923

    def __post_init__(self):
        if self.bar_minutes < 1 or 1440 % self.bar_minutes or self.session_split_minute % (self.bar_minutes * self.coarse_bars):
            raise ValueError("bars must divide the day and both sessions")
        if not self.levels or any(not 0 < c < 1 for c in self.levels) or list(self.levels) != sorted(set(self.levels)):
            raise ValueError("levels must ascend within (0, 1)")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name != "levels" and (not isinstance(value, int) or value < 1):
                raise ValueError(f"{f.name} must be a positive integer")

    @property
    def decay(self) -> float:
        return 2 ** (-self.bar_minutes / self.half_life_minutes)

    @classmethod
    def from_json(cls, text: str) -> Study:
        """Strict: unknown keys are errors."""
        raw = json.loads(text)
        known = {f.name for f in fields(cls)}
        if unknown := set(raw) - known:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        if "levels" in raw:
            raw["levels"] = tuple(raw["levels"])
        return cls(**raw)


DEFAULT = Study()
