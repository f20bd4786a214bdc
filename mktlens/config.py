"""Plain, frozen parameter objects (driver side only).

Defaults are the reference's documented defaults; they are fixed values that
must match for equal results.
"""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureConfig:
    sentiment_rolling_days: int = 3
    price_rolling_days: int = 5
    target_horizon_days: int = 1
    min_news_per_day: int = 1

    @property
    def short_window(self) -> int:
        return max(3, self.price_rolling_days)

    @property
    def long_window(self) -> int:
        s = self.short_window
        return max(3 * s, s + 5)


@dataclass(frozen=True)
class NewsConfig:
    max_records: int = 250
    batch_days: int = 7
    inference_window_days: int = 60


@dataclass(frozen=True)
class ModelConfig:
    estimator: str = "random_forest"
    test_size: float = 0.2
    random_state: int = 42
    params: dict = field(default_factory=dict)
    direction_threshold: float = 0.6
    neutral_band: float = 0.05

    # Thresholds are clamped before use.
    @property
    def up_threshold(self) -> float:
        return min(max(float(self.direction_threshold), 0.5), 0.95)

    @property
    def down_threshold(self) -> float:
        return max(0.0, 1.0 - self.up_threshold)

    @property
    def band(self) -> float:
        return max(0.0, min(float(self.neutral_band), 0.2))


def news_window_days(cfg: NewsConfig) -> int:
    """The inference news window is at least a week."""
    return max(7, int(cfg.inference_window_days))
