"""Thresholds that change results, and size bounds that only change the plan."""

from __future__ import annotations

from dataclasses import dataclass

# Output caps that belong to the results themselves.
MAX_COLUMNS = 200
MAX_NAME_LENGTH = 200
PREVIEW_ROWS = 100
TOP_VALUES = 10
MAX_CHARTS = 6
MAX_CHARTS_PER_TYPE = 2
MAX_POINTS = 500
MAX_INSIGHTS = 12
MAX_FILTER_RULES = 20
MAX_FILTER_VALUES = 50
MAX_CHART_CATEGORIES = 30
MAX_DONUT_CATEGORIES = 8
MAX_LINE_PERIODS = 120
MAX_HISTOGRAM_BINS = 20
PAIR_NUMERIC = 8
PAIR_CATEGORICAL = 8
PAIR_DATETIME = 4


@dataclass(frozen=True)
class ProfileConfig:
    """Inference thresholds with their allowed ranges.

    ``rank_buffer`` bounds how many entries one task may sort while looking up
    exact order statistics; larger columns are narrowed down by bucket counts first.
    """

    numeric_threshold: float = 0.9
    datetime_threshold: float = 0.9
    categorical_ratio: float = 0.5
    sample_size: int = 5
    rank_buffer: int = 1_000_000

    def __post_init__(self) -> None:
        bounds = {
            "numeric_threshold": (0.5, 1.0),
            "datetime_threshold": (0.5, 1.0),
            "categorical_ratio": (0.0, 1.0),
            "sample_size": (1, 5),
            "rank_buffer": (1, 50_000_000),
        }
        for name, (low, high) in bounds.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}.")
