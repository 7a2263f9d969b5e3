"""Thresholds and windows that the reports share."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """Every adjustable number of the reports, with its default."""

    loyal_visits: int = 3
    repeat_visits: int = 2
    spender_share: float = 0.25
    risk_factor: float = 2.0
    churn_factor: float = 3.0
    unknown_age: str = "Unknown"
    default_year: int = 2021
    actuals_start: str = "2021-05-01"
    actuals_end: str = "2022-04-30"
    forecast_start: str = "2021-05-01"
    forecast_end: str = "2022-05-30"


DEFAULT_RULES = Rules()
