"""Load modes and the day an incremental run publishes."""

from __future__ import annotations

from datetime import date, timedelta

FULL, INCREMENTAL = "full-refresh", "incremental"


def process_date(value: str | date | None = None) -> date:
    """An ISO date, or today."""
    if value is None:
        return date.today()
    if isinstance(value, date):
        return value
    try:
        return date.fromisoformat(value)
    except ValueError as e:
        raise ValueError(f"not an ISO date: {value!r}") from e


def target_day(value: str | date | None = None) -> date:
    """A run on day D publishes D-1."""
    return process_date(value) - timedelta(days=1)


def check_mode(mode: str) -> str:
    if mode not in (FULL, INCREMENTAL):
        raise ValueError(f"unknown load mode {mode!r}")
    return mode
