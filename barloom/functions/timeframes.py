"""The seven bar spacings and their bucket arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported bar spacings in minutes, finest first.
MINUTES = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "1h": 60, "4h": 240, "1d": 1440}


class TimeframeError(ValueError):
    """An unknown spacing, or a request for bars finer than the source."""


def minutes(timeframe: str) -> int:
    if timeframe not in MINUTES:
        raise TimeframeError(f"unsupported timeframe {timeframe!r}")
    return MINUTES[timeframe]


def bucket_start(ts: str | Column, timeframe: str) -> Column:
    """Start of the UTC-aligned bucket holding `ts`."""
    return F.window(ts, f"{minutes(timeframe)} minutes").getField("start")


def allowed_targets(source: str | None) -> list[str]:
    """Spacings that can be derived from `source` (1 h is assumed when unknown)."""
    floor = MINUTES.get(source or "", 60)
    return [name for name, m in MINUTES.items() if m >= floor]


def allowed_targets_column(source: str | Column) -> Column:
    """Column form of `allowed_targets`, for a table of datasets."""
    names = F.array(*[F.lit(n) for n in MINUTES])
    return F.filter(names, lambda n: minutes_column(n) >= F.coalesce(minutes_column(source), F.lit(60)))


def minutes_column(timeframe: str | Column) -> Column:
    """NULL for names outside the list, as `element_at` on a missing key."""
    col = F.col(timeframe) if isinstance(timeframe, str) else timeframe
    pairs = [F.lit(x) for item in MINUTES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col)
