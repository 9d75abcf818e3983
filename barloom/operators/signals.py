"""Directional signals: a standardized score in [-1, 1] per row of a slice.

A score is the feature's z-score over the whole slice (later bars of the slice
included), clipped at three deviations and divided by three.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import materialized

CLIP = 3.0
TINY = 1e-12


@dataclass(frozen=True)
class Signal:
    """A named score: the features it needs and its raw value as an expression."""

    name: str
    needs: tuple[str, ...]
    raw: str
    sign: int = 1

    @property
    def column(self) -> str:
        return f"score_{self.name}"

    def available(self, columns: Sequence[str]) -> bool:
        return set(self.needs) <= set(columns)


def momentum(lookback: int) -> Signal:
    source = f"momentum_{lookback}"
    return Signal(source, (source,), f"coalesce({source}, 0D)")


def mean_reversion(lookback: int) -> Signal:
    source = f"zscore_{lookback}"
    return Signal(f"mean_reversion_{lookback}", (source,), f"coalesce({source}, 0D)", sign=-1)


def volatility_adjusted(lookback: int) -> Signal:
    source, scale = f"momentum_{lookback}", "vol_ratio_10_50"
    raw = f"coalesce(coalesce({source}, 0D) / (abs(nullif({scale}, 0D)) + 1e-6D), 0D)"
    return Signal(f"vol_adjusted_momentum_{lookback}", (source, scale), raw)


def close_location() -> Signal:
    source = "close_loc_in_range"
    return Signal("microstructure_proxy", (source,), f"coalesce({source}, 0.5D) - 0.5D")


DEFAULT_SIGNALS = (
    momentum(5),
    momentum(20),
    momentum(50),
    mean_reversion(20),
    mean_reversion(50),
    volatility_adjusted(10),
    close_location(),
)


def needed_features(signals: Sequence[Signal] = DEFAULT_SIGNALS) -> list[str]:
    return sorted({f for s in signals for f in s.needs})


def _score(s: Signal) -> str:
    z = f"try_divide(_raw_{s.name} - _m_{s.name}, _s_{s.name} + {TINY!r}D)"
    clipped = f"greatest(least(coalesce({z}, 0D), {CLIP}D), -{CLIP}D) / {CLIP}D * {s.sign}"
    return f"CASE WHEN _n < 2 THEN 0D ELSE {clipped} END AS {s.column}"


def score_signals(
    df: DataFrame,
    slice_keys: Sequence[str],
    bounded: bool,
    signals: Sequence[Signal] = DEFAULT_SIGNALS,
) -> DataFrame:
    """Add `score_<signal>` for every signal whose inputs are present.

    Fold slices are bounded by the plan and use an unordered window. A whole
    series is not: its mean and deviation come from a partial aggregate that is
    joined back (broadcast only when measured to be small).
    """
    usable = [s for s in signals if s.available(df.columns)]
    raws = df.selectExpr("*", *[f"{s.raw} AS _raw_{s.name}" for s in usable])
    over = f" OVER (PARTITION BY {', '.join(slice_keys)})" if bounded else ""
    stats = [f"count(*){over} AS _n"]
    for s in usable:
        stats += [
            f"avg(_raw_{s.name}){over} AS _m_{s.name}",
            f"stddev_samp(_raw_{s.name}){over} AS _s_{s.name}",
        ]
    if bounded:
        measured = raws.selectExpr("*", *stats)
    else:
        raws = materialized(raws)
        figures = raws.groupBy(*slice_keys).agg(*map(F.expr, stats))
        measured = raws.join(figures, list(slice_keys))
    return measured.selectExpr(*df.columns, *[_score(s) for s in usable])


def combine_scores(
    scored: DataFrame, weights: DataFrame, keys: Sequence[str], signals: Sequence[Signal]
) -> DataFrame:
    """Weighted mean of the scores, 0 where no signal has weight.

    `weights` has one row per slice with a `weight_<signal>` column each; signals
    without a score or a weight column count as having none.
    """
    present = [s for s in signals if s.column in scored.columns and f"weight_{s.name}" in weights.columns]
    parts = {s.column: f"coalesce(weight_{s.name}, 0D)" for s in present}
    total = " + ".join(parts.values()) or "0D"
    blended = " + ".join(f"{column} * {part}" for column, part in parts.items()) or "0D"
    combined = f"CASE WHEN {total} > 0 THEN ({blended}) / ({total}) ELSE 0D END AS combined_score"
    return scored.join(weights, list(keys), "left").selectExpr(*scored.columns, combined)
