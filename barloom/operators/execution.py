"""From desired exposure to costed returns, on fold slices."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip, null_if_zero, ratio

SLICE = ("instrument", "fold_id")


@dataclass(frozen=True)
class Costs:
    spread_pips: float = 1.2
    slippage_pips: float = 0.3
    commission_per_lot: float = 0.0
    latency_bars: int = 1
    pip_size: float = 0.0001
    max_position: float = 1.0

    def half_turn(self, price: Column) -> Column:
        """Spread and slippage per unit of turnover, in return units."""
        pips = (self.spread_pips + self.slippage_pips) * self.pip_size
        return F.coalesce(ratio(F.lit(pips), price), F.lit(0.0))

    def commission(self, price: Column) -> Column:
        return F.coalesce(ratio(F.lit(self.commission_per_lot), price), F.lit(0.0))


@dataclass(frozen=True)
class Limits:
    target_annual_vol: float = 0.10
    max_position: float = 1.0
    max_drawdown_stop: float = 0.25
    periods_per_year: int = 252


def target_position(signal: str, volatility: str, limits: Limits) -> Column:
    """Signal scaled to a volatility target, capped, 0 where unknown."""
    per_bar = limits.target_annual_vol / math.sqrt(limits.periods_per_year)
    wanted = ratio(F.lit(per_bar), null_if_zero(volatility))
    scale = F.when(wanted.isNotNull(), F.least(wanted, F.lit(limits.max_position * 5)))
    sized = clip(F.col(signal) * scale, -limits.max_position, limits.max_position)
    return F.coalesce(sized, F.lit(0.0))


def in_order(keys: Sequence[str] = SLICE) -> Window:
    return Window.partitionBy(*keys).orderBy("pos")


def held_position(desired: str, costs: Costs, w: Window) -> Column:
    """Exposure actually held: the clipped wish of `latency_bars` ago."""
    wish = clip(desired, -costs.max_position, costs.max_position)
    held = F.lag(wish, costs.latency_bars).over(w) if costs.latency_bars else wish
    return F.coalesce(held, F.lit(0.0))


def price_change(price: str, w: Window) -> Column:
    return F.coalesce(ratio(price, F.lag(price).over(w)) - 1, F.lit(0.0))


def turnover(position: str, w: Window) -> Column:
    return F.abs(F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0.0)))


def simulate_execution(
    df: DataFrame,
    costs: Costs,
    desired: str = "desired_position",
    price: str = "close",
    keys: Sequence[str] = SLICE,
) -> DataFrame:
    """Add `position, gross_return, turnover, cost, net_return`."""
    w = in_order(keys)
    charge = costs.half_turn(F.col(price)) + costs.commission(F.col(price))
    return (
        df.withColumns({"position": held_position(desired, costs, w), "bar_return": price_change(price, w)})
        .withColumns(
            {
                "gross_return": F.coalesce(F.lag("position").over(w), F.lit(0.0))
                * F.col("bar_return"),
                "turnover": turnover("position", w),
            }
        )
        .withColumn("cost", F.col("turnover") * charge)
        .withColumn("net_return", F.col("gross_return") - F.col("cost"))
    )


# Stress levels of the cost table.
STRESS = (0.0, 0.5, 1.0, 2.0, 4.0)


def cost_sensitivity(
    executed: DataFrame, keys: Sequence[str] = SLICE, levels: Sequence[float] = STRESS
) -> DataFrame:
    """Sharpe ratios and totals when every cost is multiplied.

    Costs scale linearly, so the paths of `simulate_execution` serve all levels
    in one aggregate; no path is simulated twice.
    """
    root = math.sqrt(252)
    aggregates = [
        F.avg("gross_return").alias("_gm"),
        F.stddev_samp("gross_return").alias("_gs"),
        F.sum("cost").alias("_cost"),
        F.sum("gross_return").alias("_gross"),
    ]
    for i, level in enumerate(levels):
        net = F.col("gross_return") - F.col("cost") * level
        aggregates += [
            F.avg(net).alias(f"_nm{i}"),
            F.stddev_samp(net).alias(f"_ns{i}"),
            F.sum(net).alias(f"_net{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(float(level)).alias("cost_multiplier"),
                (ratio("_gm", null_if_zero("_gs")) * root).alias("gross_sharpe"),
                (ratio(f"_nm{i}", null_if_zero(f"_ns{i}")) * root).alias("net_sharpe"),
                (F.col("_cost") * level).alias("total_cost_drag"),
                F.col("_gross").alias("gross_cum_return"),
                F.col(f"_net{i}").alias("net_cum_return"),
            )
            for i, level in enumerate(levels)
        ]
    )
    return executed.groupBy(*keys).agg(*aggregates).select(*keys, F.inline(rows))
