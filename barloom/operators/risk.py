"""Drawdown paths, the drawdown stop and the risk report."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import null_if_zero, ratio
from barloom.operators.execution import SLICE, in_order
from barloom.operators.positions import CHUNK_ROWS
from barloom.operators.ranks import exact_percentile

ANNUAL = math.sqrt(252)


def _growth(returns: str) -> Column:
    return 1 + F.coalesce(F.col(returns), F.lit(0.0))


def with_drawdown(
    df: DataFrame,
    returns: str,
    keys: Sequence[str] = SLICE,
    bounded: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add `equity` (running product of 1 + r) and `drawdown` below its running peak.

    A whole series is cut into chunks: paths run inside chunks, and only one
    product and one peak per chunk are carried along the series.
    """
    so_far = (Window.unboundedPreceding, 0)
    if bounded:
        w = in_order(keys).rowsBetween(*so_far)
        path = df.withColumn("equity", F.product(_growth(returns)).over(w))
        peak = F.max("equity").over(w)
        return path.withColumn("drawdown", F.col("equity") / peak - 1)
    marked = df.withColumn("_chunk", F.floor(F.col("pos") / chunk_rows))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("pos").rowsBetween(*so_far)
    local = marked.withColumn("_local", F.product(_growth(returns)).over(inside)).withColumn(
        "_top", F.max("_local").over(inside)
    )
    ends = local.groupBy(*keys, "_chunk").agg(
        F.max_by("_local", "pos").alias("_end"), F.max("_top").alias("_high")
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.withColumn("_carry", F.coalesce(F.product("_end").over(earlier), F.lit(1.0)))
        .withColumn("_peak", F.max(F.col("_carry") * F.col("_high")).over(earlier))
        .select(*keys, "_chunk", "_carry", "_peak")
    )
    joined = local.join(carried, [*keys, "_chunk"])
    equity = F.col("_local") * F.col("_carry")
    peak = F.greatest(F.col("_top") * F.col("_carry"), F.col("_peak"))
    return joined.select(*df.columns, equity.alias("equity"), (equity / peak - 1).alias("drawdown"))


def stopped_position(position: str, limit: float, w: Window) -> Column:
    """Flat while the drawdown is at or beyond the limit, and on the bar after."""
    hit = F.col("drawdown") <= -limit
    return F.when(hit | F.coalesce(F.lag(hit).over(w), F.lit(False)), F.lit(0.0)).otherwise(
        F.col(position)
    )


def risk_report(
    df: DataFrame,
    returns: str,
    position: str | None = None,
    keys: Sequence[str] = SLICE,
    bounded: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row of risk figures per slice."""
    r = F.col(returns)
    path = with_drawdown(df, returns, keys, bounded, chunk_rows)
    if bounded:
        cut = F.percentile(returns, 0.05).over(Window.partitionBy(*keys))
        path = path.withColumn("_cut", cut)
    else:
        cuts = exact_percentile(df, keys, returns, [0.05], ["_cut"])
        path = path.join(cuts, list(keys), "left")
    gains, losses = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))
    downside = F.stddev_samp(F.when(r < 0, r))
    known = F.count(returns) > 0
    columns = [
        (ratio(F.avg(r), null_if_zero(F.stddev_samp(r))) * ANNUAL).alias("sharpe"),
        (ratio(F.avg(r), null_if_zero(downside)) * ANNUAL).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        (F.stddev_samp(r) * ANNUAL).alias("volatility_annualized"),
        (-F.max("_cut")).alias("var_95"),
        (-F.avg(F.when(r <= F.col("_cut"), r))).alias("expected_shortfall_95"),
        F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("hit_rate"),
        F.when(
            known, ratio(F.coalesce(gains, F.lit(0.0)), F.coalesce(losses, F.lit(0.0)))
        ).alias("profit_factor"),
        (F.max_by("equity", "pos") - 1).alias("cumulative_return"),
    ]
    if position is not None:
        path = _with_step(path, position, keys, bounded, chunk_rows)
        columns += [
            F.avg(F.abs(position)).alias("avg_exposure"),
            F.coalesce(F.sum(F.abs("_step")), F.lit(0.0)).alias("turnover"),
        ]
    return path.groupBy(*keys).agg(*columns)


def _with_step(
    df: DataFrame, position: str, keys: Sequence[str], bounded: bool, chunk_rows: int
) -> DataFrame:
    """`_step`: change of the position; NULL on the first row."""
    if bounded:
        return df.withColumn("_step", F.col(position) - F.lag(position).over(in_order(keys)))
    from barloom.operators.positions import chunk_window, core_only, with_halo

    spread = with_halo(df, back=1, chunk_rows=chunk_rows)
    step = F.col(position) - F.lag(position).over(chunk_window(keys))
    return core_only(spread.withColumn("_step", step))
