"""Ticks to bars, bars to coarser bars, and bar spacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import micros
from barloom.functions.timeframes import MINUTES, TimeframeError, bucket_start, minutes
from barloom.operators.positions import KEY, with_gap, with_position
from barloom.operators.ranks import exact_percentile

PRICES = ("open", "high", "low", "close")


def _arrival(ticks: DataFrame, tie: Sequence[str]) -> Column:
    """Order of ticks: `ts`, then `tie`.

    A time, or a time and one integer packed into a decimal, has a fixed width, which
    lets Spark aggregate by hash; a struct makes it sort every input partition.
    """
    types = dict(ticks.dtypes)
    if not tie:
        return F.col("ts")
    if len(tie) == 1 and types[tie[0]] in ("int", "bigint"):
        step = F.lit("20000000000000000000").cast("decimal(20,0)")  # above the bigint range
        whole = micros("ts").cast("decimal(18,0)") * step + F.col(tie[0]).cast("decimal(19,0)")
        return whole.cast("decimal(38,0)")
    return F.struct("ts", *tie)


def tick_bars(
    ticks: DataFrame,
    timeframe: str,
    keys: Sequence[str] = KEY,
    tie: Sequence[str] = (),
) -> DataFrame:
    """One bar per non-empty bucket from `ts, price[, volume]` rows.

    Each tick counts 1 where there is no volume column. `tie` orders ticks with
    equal `ts`; without it the time order alone must be unique.
    """
    volume = F.col("volume") if "volume" in ticks.columns else F.lit(1.0)
    return (
        ticks.select(
            *keys,
            bucket_start("ts", timeframe).alias("_start"),
            _arrival(ticks, tie).alias("_order"),
            "price",
            volume.alias("_volume"),
        )
        .groupBy(*keys, "_start")
        .agg(
            F.min_by("price", "_order").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_order").alias("close"),
            F.coalesce(F.sum("_volume"), F.lit(0.0)).alias("volume"),
        )
        .withColumnRenamed("_start", "ts")
    )


def resample(bars: DataFrame, source: str, target: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Coarser bars; equal spacing returns the input, finer is refused."""
    if minutes(target) < minutes(source):
        raise TimeframeError(f"{target} bars cannot be made from {source} bars")
    if target == source:
        return bars
    quotes = [c for c in ("bid", "ask") if c in bars.columns]

    def last_known(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)

    def first_known(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)

    out = (
        bars.withColumn("_start", bucket_start("ts", target))
        .groupBy(*keys, "_start")
        .agg(
            first_known("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            last_known("close"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
            *[last_known(c) for c in quotes],
        )
        .withColumnRenamed("_start", "ts")
    )
    return out.dropna(subset=list(PRICES))


def source_timeframe(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Median gap per instrument, snapped to the nearest spacing (ties: finer)."""
    gaps = with_gap(with_position(bars, keys), keys)
    median = exact_percentile(gaps, keys, "gap_us", [0.5], ["median_gap_us"])
    sizes = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"))
    options = F.array(
        *[
            F.struct(
                F.abs(F.col("median_gap_us") - F.lit(m * 60_000_000.0)).alias("distance"),
                F.lit(m).alias("minutes"),
                F.lit(name).alias("name"),
            )
            for name, m in MINUTES.items()
        ]
    )
    nearest = F.array_min(options).getField("name")
    short = (F.col("n_bars") < 3) | F.col("median_gap_us").isNull()
    return sizes.join(median, list(keys), "left").select(
        *keys,
        "n_bars",
        (F.col("median_gap_us") / 1e6).alias("median_gap_s"),
        F.when(short, F.lit("1min")).otherwise(nearest).alias("timeframe"),
    )
