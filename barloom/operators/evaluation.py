"""Signal evidence: rank correlation with forward returns and its significance."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.student_t import two_sided_p
from barloom.operators.features import target_column
from barloom.operators.positions import CHUNK_ROWS, KEY, with_halo, with_position
from barloom.operators.ranks import spearman_matrix
from barloom.operators.signals import DEFAULT_SIGNALS, Signal
from barloom.session import materialized

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_PAIRS = 30
LEVEL = 0.05


def with_significance(df: DataFrame, rho: str = "rho", n: str = "n_obs") -> DataFrame:
    """Turn raw correlations into `ic, p_value, significant`; NULL below 30 pairs."""
    enough = F.col(n) >= MIN_PAIRS
    ic = F.when(enough, F.greatest(F.least(F.col(rho), F.lit(1.0)), F.lit(-1.0)))
    rest = 1 - F.col("ic") * F.col("ic")
    t = F.when(rest <= 0, F.lit(float("inf"))).otherwise(
        F.abs("ic") * F.sqrt(ratio((F.col(n) - 2).cast("double"), rest))
    )
    return (
        df.withColumn("ic", F.when(F.col(rho).isNotNull(), ic))
        .drop(rho)
        .withColumn("p_value", two_sided_p(F.when(F.col("ic").isNotNull(), t), F.col(n) - 2))
        .withColumn("significant", F.coalesce(F.col("p_value") < LEVEL, F.lit(False)))
    )


def information_coefficient(
    df: DataFrame,
    keys: Sequence[str],
    row: Sequence[str],
    score: str,
    forward: str,
    bounded: bool,
) -> DataFrame:
    """Rank correlation of one score with one forward return over complete pairs.

    Groups without any complete pair still get a row, with `n_obs` 0.
    """
    df = df.select(*keys, *row, score, forward)
    df = df if bounded else materialized(df)
    present = F.col(score).isNotNull() & F.col(forward).isNotNull()
    sizes = df.groupBy(*keys).agg(F.count_if(present).alias("n_obs"))
    found = spearman_matrix(df, keys, row, [score], [forward], bounded).drop("x", "y", "n_obs")
    return with_significance(sizes.join(found, list(keys), "left"))


def evaluate_signals(
    scored: DataFrame,
    keys: Sequence[str],
    row: Sequence[str],
    horizons: Sequence[int],
    bounded: bool,
    signals: Sequence[Signal] = DEFAULT_SIGNALS,
    p_values: bool = True,
) -> DataFrame:
    """Every signal at every horizon: `keys, signal, horizon, ic, n_obs, ...`.

    `scored` comes from a feature matrix without NULL targets, so each column is
    ranked once for all pairs; signals without a score are skipped. With a regime label among the keys this is the
    correlation by regime; over several horizons it is the decay curve.
    """
    xs = [s.column for s in signals if s.column in scored.columns]
    ys = [target_column(h) for h in horizons]
    found = spearman_matrix(scored, keys, row, xs, ys, bounded).select(
        *keys,
        F.regexp_replace("x", "^score_", "").alias("signal"),
        F.regexp_extract("y", r"(\d+)$", 1).cast("int").alias("horizon"),
        "n_obs",
        "rho",
    )
    if p_values:
        return with_significance(found)
    return found.withColumn("ic", F.when(F.col("n_obs") >= MIN_PAIRS, F.col("rho"))).drop("rho")


def _average_ranks(windows: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis of a stack of equally long windows."""
    order = np.argsort(windows, axis=1, kind="stable")
    ordered = np.take_along_axis(windows, order, axis=1)
    n = windows.shape[1]
    index = np.broadcast_to(np.arange(n), windows.shape)
    starts = np.ones(windows.shape, bool)
    starts[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.maximum.accumulate(np.where(starts, index, 0), axis=1)
    ends = np.ones(windows.shape, bool)
    ends[:, :-1] = starts[:, 1:]
    last = np.minimum.accumulate(np.where(ends, index, n)[:, ::-1], axis=1)[:, ::-1]
    ranks = np.empty(windows.shape)
    np.put_along_axis(ranks, order, (first + last) / 2.0, axis=1)
    return ranks


def rolling_ic(
    df: DataFrame,
    score: str,
    forward: str,
    window: int = 250,
    keys: Sequence[str] = KEY,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rank correlation over the last `window` complete pairs of each row.

    NULL before the window is full and where either side is constant. Expanding
    each row into its windows would shuffle `window` copies of the data, so each
    chunk (with the rows before it) slides over arrays instead.
    """
    complete = df.select(*keys, "ts", score, forward).dropna(subset=[score, forward])
    placed = with_halo(with_position(complete, keys), back=window - 1, chunk_rows=chunk_rows)
    stack = 4096  # windows ranked at a time inside a task

    def slide(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("pos")
        x, y = chunk[score].to_numpy(float), chunk[forward].to_numpy(float)
        rho = np.full(len(chunk), np.nan)
        for start in range(window - 1, len(chunk), stack):
            rows = slice(start - window + 1, min(start + stack, len(chunk)))
            a = _average_ranks(np.lib.stride_tricks.sliding_window_view(x[rows], window))
            b = _average_ranks(np.lib.stride_tricks.sliding_window_view(y[rows], window))
            a -= a.mean(axis=1, keepdims=True)
            b -= b.mean(axis=1, keepdims=True)
            scale = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            with np.errstate(invalid="ignore", divide="ignore"):
                rho[start : rows.stop] = np.where(scale > 0, (a * b).sum(axis=1) / scale, np.nan)
        chunk["ic"] = pd.Series(rho, index=chunk.index).astype(object).where(~np.isnan(rho), None)
        return chunk.loc[chunk["_core"], [*keys, "ts", "pos", "ic"]]

    types = dict(placed.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "ts", "pos"]) + ", ic double"
    return placed.groupBy(*keys, "_chunk").applyInPandas(slide, schema)


#: Rows drawn at a time, and groups whose sums a task holds at a time.
DRAWN, HELD = 256, 64


def _resample_counts(row: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """How often a resample (column) holds a row: Poisson(1) from a hash of both."""
    prime = 2_147_483_647
    mixed = np.fmod(np.fmod(row, prime)[:, None] * 48_271 + draw[None, :] * 69_621 + seed, prime)
    for factor, shift in ((16_807, 7), (40_692, 13), (39_373, 29)):
        mixed = np.fmod(np.fmod(mixed * mixed, prime) + mixed * factor + shift + draw[None, :], prime)
    # Poisson(1) distribution function at 0, 1, 2, ...
    cdf = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(12)])
    return np.searchsorted(cdf, mixed / float(prime), "left")


def _resample_sums(rows: DataFrame, keys: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """keys, _draw, _sum, _times: each task adds its rows up into two vectors per group."""
    draw = np.arange(resamples, dtype=np.int64)

    def packed(held):
        parts = [
            pd.DataFrame({**dict(zip(keys, key)), "_draw": draw, "_sum": s, "_times": t}) for key, (s, t) in held.items()
        ]
        return pd.concat(parts, ignore_index=True)

    def add_up(batches):
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(list(keys), sort=False, dropna=False):
                sums, times = held.setdefault(key, (np.zeros(resamples), np.zeros(resamples, np.int64)))
                row, value = part["_row"].to_numpy(np.int64), part["_value"].to_numpy(float)
                for i in range(0, len(part), DRAWN):
                    counts = _resample_counts(row[i : i + DRAWN], draw, seed)
                    sums += value[i : i + DRAWN] @ counts
                    times += counts.sum(axis=0)
                if len(held) >= HELD:
                    yield packed(held)
                    held = {}
        if held:
            yield packed(held)

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _draw bigint, _sum double, _times bigint"
    return rows.mapInPandas(add_up, schema)


def bootstrap_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    row: str,
    resamples: int = 2000,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Mean with a percentile bootstrap interval.

    Each row enters each resample a Poisson(1) number of times, drawn from a hash
    of (row, resample, seed). A row is never copied: its counts are added to one vector of sums
    per group, and `resamples` sums per group and task are what moves.
    """
    clean = df.where(F.col(value).isNotNull())
    rows = clean.select(*keys, F.col(row).cast("bigint").alias("_row"), F.col(value).cast("double").alias("_value"))
    means = (
        _resample_sums(rows, keys, resamples, seed)
        .groupBy(*keys, "_draw")
        .agg(ratio(F.sum("_sum"), F.sum("_times")).alias("_mean"))
    )
    tails = [(1 - level) / 2, (1 + level) / 2]
    bounds = means.groupBy(*keys).agg(F.percentile("_mean", F.array(*map(F.lit, tails))).alias("_b"))
    centre = clean.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return centre.join(bounds, list(keys)).select(
        *keys, "mean", F.col("_b")[0].alias("lower"), F.col("_b")[1].alias("upper")
    )


def sharpe_significance(
    df: DataFrame, keys: Sequence[str], returns: str, periods_per_year: int = 252
) -> DataFrame:
    """Annualized Sharpe ratio with a t test of the mean; NULL below 10 returns."""
    stats = df.groupBy(*keys).agg(
        F.count(returns).alias("n"),
        F.avg(returns).alias("_mean"),
        F.stddev_samp(returns).alias("_sd"),
    )
    enough = F.col("n") >= 10
    score = ratio("_mean", "_sd")
    return (
        stats.withColumn("sharpe", F.when(enough, score * float(np.sqrt(periods_per_year))))
        .withColumn("t_stat", F.when(enough, score * F.sqrt("n")))
        .withColumn("p_value", two_sided_p(F.abs("t_stat"), F.col("n") - 1))
        .drop("_mean", "_sd")
    )


def bonferroni(df: DataFrame, family: Sequence[str], p: str = "p_value") -> DataFrame:
    """Multiply each p-value by the number of non-NULL ones in its family, at most 1."""
    tests = F.count(p).over(Window.partitionBy(*family))
    corrected = F.when(F.col(p).isNotNull(), F.least(F.col(p) * tests, F.lit(1.0)))
    return df.withColumn("p_corrected", corrected)
