"""Exact average ranks, rank correlation and percentiles.

Two ways, as the caller knows its groups:

* `bounded=True`: the group is a fold slice, at most train or test bars long by
  configuration. Plain windows over the group.
* Otherwise, for whole series of any size, equal values are counted first (so a value held by a third of all
  rows is one row), the distinct values are sorted in ranges, and only a running sum over
  the ranges spans the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.lookup import running
from barloom.session import materialized


def _ordered_counts(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values per group with `n` and `below` (rows smaller)."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, keys, [value], {"below": F.col("n")}).select(*keys, value, "n", "below")


def exact_percentile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    names: Sequence[str],
) -> DataFrame:
    """Linearly interpolated percentiles, one row per group of any size."""
    ordered = _ordered_counts(df, keys, value)
    size = ordered.groupBy(*keys).agg(F.sum("n").alias("_size"))
    rows = ordered.join(size, list(keys))

    def at(rank: Column) -> Column:
        here = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
        return F.max(F.when(here, F.col(value)))

    picks = []
    for f, name in zip(fractions, names):
        target = (F.col("_size") - 1) * F.lit(float(f))
        picks += [
            at(F.floor(target)).alias(f"_lo_{name}"),
            at(F.ceil(target)).alias(f"_hi_{name}"),
            F.max(target - F.floor(target)).alias(f"_w_{name}"),
        ]
    found = rows.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")
            ).alias(n)
            for n in names
        ],
    )


def average_rank_sql(value: str, keys: Sequence[str]) -> str:
    """Average rank inside a bounded group; one sort serves rank and tie count."""
    w = f"PARTITION BY {', '.join(keys)} ORDER BY {value}"
    ties = f"count(*) OVER ({w} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    return f"rank() OVER ({w}) + ({ties} - 1) / 2D"


def _ranked(
    df: DataFrame,
    keys: Sequence[str],
    row: Sequence[str],
    columns: Sequence[str],
    bounded: bool,
) -> DataFrame:
    out = df.select(*keys, *row, *columns)
    if bounded:
        # One window per step: each needs its own sort of the group.
        for c in columns:
            out = out.selectExpr("*", f"{average_rank_sql(c, keys)} AS _r_{c}")
        return out
    out = materialized(out)
    cells = F.array(
        *[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in columns]
    )
    long = out.select(*keys, *row, F.inline(cells))
    by = [*keys, "_column"]
    ranks = _ordered_counts(long, by, "_value").select(
        *by, "_value", (F.col("below") + (F.col("n") + 1) / 2.0).alias("_rank")
    )
    return (
        long.join(ranks, [*by, "_value"])
        .groupBy(*keys, *row)
        .agg(*[F.max(F.when(F.col("_column") == c, F.col("_rank"))).alias(f"_r_{c}") for c in columns])
    )


def spearman_matrix(
    df: DataFrame,
    keys: Sequence[str],
    row: Sequence[str],
    xs: Sequence[str],
    ys: Sequence[str],
    bounded: bool,
) -> DataFrame:
    """Rank correlation of every x with every y: `keys, x, y, rho, n_obs`.

    Rows with a NULL in any of the columns are left out, so each column is ranked
    once rather than once per pair. A constant column gives NULL.
    """
    complete = df.dropna(subset=[*xs, *ys])
    ranked = _ranked(complete, keys, row, [*xs, *ys], bounded)
    spread = [f"stddev_pop(_r_{c}) AS _sd_{c}" for c in dict.fromkeys([*xs, *ys])]
    joint = [f"covar_pop(_r_{x}, _r_{y}) AS _cov_{x}_{y}" for x in xs for y in ys]
    moments = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), *map(F.expr, [*spread, *joint])
    )
    pairs = ", ".join(
        f"named_struct('x', '{x}', 'y', '{y}', 'rho', try_divide(_cov_{x}_{y}, _sd_{x} * _sd_{y}))"
        for x in xs
        for y in ys
    )
    return moments.selectExpr(*keys, "n_obs", f"inline(array({pairs}))")
