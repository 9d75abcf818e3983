"""Market regimes: Gaussian mixtures over return, volatility and trend.

All groups (instruments, or train slices) are fitted together: one pass of
expectation-maximization is one grouped aggregate over all their bars, joined to
one parameter row per group. The mixture has a diagonal covariance. Fitting on a
train slice and applying to the test slice uses nothing from the test period.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from barloom.operators.features import add_features, feature_matrix
from barloom.operators.positions import KEY
from barloom.session import materialized

INPUTS = ("ret", "vol", "trend")
REGULAR = 1e-6
ROOT_20 = math.sqrt(20)

# What makes a component volatile or trending.
HIGH_VOL_FACTOR, TREND_LIMIT = 1.3, 1e-5

_NEEDED = ["log_return_1", "realized_vol_20", "momentum_20"]


def _as_inputs(wide: DataFrame, kept: Sequence[str]) -> DataFrame:
    """20-bar deviation and mean of the log return, without the warm-up rows."""
    return wide.select(
        *kept,
        F.col("log_return_1").alias("ret"),
        (F.col("realized_vol_20") / ROOT_20).alias("vol"),
        (F.col("momentum_20") / 20).alias("trend"),
    ).dropna(subset=list(INPUTS))


def series_inputs(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Inputs of whole series (`pos` must be present)."""
    wide = feature_matrix(bars, (), dropna=False, keep=_NEEDED)
    return _as_inputs(wide, [*keys, "ts", "pos"])


def slice_inputs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs that restart with each slice, so its first 20 rows have none."""
    return _as_inputs(add_features(rows, keys, keep=_NEEDED), [*keys, "ts", "pos"])


def _start(k: int) -> str:
    """Components evenly on a circle of volatility and trend, in deviations."""
    rows = []
    for i in range(k):
        turn = 2 * math.pi * i / k
        rows.append(
            f"named_struct('w', {1.0 / k!r}D, 'm', array(0D, {math.cos(turn)!r}D, {math.sin(turn)!r}D),"
            " 'v', array(1D, 1D, 1D))"
        )
    return f"array({', '.join(rows)})"


def _with_posterior(df: DataFrame, k: int) -> DataFrame:
    """Add `_p`, the posterior of each component, and `_l`, the log-likelihood but for a constant,
    from `_c` and the scaled inputs."""
    scores = []
    for i in range(k):
        terms = [
            f"(ln(_c[{i}].v[{d}]) + pow(_z{d} - _c[{i}].m[{d}], 2) / _c[{i}].v[{d}]) / 2"
            for d in range(3)
        ]
        scores.append(f"ln(_c[{i}].w) - {' - '.join(terms)}")
    scored = df.selectExpr("*", f"array({', '.join(scores)}) AS _s")
    raised = scored.selectExpr("*", "transform(_s, x -> exp(x - array_max(_s))) AS _u")
    total = " + ".join(f"_u[{i}]" for i in range(k))
    found = raised.selectExpr("*", f"transform(_u, x -> x / ({total})) AS _p", f"array_max(_s) + ln({total}) AS _l")
    return found.drop("_s", "_u")


#: Passes at most, and the change of the mean log-likelihood below which a group is settled.
PASSES, TOLERANCE = 100, 1e-3


def fit_regimes(
    inputs: DataFrame, keys: Sequence[str], k: int = 4, iterations: int = PASSES, tolerance: float = TOLERANCE
) -> DataFrame:
    """Mixture per group: its scale and its named components, one row each.

    A pass is one grouped aggregate over the bars of all groups that aren't settled; settled
    ones leave the passes. Every pass ends in a written parameter table, so plans stay one pass
    long and nothing is replayed when an executor is lost; how many groups are left is observed
    on that write.
    """
    scale = materialized(
        inputs.groupBy(*keys).agg(
            *[F.avg(c).alias(f"_m{d}") for d, c in enumerate(INPUTS)],
            *[F.stddev_pop(c).alias(f"_s{d}") for d, c in enumerate(INPUTS)],
        )
    )
    scaled = materialized(
        inputs.join(scale, list(keys)).selectExpr(
            *keys, *[f"coalesce(try_divide({c} - _m{d}, _s{d}), 0D) AS _z{d}" for d, c in enumerate(INPUTS)]
        )
    )
    params = scale.selectExpr(*keys, f"{_start(k)} AS _c", "CAST(NULL AS double) AS _ll")
    settled: list[DataFrame] = []
    for _ in range(iterations):
        before = params.withColumnRenamed("_ll", "_before")
        weighed = _with_posterior(scaled.join(before, list(keys)), k)
        sums = [F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_l").alias("_ll"), F.first("_before").alias("_before")]
        for i in range(k):
            share = F.col("_p")[i]
            sums.append(F.sum(share).alias(f"_r{i}"))
            for d in range(3):
                z = F.col(f"_z{d}")
                sums += [F.sum(share * z).alias(f"_a{i}{d}"), F.sum(share * z * z).alias(f"_b{i}{d}")]
        moments = weighed.groupBy(*keys).agg(*sums)
        updated = []
        for i in range(k):
            means = [f"_a{i}{d} / (_r{i} + 1e-10)" for d in range(3)]
            spreads = [
                f"greatest(_b{i}{d} / (_r{i} + 1e-10) - pow({means[d]}, 2), 0D) + {REGULAR!r}D"
                for d in range(3)
            ]
            updated.append(
                f"named_struct('w', (_r{i} + 1e-10) / _n, 'm', array({', '.join(means)}),"
                f" 'v', array({', '.join(spreads)}))"
            )
        moved = moments.selectExpr(
            *keys, f"array({', '.join(updated)}) AS _c", "_ll", f"coalesce(abs(_ll - _before) < {tolerance!r}D, false) AS _done"
        )
        left = Observation()
        found = materialized(moved.observe(left, F.count_if(~F.col("_done")).alias("open")))
        settled.append(found.where("_done").drop("_done", "_ll"))
        params = found.where("NOT _done").drop("_done")
        if not left.get["open"]:
            break
    for part in settled:
        params = params.unionByName(part, allowMissingColumns=True)
    return _named(params.drop("_ll").join(scale, list(keys)), keys, k)


def _named(params: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Describe each component by its unscaled mean volatility and trend."""
    parts = [
        f"named_struct('component', {i}, 'vol', _c[{i}].m[1] * _s1 + _m1, 'trend', _c[{i}].m[2] * _s2 + _m2)"
        for i in range(k)
    ]
    long = params.selectExpr("*", f"inline(array({', '.join(parts)}))")
    group = Window.partitionBy(*keys)
    top = F.max_by("component", F.struct("vol", -F.col("component"))).over(group)
    volatile = (F.col("component") == top) & (
        F.col("vol") > F.percentile("vol", 0.5).over(group) * HIGH_VOL_FACTOR
    )
    name = (
        F.when(volatile, "high_vol")
        .when(F.col("trend") > TREND_LIMIT, "trend_up")
        .when(F.col("trend") < -TREND_LIMIT, "trend_down")
        .otherwise("mean_revert")
    )
    repeat = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("component"))
    column = F.when(F.col("_i") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("_i").cast("string")))
    numbered = long.withColumn("name", name).withColumn("_i", repeat).withColumn("column", column)
    listed = F.sort_array(F.collect_list(F.struct("component", "name", "column", "vol", "trend")))
    fixed = [c for c in params.columns if c not in keys]
    return numbered.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in fixed], listed.alias("components")
    )


def apply_regimes(inputs: DataFrame, fitted: DataFrame, keys: Sequence[str], k: int = 4) -> DataFrame:
    """Label and posterior of every input row under its group's fitted mixture."""
    joined = inputs.join(fitted, list(keys)).selectExpr(
        *inputs.columns,
        "_c",
        "components",
        *[f"coalesce(try_divide({c} - _m{d}, _s{d}), 0D) AS _z{d}" for d, c in enumerate(INPUTS)],
    )
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    return (
        _with_posterior(joined, k)
        .withColumn("component", best)
        .select(
            *inputs.columns,
            "component",
            F.get("components", F.col("component")).getField("name").alias("regime"),
            F.map_from_arrays(F.transform("components", lambda c: c.getField("column")), "_p").alias(
                "probabilities"
            ),
        )
    )


def detect_regimes(
    bars: DataFrame, keys: Sequence[str] = KEY, k: int = 4, iterations: int = PASSES
) -> DataFrame:
    """Fit and label the same whole series. Exploratory: the fit sees later bars."""
    inputs = materialized(series_inputs(bars, keys))
    labelled = apply_regimes(inputs, fit_regimes(inputs, keys, k, iterations), keys, k)
    return labelled.withColumn("causal", F.lit(False))


def causal_regimes(
    train: DataFrame, test: DataFrame, keys: Sequence[str], k: int = 4, iterations: int = PASSES
) -> DataFrame:
    """Fit on train slices, label the bars of the test slices."""
    fitted = fit_regimes(materialized(slice_inputs(train, keys)), keys, k, iterations)
    labelled = apply_regimes(slice_inputs(test, keys), fitted, keys, k)
    return labelled.withColumn("causal", F.lit(True))


def current_regime(labelled: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Regime and posterior at the last bar of each instrument."""
    last: Column = F.max_by(F.struct("ts", "regime", "probabilities"), "ts").alias("_last")
    return labelled.groupBy(*keys).agg(last).select(*keys, "_last.*")
