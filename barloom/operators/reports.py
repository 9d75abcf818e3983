"""Evidence summaries over folds, and verbal bands for metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.positions import KEY

FOLD_METRICS = (
    "sharpe",
    "sortino",
    "max_drawdown",
    "hit_rate",
    "profit_factor",
    "cumulative_return",
    "turnover",
)
FEW_FOLDS = 5


def evidence_class(ic: Column, n: Column, significant: Column) -> Column:
    unknown = ic.isNull() | n.isNull() | (n < 30)
    return (
        F.when(unknown, "Insufficient sample")
        .when(significant & (F.abs(ic) >= 0.03), "Positive evidence")
        .when(significant, "Weak evidence")
        .otherwise("Insignificant")
    )


def signal_evidence(fold_evidence: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Per signal over folds: mean IC and p, significant folds, sign agreement."""
    by = [*keys, "signal"]
    mean = fold_evidence.groupBy(*by).agg(
        F.avg("ic").alias("avg_ic"),
        F.avg("p_value").alias("avg_p"),
        F.count_if("significant").alias("significant_folds"),
        F.sum("n_obs").alias("total_n"),
        F.count("ic").alias("judged_folds"),
        F.count_if(F.col("ic") > 0).alias("_up"),
        F.count_if(F.col("ic") < 0).alias("_down"),
        F.count_if(F.col("ic") == 0).alias("_flat"),
    )
    agreeing = (
        F.when(F.col("avg_ic") > 0, F.col("_up"))
        .when(F.col("avg_ic") < 0, F.col("_down"))
        .when(F.col("avg_ic") == 0, F.col("_flat"))
        .otherwise(F.lit(0))
    )
    grade = evidence_class(F.col("avg_ic"), F.col("total_n"), F.col("significant_folds") > 0)
    return (
        mean.withColumn("agreeing_folds", agreeing)
        .withColumn("evidence", grade)
        .drop("_up", "_down", "_flat")
    )


def fold_averages(reports: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean of the headline metrics over folds, NULLs left out."""
    return reports.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"),
        (F.count(F.lit(1)) < FEW_FOLDS).alias("few_folds"),
        *[F.avg(m).alias(f"avg_{m}") for m in FOLD_METRICS],
    )


def cost_curve(fold_costs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Cost table averaged over folds."""
    return fold_costs.groupBy(*keys, "cost_multiplier").agg(
        *[F.avg(c).alias(f"avg_{c}") for c in ("gross_sharpe", "net_sharpe", "total_cost_drag")]
    )


def cost_insensitive(curve: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Whether costs hardly matter: flat net Sharpe, or no drag at all."""
    drag = F.abs("avg_total_cost_drag")
    return curve.groupBy(*keys).agg(
        (F.max("avg_net_sharpe") - F.min("avg_net_sharpe")).alias("net_sharpe_spread"),
        F.count("avg_net_sharpe").alias("_known"),
        F.max(drag).alias("max_drag"),
    ).withColumn(
        "cost_insensitive",
        F.coalesce((F.col("_known") > 1) & (F.col("net_sharpe_spread") < 0.001), F.lit(False))
        | F.coalesce(F.col("max_drag") < 1e-9, F.lit(True)),
    ).drop("_known")


# Upper bounds (exclusive) of each label, last label open-ended.
BANDS = {
    "sharpe": [(0, "Negative"), (0.5, "Weak"), (1, "Acceptable"), (2, "Good"), (None, "Strong")],
    "sortino": [
        (0, "Negative"),
        (0.75, "Weak"),
        (1.5, "Acceptable"),
        (2.5, "Good"),
        (None, "Strong"),
    ],
    "profit_factor": [(1, "Losing"), (1.2, "Weak"), (1.5, "Good"), (None, "Strong")],
    "max_drawdown": [(5, "Very Low"), (10, "Low"), (20, "Moderate"), (None, "High")],
    "hit_rate": [(40, "Low"), (50, "Moderate"), (60, "Good"), (None, "High")],
    "ic": [(0.05, "Very Weak"), (0.10, "Weak"), (0.20, "Moderate"), (None, "Strong")],
}
NO_LABEL = "—"


def _banded(x: Column, bands: list) -> Column:
    out = F.when(x.isNull() | F.isnan(x), NO_LABEL)
    for bound, label in bands:
        out = out.otherwise(label) if bound is None else out.when(x < bound, label)
    return out


def metric_band(metric: str, value: str | Column) -> Column:
    """Verbal band of one metric; fractions are judged in percent."""
    x = F.col(value) if isinstance(value, str) else value
    if metric == "p_value":
        return (
            F.when(x.isNull() | F.isnan(x), NO_LABEL)
            .when(x > 0.10, "Weak evidence")
            .when(x > 0.05, "Marginal")
            .when(x > 0.01, "Significant")
            .otherwise("Very Strong evidence")
        )
    if metric == "max_drawdown":
        return _banded(F.abs(x) * 100, BANDS[metric])
    if metric == "hit_rate":
        return _banded(x * 100, BANDS[metric])
    if metric == "ic":
        label = _banded(F.abs(x), BANDS[metric])
        return F.when(x < 0, F.concat(label, F.lit(" (inverse)"))).otherwise(label)
    return _banded(x, BANDS[metric])
