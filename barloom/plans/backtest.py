"""The walk-forward backtest of all instruments and folds as one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.evaluation import evaluate_signals
from barloom.operators.execution import (
    SLICE,
    Costs,
    Limits,
    cost_sensitivity,
    in_order,
    simulate_execution,
    target_position,
    turnover,
)
from barloom.operators.features import (
    DEFAULT_HORIZONS,
    add_features,
    drop_unscorable,
    feature_matrix,
    future_named,
    target_column,
)
from barloom.operators.folds import TEST, TRAIN, FoldPlan, assign_folds, fold_fits
from barloom.operators.regimes import causal_regimes
from barloom.operators.risk import risk_report, stopped_position, with_drawdown
from barloom.operators.signals import (
    DEFAULT_SIGNALS,
    Signal,
    combine_scores,
    needed_features,
    score_signals,
)

# A train slice shorter than this gives no weights (the fold cannot be judged).
MIN_TRAIN_BARS = 50
BAR_FIELDS = ("ts", "open", "high", "low", "close", "volume", "pos", "n_bars")


@dataclass(frozen=True)
class Research:
    """Settings of one research run."""

    plan: FoldPlan = field(default_factory=FoldPlan)
    horizons: tuple[int, ...] = DEFAULT_HORIZONS
    primary_horizon: int = 5
    costs: Costs = field(default_factory=Costs)
    limits: Limits = field(default_factory=Limits)
    signals: tuple[Signal, ...] = DEFAULT_SIGNALS

    def __post_init__(self):
        if self.primary_horizon not in self.horizons:
            raise ValueError("the primary horizon must be one of the horizons")
        if self.plan.train < MIN_TRAIN_BARS:
            raise ValueError(f"folds need at least {MIN_TRAIN_BARS} train bars")

    @property
    def tail(self) -> int:
        """Last rows of a series, which have no complete targets."""
        return max(self.horizons)


def scored_test(bars: DataFrame, run: Research, extra: Sequence[str] = ()) -> DataFrame:
    """Scored test rows; their features look back over the whole history."""
    keep = sorted({*needed_features(run.signals), "realized_vol_20", *extra})
    matrix = feature_matrix(bars, run.horizons, keep=keep)
    folded = assign_folds(matrix, run.plan, run.tail, roles=[TEST]).drop("role")
    return score_signals(folded, SLICE, bounded=True, signals=run.signals)


def scored_train(bars: DataFrame, run: Research) -> DataFrame:
    """Scored train rows; features restart at the slice and see nothing outside."""
    rows = bars.select("instrument", *BAR_FIELDS)
    folded = assign_folds(rows, run.plan, run.tail, roles=[TRAIN]).drop("role")
    horizons = sorted({*DEFAULT_HORIZONS, run.primary_horizon})
    wide = add_features(folded, SLICE, horizons, keep=needed_features(run.signals))
    return score_signals(
        drop_unscorable(wide, horizons), SLICE, bounded=True, signals=run.signals
    )


def train_evidence(bars: DataFrame, run: Research) -> DataFrame:
    """Correlation of every signal on its train slice, at the primary horizon."""
    return evaluate_signals(
        scored_train(bars, run), SLICE, ["pos"], [run.primary_horizon], True, run.signals
    )


def signal_weights(evidence: DataFrame) -> DataFrame:
    """Positive significant correlations weigh in; everything else weighs 0."""
    weight = F.when(F.col("significant"), F.greatest(F.col("ic"), F.lit(0.0)))
    return evidence.select(*SLICE, "signal", F.coalesce(weight, F.lit(0.0)).alias("weight"))


def _wide_weights(weights: DataFrame, signals: Sequence[Signal]) -> DataFrame:
    columns = [
        f"max(CASE WHEN signal = '{s.name}' THEN weight END) AS weight_{s.name}" for s in signals
    ]
    return weights.groupBy(*SLICE).agg(*map(F.expr, columns))


def executed_paths(bars: DataFrame, run: Research) -> DataFrame:
    """Per test bar: combined score, desired and held position, costed returns."""
    scored = scored_test(bars, run)
    weights = _wide_weights(signal_weights(train_evidence(bars, run)), run.signals)
    combined = combine_scores(scored, weights, SLICE, run.signals)
    desired = target_position("combined_score", "realized_vol_20", run.limits)
    fields = ["instrument", "fold_id", "ts", "pos", "close", "combined_score"]
    wished = combined.withColumn("desired_position", desired).select(*fields, "desired_position")
    return simulate_execution(wished, run.costs)


def final_paths(executed: DataFrame, run: Research) -> DataFrame:
    """Returns after the drawdown stop. The stop looks at pre-stop net returns, and
    the final cost is spread and slippage only."""
    w = in_order()
    stopped = with_drawdown(executed, "net_return").withColumn(
        "final_position", stopped_position("position", run.limits.max_drawdown_stop, w)
    )
    held_before = F.coalesce(F.lag("final_position").over(w), F.lit(0.0))
    charge = run.costs.half_turn(F.col("close"))
    return stopped.withColumns(
        {
            "final_gross": held_before * F.col("bar_return"),
            "final_turnover": turnover("final_position", w),
        }
    ).withColumn("final_net", F.col("final_gross") - F.col("final_turnover") * charge)


def fold_reports(bars: DataFrame, run: Research) -> DataFrame:
    """Risk report per instrument and fold."""
    return risk_report(final_paths(executed_paths(bars, run), run), "final_net", "final_position")


def fold_costs(bars: DataFrame, run: Research) -> DataFrame:
    """Cost table per instrument and fold (paths before the stop)."""
    return cost_sensitivity(executed_paths(bars, run))


def test_evidence(
    bars: DataFrame, run: Research, horizons: Sequence[int] | None = None
) -> DataFrame:
    """Out-of-sample correlation per fold, signal and horizon."""
    return evaluate_signals(
        scored_test(bars, run),
        SLICE,
        ["pos"],
        [run.primary_horizon] if horizons is None else horizons,
        True,
        run.signals,
    )


def fold_regimes(bars: DataFrame, run: Research) -> DataFrame:
    """Regime and posterior of the test bars of each fold, under the mixture of its train slice."""
    rows = bars.select("instrument", *BAR_FIELDS)
    slices = (assign_folds(rows, run.plan, run.tail, roles=[role]).drop("role") for role in (TRAIN, TEST))
    return causal_regimes(*slices, SLICE)


def unjudged(bars: DataFrame, run: Research) -> DataFrame:
    """Instruments too short for one fold: their bars, and those that a fold and its targets need."""
    sizes = bars.groupBy("instrument").agg(F.max("n_bars").alias("n_bars"))
    needed = F.lit(run.plan.span + run.tail).cast("long").alias("needed_bars")
    return sizes.where(~fold_fits(F.col("n_bars") - run.tail, run.plan)).select("instrument", "n_bars", needed)


def matrix_leaks(matrix: DataFrame, run: Research) -> list[str]:
    """Forward-looking columns that a signal reads, or that the matrix holds besides the run's targets."""
    targets = {target_column(h, kind) for h in run.horizons for kind in ("return", "direction")}
    offered = [c for c in matrix.columns if c not in targets]
    return sorted({*future_named(offered), *future_named([f for s in run.signals for f in s.needs])})


def regime_evidence(bars: DataFrame, run: Research, regimes: DataFrame) -> DataFrame:
    """Out-of-sample correlation by regime; `regimes` is keyed by slice and `pos`."""
    labelled = scored_test(bars, run).join(
        regimes.select(*SLICE, "pos", "regime").where(F.col("regime").isNotNull()), [*SLICE, "pos"]
    )
    return evaluate_signals(
        labelled, [*SLICE, "regime"], ["pos"], [run.primary_horizon], True, run.signals
    )
