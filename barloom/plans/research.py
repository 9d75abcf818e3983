"""A complete research run over all instruments: load, folds, evidence, report, log."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from datetime import datetime, timezone
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.bars import resample
from barloom.operators.execution import cost_sensitivity
from barloom.operators.features import feature_matrix
from barloom.operators.folds import assign_folds, detect_leakage
from barloom.operators.positions import with_position
from barloom.operators.reports import cost_curve, fold_averages, signal_evidence
from barloom.operators.risk import risk_report
from barloom.plans.backtest import (
    Research,
    executed_paths,
    final_paths,
    fold_regimes,
    matrix_leaks,
    regime_evidence,
    test_evidence,
    unjudged,
)
from barloom.session import materialized
from barloom.sources.ranges import research_range
from barloom.sources.tables import append_experiments


class RunResult:
    """Results of all folds of all instruments, each computed when first read.

    Tables that several results read are stored. Instruments too short for a fold are listed
    in `unjudged` and appear nowhere else. `decay` has every horizon, `evidence` the primary one.
    """

    def __init__(self, bars: DataFrame, run: Research):
        self.bars, self.run = bars, run

    @cached_property
    def paths(self) -> DataFrame:
        return materialized(executed_paths(self.bars, self.run))

    @cached_property
    def reports(self) -> DataFrame:
        return risk_report(final_paths(self.paths, self.run), "final_net", "final_position")

    @cached_property
    def costs(self) -> DataFrame:
        return cost_sensitivity(self.paths)

    @cached_property
    def decay(self) -> DataFrame:
        return materialized(test_evidence(self.bars, self.run, self.run.horizons))

    @cached_property
    def evidence(self) -> DataFrame:
        return self.decay.where(F.col("horizon") == self.run.primary_horizon)

    @cached_property
    def regimes(self) -> DataFrame:
        return materialized(fold_regimes(self.bars, self.run))

    @cached_property
    def by_regime(self) -> DataFrame:
        return regime_evidence(self.bars, self.run, self.regimes)

    @cached_property
    def leakage(self) -> DataFrame:
        return detect_leakage(assign_folds(self.bars.select("instrument", "ts", "pos", "n_bars"), self.run.plan, self.run.tail))

    @cached_property
    def unjudged(self) -> DataFrame:
        return unjudged(self.bars, self.run)

    @cached_property
    def averages(self) -> DataFrame:
        return fold_averages(self.reports)

    @cached_property
    def signals(self) -> DataFrame:
        return signal_evidence(self.evidence)

    @cached_property
    def curve(self) -> DataFrame:
        return cost_curve(self.costs)


def load_bars(
    stored: DataFrame, source: str, target: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Bars of a run: coarser spacing first, then the date range, then positions."""
    bars = resample(stored, source, target)
    ranged = research_range(bars, start, end)
    return materialized(with_position(materialized(ranged)))


def run_research(bars: DataFrame, run: Research) -> RunResult:
    """All folds of all instruments in one set of plans; `bars` from `load_bars`."""
    leaking = matrix_leaks(feature_matrix(bars, run.horizons), run)
    if leaking:
        raise ValueError(f"targets among the features: {leaking}")
    return RunResult(bars, run)


def run_rows(result: RunResult) -> DataFrame:
    """The whole result as rows: instrument, part, fold_id, name, regime, level, value.

    `level` is the cost multiplier of costs and the horizon of correlations.
    """

    def rows(df: DataFrame, part: str, names: list[str], fold="fold_id", name=None, regime=None, level=None) -> DataFrame:
        null = F.lit(None)
        values = F.array(*[F.struct((F.col(name) if name else F.lit(n)).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
        return df.select(
            "instrument",
            F.lit(part).alias("part"),
            (F.col(fold) if fold else null).cast("int").alias("fold_id"),
            (F.col(regime) if regime else null).cast("string").alias("regime"),
            (F.col(level) if level else null).cast("double").alias("level"),
            F.inline(values),
        )

    def measures(df: DataFrame, *keys: str) -> list[str]:
        return [c for c in df.columns if c not in ("instrument", "fold_id", *keys)]

    share = result.regimes.groupBy("instrument", "fold_id", "regime").agg(F.count("*").alias("bars"))
    parts = [
        rows(result.reports, "risk", measures(result.reports)),
        rows(result.costs, "costs", measures(result.costs, "cost_multiplier"), level="cost_multiplier"),
        rows(result.decay, "evidence", ["ic"], name="signal", level="horizon"),
        rows(result.by_regime, "evidence_by_regime", ["ic"], name="signal", regime="regime", level="horizon"),
        rows(share, "regimes", ["bars"], regime="regime"),
        rows(result.leakage, "leakage", ["train_bars", "test_bars", "overlap"]),
        rows(result.unjudged, "unjudged", ["n_bars", "needed_bars"], fold=None),
    ]
    return reduce(DataFrame.unionByName, parts)


def log_run(
    result: RunResult, run: Research, store: str, timeframe: str, data_mode: str = "csv", seed: int = 42, extra: dict | None = None
) -> DataFrame:
    """Append one experiment for each judged instrument, written by Spark; returns their ids."""
    run_id = uuid.uuid4().hex
    features = sorted({f for s in run.signals for f in s.needs})
    metrics = F.to_json(F.struct("avg_net_sharpe", "avg_max_drawdown", "n_folds"), {"ignoreNullFields": "false"})
    records = research_summary(result).select(
        F.md5(F.concat_ws(":", F.lit(run_id), "instrument")).alias("experiment_id"),
        "instrument",
        F.lit(timeframe).alias("timeframe"),
        F.lit("ic_weighted_signal_ensemble").alias("model"),
        F.lit(data_mode).alias("data_mode"),
        F.lit(seed).alias("random_seed"),
        F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz").alias("created_at"),
        F.lit(json.dumps(run_settings(run) | (extra or {}), default=str)).alias("config"),
        metrics.alias("metrics"),
        F.array(*map(F.lit, features)).alias("features"),
    )
    records = materialized(records)
    append_experiments(records, store)
    return records.select("experiment_id", "instrument")


def research_summary(result: RunResult) -> DataFrame:
    """One row per instrument, as logged with the experiment."""
    return result.averages.select(
        "instrument",
        "n_folds",
        F.col("avg_sharpe").alias("avg_net_sharpe"),
        "avg_max_drawdown",
    )


def run_settings(run: Research) -> dict:
    """Settings of a run as plain values, for the experiment log."""
    return {
        "prediction_horizons": list(run.horizons),
        "primary_horizon": run.primary_horizon,
        "train_bars": run.plan.train,
        "test_bars": run.plan.test,
        "step_bars": run.plan.step,
        "embargo_bars": run.plan.embargo,
        "execution": asdict(run.costs),
        "risk": asdict(run.limits),
        "signals": [s.name for s in run.signals],
    }
