"""Queries the bench times: registered ones, and some on finer bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.catalogue.common import placed_bars
from barloom.operators.features import feature_matrix
from barloom.operators.folds import FoldPlan
from barloom.plans.backtest import Research
from barloom.plans.research import research_summary, run_research


def features_5min(spark: SparkSession, sf: str) -> DataFrame:
    """All 34 features and 8 targets of 5-minute bars."""
    return feature_matrix(placed_bars(spark, sf, "5min"))


def research_5min(spark: SparkSession, sf: str) -> DataFrame:
    """The whole research run on 5-minute bars with the default fold sizes."""
    run = Research(plan=FoldPlan())
    return research_summary(run_research(placed_bars(spark, sf, "5min"), run))


HEADLINE = {
    "tick_bars_5min": None,
    "resample_with_quotes": None,
    "normalize_bars": None,
    "features_5min": features_5min,
    "signal_scores": None,
    "information_coefficient": None,
    "rolling_ic": None,
    "fold_risk_reports": None,
    "research_5min": research_5min,
    "execution_reports": None,
    "regime_labels": None,
    "ingest_headerless": None,
}
