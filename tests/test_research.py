"""Complete runs: regimes and decay, instruments without a fold, leaks, the log."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.operators.features import feature_matrix, target_column
from barloom.operators.folds import FoldPlan
from barloom.operators.signals import DEFAULT_SIGNALS
from barloom.plans.backtest import Research, matrix_leaks
from barloom.plans.research import load_bars, log_run, run_research, run_rows
from barloom.sources import tables

RUN = Research(plan=FoldPlan(300, 120, 400, 10))


@pytest.fixture(scope="module")
def short_and_long(spark, bars):
    """Two instruments, and one whose series is too short for a fold."""
    kept = [c for c in bars.columns if c not in ("pos", "n_bars")]
    plain = bars.select(*kept)
    short = plain.where("instrument = 'A'").orderBy("ts").limit(200).withColumn("instrument", F.lit("SHORT"))
    return load_bars(plain.unionByName(short), "1h", "1h")


@pytest.fixture(scope="module")
def result(short_and_long):
    return run_research(short_and_long, RUN)


def test_a_run_has_every_part(result):
    rows = run_rows(result).groupBy("part", "instrument").count().collect()
    parts = {(r.part, r.instrument) for r in rows}
    judged = ("risk", "costs", "evidence", "evidence_by_regime", "regimes", "leakage")
    assert parts == {(p, i) for p in judged for i in "AB"} | {("unjudged", "SHORT")}
    short = result.unjudged.first()
    assert (short.n_bars, short.needed_bars) == (200, 430 + RUN.tail)


def test_decay_holds_all_horizons_and_evidence_the_primary_one(result):
    assert {r[0] for r in result.decay.select("horizon").distinct().collect()} == set(RUN.horizons)
    assert {r[0] for r in result.evidence.select("horizon").distinct().collect()} == {RUN.primary_horizon}


def test_regimes_are_of_test_bars_and_causal(result):
    assert result.regimes.where("not causal").count() == 0
    per_fold = result.regimes.groupBy("instrument", "fold_id").count().select("count").distinct().collect()
    assert [r[0] for r in per_fold] == [100]  # the first 20 rows of a slice have no inputs
    counted = result.by_regime.groupBy("signal").agg(F.sum("n_obs").alias("n")).select("n").distinct().collect()
    assert [r.n for r in counted] == [result.regimes.count()]


def test_leaks_are_found_in_the_matrix_itself(bars):
    matrix = feature_matrix(bars, RUN.horizons)
    assert matrix_leaks(matrix, RUN) == []
    other = matrix.withColumn("future_return_3", F.lit(0.0))
    assert matrix_leaks(other, RUN) == ["future_return_3"]

    class Reading:
        name, needs = "peeking", (target_column(5),)

    assert matrix_leaks(matrix, Research(plan=RUN.plan, signals=(*DEFAULT_SIGNALS, Reading()))) == ["future_return_5"]


def test_a_run_is_logged_once_for_each_judged_instrument(spark, result, tmp_path):
    store = str(tmp_path)
    ids = {r.instrument: r.experiment_id for r in log_run(result, RUN, store, "1h", extra={"range_start": None}).collect()}
    assert set(ids) == {"A", "B"}
    found = tables.get_experiment(spark, store, ids["A"])
    assert found["config"]["train_bars"] == 300 and found["config"]["range_start"] is None
    assert set(found["metrics"]) == {"avg_net_sharpe", "avg_max_drawdown", "n_folds"}
    assert tables.list_experiments(spark, store).count() == 2
    again = log_run(result, RUN, store, "1h").collect()
    assert {r.experiment_id for r in again}.isdisjoint(ids.values())
    assert tables.delete_experiment(spark, store, ids["B"])
    assert tables.list_experiments(spark, store).count() == 3
    assert json.loads(tables.list_experiments(spark, store).first().metrics)["n_folds"] > 0


def test_no_bars_give_no_rows(spark, bars):
    assert run_rows(run_research(bars.limit(0), RUN)).count() == 0
