"""Registered queries that join several parts: evidence by regime, stored bars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.catalogue.common import (
    bars_sql,
    features_sql,
    folds_sql,
    ic_sql,
    long_scores_sql,
    placed_bars,
    r,
    rounded,
    with_p_sql,
)
from barloom.catalogue.market import em_sql, posterior_sql
from barloom.catalogue.text import ONE_SERIES, one_series
from barloom.catalogue.walk import COST_COLUMNS, COSTS_SQL, FINAL_SQL, REPORT_COLUMNS, RUN, TEST_SQL
from barloom.plans.backtest import fold_regimes, regime_evidence
from barloom.plans.research import run_research, run_rows
from barloom.session import materialized, shared_folder
from barloom.sources.tables import load_dataset, register_dataset

PLAN, TAIL = RUN.plan, RUN.tail


def regime_query(spark: SparkSession, sf: str) -> DataFrame:
    """Test-slice correlation of every signal within the regimes of the train fit."""
    bars = placed_bars(spark, sf)
    labels = materialized(fold_regimes(bars, RUN).drop("probabilities"))
    return rounded(regime_evidence(bars, RUN, labels), 6)


REGIME_SQL = f"""{folds_sql("bars", "rtr", PLAN, TAIL, "train")}, {folds_sql("bars", "rte", PLAN, TAIL, "test")},
{features_sql("rtr", "ftr", "instrument, fold_id")}, {features_sql("rte", "fte", "instrument, fold_id")},
x AS (SELECT instrument, fold_id, pos, log_return_1 AS ret, realized_vol_20 / sqrt(20) AS vol, momentum_20 / 20 AS trend
  FROM ftr WHERE realized_vol_20 IS NOT NULL),
{em_sql("x", "instrument, fold_id")},
y AS (SELECT f.instrument, f.fold_id, f.ts, f.pos, (log_return_1 - a0) / s0 AS z0, (realized_vol_20 / sqrt(20) - a1) / s1 AS z1,
  (momentum_20 / 20 - a2) / s2 AS z2 FROM fte f JOIN em_scale USING (instrument, fold_id) WHERE realized_vol_20 IS NOT NULL),
{posterior_sql("ap", "y", "em_f", "instrument, fold_id")},
b AS (SELECT instrument, fold_id, pos, arg_max(c, p) AS c FROM ap GROUP BY 1, 2, 3),
sr AS (SELECT t.*, n.name AS regime FROM ts_ t JOIN b USING (instrument, fold_id, pos)
  JOIN em_n n ON b.instrument = n.instrument AND b.fold_id = n.fold_id AND b.c = n.c),
{long_scores_sql("sr", "rl", "instrument, fold_id, regime", (RUN.primary_horizon,))},
{ic_sql("rl", "rc", "instrument, fold_id, regime, signal, horizon")}, {with_p_sql("rc", "rcp")}"""
REGIME_ORACLE = f"""WITH RECURSIVE {TEST_SQL},
{REGIME_SQL}
SELECT instrument, fold_id, regime, signal, CAST(horizon AS INTEGER) AS horizon, n_obs, {r("ic", digits=6)},
  {r("p_value", digits=6)}, significant FROM rcp"""


def run_query(spark: SparkSession, sf: str) -> DataFrame:
    """A whole research run as rows. The folds are longer than some instruments' series."""
    return rounded(run_rows(run_research(placed_bars(spark, sf), RUN)), 5)


def _rows(part: str, source: str, names: list[str], fold="fold_id", name=None, regime="NULL", level="NULL") -> str:
    return " UNION ALL ".join(
        f"""SELECT instrument, '{part}' AS part, CAST({fold} AS INTEGER) AS fold_id, CAST({regime} AS VARCHAR) AS regime,
  CAST({level} AS DOUBLE) AS level, {name or f"'{n}'"} AS name, {r(f"CAST({n} AS DOUBLE)", "value", 5)} FROM {source}"""
        for n in names
    )


_LEAKAGE_SQL = f"""{folds_sql("bars", "ltr", PLAN, TAIL, "train")}, {folds_sql("bars", "lte", PLAN, TAIL, "test")},
lk AS (SELECT instrument, fold_id, count(DISTINCT ts) FILTER (WHERE train) AS train_bars, count(DISTINCT ts) FILTER (WHERE NOT train) AS test_bars,
  count(DISTINCT ts) FILTER (WHERE train AND ts IN (SELECT ts FROM lte z WHERE z.instrument = u.instrument AND z.fold_id = u.fold_id)) AS overlap
  FROM (SELECT instrument, fold_id, ts, true AS train FROM ltr UNION ALL SELECT instrument, fold_id, ts, false FROM lte) u GROUP BY 1, 2)"""
RUN_ORACLE = f"""WITH RECURSIVE {FINAL_SQL}, {COSTS_SQL},
{long_scores_sql("ts_", "l", "instrument, fold_id", RUN.horizons)},
{ic_sql("l", "c", "instrument, fold_id, signal, horizon")}, {with_p_sql("c", "cp")},
{REGIME_SQL},
share AS (SELECT b.instrument, b.fold_id, n.name AS regime, count(*) AS bars FROM b
  JOIN em_n n ON b.instrument = n.instrument AND b.fold_id = n.fold_id AND b.c = n.c GROUP BY 1, 2, 3),
{_LEAKAGE_SQL},
short AS (SELECT instrument, max(n_bars) AS n_bars, {PLAN.span + TAIL} AS needed_bars FROM bars GROUP BY 1 HAVING max(n_bars) < {PLAN.span + TAIL})
{" UNION ALL ".join([
    _rows("risk", "rep", [*REPORT_COLUMNS, "avg_exposure", "turnover"]),
    _rows("costs", "cs", COST_COLUMNS, level="cost_multiplier"),
    _rows("evidence", "cp", ["ic"], name="signal", level="horizon"),
    _rows("evidence_by_regime", "rcp", ["ic"], name="signal", regime="regime", level="horizon"),
    _rows("regimes", "share", ["bars"], regime="regime"),
    _rows("leakage", "lk", ["train_bars", "test_bars", "overlap"]),
    _rows("unjudged", "short", ["n_bars", "needed_bars"], fold="NULL"),
])}"""


def stored_query(spark: SparkSession, sf: str) -> DataFrame:
    """Bars registered as a dataset, then loaded after checking count and content."""
    store = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    bars = one_series(spark, sf).drop("line", "instrument")
    key = register_dataset(bars, store, "ALL60.csv", "ALL", "1h")
    return rounded(load_dataset(spark, store, key))


STORED_ORACLE = f"""WITH {ONE_SERIES}, {bars_sql("1h")}
SELECT instrument, ts, {", ".join(r(c) for c in ("open", "high", "low", "close", "volume"))},
  'UPLOADED_CSV' AS source, false AS is_synthetic FROM bars"""

QUERIES = {
    "ic_by_regime": (regime_query, REGIME_ORACLE),
    "ic_by_regime_full": (regime_query, REGIME_ORACLE),
    "research_run": (run_query, RUN_ORACLE),
    "stored_bars": (stored_query, STORED_ORACLE),
}
