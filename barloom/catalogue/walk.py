"""Registered queries: folds, execution, risk, backtest and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalogue.common import (
    SIGNALS_SQL,
    features_sql,
    folds_sql,
    ic_sql,
    long_scores_sql,
    placed_bars,
    placed_sql,
    r,
    rounded,
    scores_sql,
    table,
    with_p_sql,
)
from barloom.operators.execution import Costs, Limits, simulate_execution, target_position
from barloom.operators.execution import cost_sensitivity as cost_table
from barloom.operators.features import feature_matrix
from barloom.operators.folds import FoldPlan, assign_folds, detect_leakage, fold_fits, plan_defaults
from barloom.operators.reports import (
    cost_curve,
    cost_insensitive,
    evidence_class,
    fold_averages,
    metric_band,
    signal_evidence,
)
from barloom.operators.risk import risk_report, stopped_position, with_drawdown
from barloom.operators.execution import in_order
from barloom.plans.backtest import (
    Research,
    executed_paths,
    fold_costs,
    fold_reports,
    signal_weights,
    test_evidence,
    train_evidence,
)
from barloom.functions.timeframes import MINUTES, allowed_targets_column
from barloom.plans.research import research_summary, run_research

RUN = Research(plan=FoldPlan(train=300, test=100, step=100, embargo=10))
PLAN, TAIL = RUN.plan, RUN.tail
HORIZONS = RUN.horizons
SPREAD = (RUN.costs.spread_pips + RUN.costs.slippage_pips) * RUN.costs.pip_size


# --- folds ---------------------------------------------------------------------


def folds_query(spark: SparkSession, sf: str) -> DataFrame:
    return assign_folds(placed_bars(spark, sf), PLAN, TAIL).select(
        "instrument", "fold_id", "role", "ts", "pos"
    )


FOLDS_ORACLE = f"""WITH {placed_sql()}, {folds_sql("bars", "tr", PLAN, TAIL, "train")},
{folds_sql("bars", "te", PLAN, TAIL, "test")}
SELECT instrument, fold_id, 'train' AS role, ts, pos FROM tr
UNION ALL SELECT instrument, fold_id, 'test' AS role, ts, pos FROM te"""


def leakage_query(spark: SparkSession, sf: str) -> DataFrame:
    return detect_leakage(assign_folds(placed_bars(spark, sf), PLAN, TAIL))


LEAKAGE_ORACLE = f"""WITH {placed_sql()}, {folds_sql("bars", "tr", PLAN, TAIL, "train")},
{folds_sql("bars", "te", PLAN, TAIL, "test")},
a AS (SELECT instrument, fold_id, count(*) AS train_bars, max(ts) AS train_end FROM tr GROUP BY 1, 2),
b AS (SELECT instrument, fold_id, count(*) AS test_bars, min(ts) AS test_start FROM te GROUP BY 1, 2),
o AS (SELECT instrument, fold_id, count(*) AS n FROM tr JOIN te USING (instrument, fold_id, ts) GROUP BY 1, 2)
SELECT a.instrument, a.fold_id, train_bars, test_bars, coalesce(n, 0) AS overlap, train_end, test_start,
  test_start > train_end AS starts_after_train, coalesce(n, 0) = 0 AND test_start > train_end AS ok
FROM a JOIN b USING (instrument, fold_id) LEFT JOIN o USING (instrument, fold_id)"""


def plan_query(spark: SparkSession, sf: str) -> DataFrame:
    """Fold sizes proposed for every customer's order count taken as hourly bars."""
    sizes = (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg((F.count(F.lit(1)) * 37).alias("n_bars"))
    )
    planned = plan_defaults(sizes, "1h", "1h")
    return planned.withColumn("example_plan_fits", fold_fits(F.col("usable_bars"), PLAN))


PLAN_ORACLE = f"""WITH RECURSIVE s AS (SELECT o_custkey, count(*) * 37 AS n_bars FROM orders GROUP BY 1),
u AS (SELECT *, greatest(n_bars - 80, 0) AS usable FROM s),
q AS (SELECT DISTINCT usable FROM u),
i AS (SELECT usable, greatest(CAST(floor(usable * 0.6 + 0.5) AS BIGINT), 30) AS train,
        greatest(CAST(floor(usable * 0.18 + 0.5) AS BIGINT), 40) AS test,
        greatest(1, least(10, CAST(floor(floor(usable * 0.18 + 0.5) * 0.05 + 0.5) AS BIGINT))) AS gap FROM q),
w AS (SELECT usable, train, test, gap, 0 AS step FROM i
  UNION ALL
  SELECT usable, CASE WHEN train > 30 THEN train - greatest(1, CAST(floor(train * 0.05) AS BIGINT)) ELSE train END,
    CASE WHEN train <= 30 AND test > 40 THEN test - 1 ELSE test END, gap, step + 1
  FROM w WHERE train + gap + test > usable AND step < 200 AND (train > 30 OR test > 40)),
f AS (SELECT usable, arg_max(train, step) AS train, arg_max(test, step) AS test, max(gap) AS gap FROM w GROUP BY 1),
g AS (SELECT *, usable >= 71 AND train + gap + test <= usable AS ok FROM f)
SELECT o_custkey, n_bars, n_bars AS rows_at_timeframe, u.usable AS usable_bars, ok AS feasible,
  CASE WHEN ok THEN train ELSE 0 END AS train_bars, CASE WHEN ok THEN test ELSE 0 END AS test_bars,
  CASE WHEN ok THEN test ELSE 0 END AS step_bars, CASE WHEN ok THEN gap ELSE 0 END AS embargo_bars,
  CASE WHEN ok THEN greatest(1, (u.usable - train - gap - test) // test + 1) ELSE 0 END AS estimated_folds,
  {PLAN.span} <= u.usable AS example_plan_fits
FROM u JOIN g ON u.usable = g.usable"""


def allowed_query(spark: SparkSession, sf: str) -> DataFrame:
    """Research spacings open to datasets whose spacing follows the customer key."""
    names = F.array(*[F.lit(n) for n in [*MINUTES, "2w"]])
    sources = table(spark, sf, "customer").select(
        "c_custkey", F.element_at(names, (F.col("c_custkey") % 8 + 1).cast("int")).alias("source")
    )
    return sources.withColumn("allowed", F.array_join(allowed_targets_column("source"), ","))


ALLOWED_ORACLE = """WITH tf AS (SELECT * FROM (VALUES (0,'1min',1),(1,'5min',5),(2,'15min',15),(3,'30min',30),(4,'1h',60),
  (5,'4h',240),(6,'1d',1440),(7,'2w',NULL)) t(i, name, m)),
c AS (SELECT c_custkey, name AS source, coalesce(m, 60) AS m FROM customer JOIN tf ON c_custkey % 8 = i)
SELECT c_custkey, source, (SELECT string_agg(name, ',' ORDER BY m) FROM tf WHERE tf.m >= c.m) AS allowed FROM c"""


# --- backtest in SQL -----------------------------------------------------------

TEST_SQL = f"""{placed_sql()}, {features_sql("bars", "f", "instrument", HORIZONS)},
m AS (SELECT * FROM f WHERE pos < n_bars - {TAIL}),
{folds_sql("m", "te", PLAN, TAIL, "test")}, {scores_sql("te", "ts_", "instrument, fold_id")}"""

TRAIN_SQL = f"""{folds_sql("bars", "trr", PLAN, TAIL, "train")},
{features_sql("trr", "tf", "instrument, fold_id", HORIZONS)},
tm AS (SELECT * FROM tf WHERE pos < fold_id * {PLAN.step} + {PLAN.train} - 20),
{scores_sql("tm", "tsc", "instrument, fold_id")},
{long_scores_sql("tsc", "tl", "instrument, fold_id", (5,))},
{ic_sql("tl", "tic", "instrument, fold_id, signal")}, {with_p_sql("tic", "tev")},
wts AS (SELECT instrument, fold_id, signal,
  CASE WHEN significant THEN greatest(ic, 0) ELSE 0 END AS weight FROM tev)"""

_blend = " + ".join(f"score_{s} * w_{s}" for s in SIGNALS_SQL)
_total = " + ".join(f"w_{s}" for s in SIGNALS_SQL)
_wide = ", ".join(f"max(CASE WHEN signal = '{s}' THEN weight END) AS w_{s}" for s in SIGNALS_SQL)
W = "(PARTITION BY instrument, fold_id ORDER BY pos)"


def paths_sql(scored: str, signal: str, vol: str, latency: int = 1, commission: float = 0.0) -> str:
    """CTEs from a scored table to executed paths `ex`."""
    per_bar = RUN.limits.target_annual_vol / 252**0.5
    return f"""pos_ AS (SELECT instrument, fold_id, ts, pos, close, {signal} AS combined_score,
  coalesce(greatest(-1.0, least(1.0, {signal} * least({per_bar!r} / nullif({vol}, 0), 5.0))), 0) AS desired_position
  FROM {scored}),
held AS (SELECT *, coalesce(lag(desired_position, {latency}) OVER {W}, 0) AS position,
  coalesce(close / lag(close) OVER {W} - 1, 0) AS bar_return FROM pos_),
ex0 AS (SELECT *, coalesce(lag(position) OVER {W}, 0) * bar_return AS gross_return,
  abs(position - coalesce(lag(position) OVER {W}, 0)) AS turnover FROM held),
ex AS (SELECT *, turnover * ({SPREAD!r} / close + {commission!r} / close) AS cost,
  gross_return - turnover * ({SPREAD!r} / close + {commission!r} / close) AS net_return FROM ex0)"""


BACKTEST_SQL = f"""{TEST_SQL}, {TRAIN_SQL},
wide AS (SELECT instrument, fold_id, {_wide} FROM wts GROUP BY 1, 2),
comb AS (SELECT t.*, CASE WHEN ({_total}) > 0 THEN ({_blend}) / ({_total}) ELSE 0 END AS combined
  FROM ts_ t JOIN wide USING (instrument, fold_id)),
{paths_sql("comb", "combined", "realized_vol_20")}"""


def report_sql(source: str, ret: str, position: str | None, keys: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    extra, extra_cols = "", ""
    if position:
        extra = f""",
  avg(abs({position})) AS avg_exposure, coalesce(sum(abs(step)), 0) AS turnover"""
        extra_cols = f", {position} - lag({position}) OVER (PARTITION BY {keys} ORDER BY pos) AS step"
    return f"""rp1 AS (SELECT *, {ret} AS r, product(1 + {ret}) OVER {w} AS equity{extra_cols} FROM {source}),
rp2 AS (SELECT *, equity / max(equity) OVER {w} - 1 AS dd,
  quantile_cont(r, 0.05) OVER (PARTITION BY {keys}) AS cut FROM rp1),
rep AS (SELECT {keys},
  avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe,
  avg(r) / nullif(stddev_samp(r) FILTER (WHERE r < 0), 0) * sqrt(252) AS sortino,
  min(dd) AS max_drawdown, stddev_samp(r) * sqrt(252) AS volatility_annualized,
  -max(cut) AS var_95, -avg(r) FILTER (WHERE r <= cut) AS expected_shortfall_95,
  avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
  coalesce(sum(r) FILTER (WHERE r > 0), 0) / nullif(-coalesce(sum(r) FILTER (WHERE r < 0), 0), 0) AS profit_factor,
  arg_max(equity, pos) - 1 AS cumulative_return{extra}
  FROM rp2 GROUP BY {keys})"""


FINAL_SQL = f"""{BACKTEST_SQL},
st0 AS (SELECT *, product(1 + net_return) OVER (PARTITION BY instrument, fold_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS eq0 FROM ex),
st1 AS (SELECT *, eq0 / max(eq0) OVER (PARTITION BY instrument, fold_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 <= -{RUN.limits.max_drawdown_stop} AS hit FROM st0),
st2 AS (SELECT *, CASE WHEN hit OR coalesce(lag(hit) OVER {W}, false) THEN 0 ELSE position END AS final_position FROM st1),
st AS (SELECT *, coalesce(lag(final_position) OVER {W}, 0) * bar_return
  - abs(final_position - coalesce(lag(final_position) OVER {W}, 0)) * {SPREAD!r} / close AS final_net FROM st2),
{report_sql("st", "final_net", "final_position", "instrument, fold_id")}"""

REPORT_COLUMNS = [
    "sharpe", "sortino", "max_drawdown", "volatility_annualized", "var_95",
    "expected_shortfall_95", "hit_rate", "profit_factor", "cumulative_return",
]


def weights_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signal_weights(train_evidence(placed_bars(spark, sf), RUN)), 6)


WEIGHTS_ORACLE = f"""WITH {placed_sql()}, {TRAIN_SQL}
SELECT instrument, fold_id, signal, {r("weight", digits=6)} FROM wts"""


def test_evidence_query(spark: SparkSession, sf: str) -> DataFrame:
    found = test_evidence(placed_bars(spark, sf), RUN, HORIZONS)
    return rounded(found, 6)


TEST_EVIDENCE_SQL = f"""{TEST_SQL}, {long_scores_sql("ts_", "l", "instrument, fold_id", HORIZONS)},
{ic_sql("l", "c", "instrument, fold_id, signal, horizon")}, {with_p_sql("c", "cp")}"""
TEST_EVIDENCE_ORACLE = f"""WITH {TEST_EVIDENCE_SQL}
SELECT instrument, fold_id, signal, CAST(horizon AS INTEGER) AS horizon, n_obs, {r("ic", digits=6)},
  {r("p_value", digits=6)}, significant FROM cp"""


def paths_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        executed_paths(placed_bars(spark, sf), RUN).select(
            "instrument", "fold_id", "ts", "combined_score", "desired_position", "position",
            "gross_return", "turnover", "cost", "net_return",
        )
    )


PATHS_ORACLE = f"""WITH {BACKTEST_SQL}
SELECT instrument, fold_id, ts, {", ".join(r(c) for c in ("combined_score", "desired_position", "position", "gross_return", "turnover", "cost", "net_return"))} FROM ex"""


def reports_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fold_reports(placed_bars(spark, sf), RUN), 6)


REPORTS_ORACLE = f"""WITH {FINAL_SQL}
SELECT instrument, fold_id, {", ".join(r(c, digits=6) for c in [*REPORT_COLUMNS, "avg_exposure", "turnover"])} FROM rep"""

COSTS_SQL = f"""lv AS (SELECT unnest([0.0, 0.5, 1.0, 2.0, 4.0]) AS cost_multiplier),
cs AS (SELECT instrument, fold_id, CAST(cost_multiplier AS DOUBLE) AS cost_multiplier,
  avg(gross_return) / nullif(stddev_samp(gross_return), 0) * sqrt(252) AS gross_sharpe,
  avg(gross_return - cost * cost_multiplier) / nullif(stddev_samp(gross_return - cost * cost_multiplier), 0) * sqrt(252) AS net_sharpe,
  sum(cost) * cost_multiplier AS total_cost_drag, sum(gross_return) AS gross_cum_return,
  sum(gross_return - cost * cost_multiplier) AS net_cum_return FROM ex, lv GROUP BY instrument, fold_id, cost_multiplier)"""
COST_COLUMNS = ["gross_sharpe", "net_sharpe", "total_cost_drag", "gross_cum_return", "net_cum_return"]


def costs_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fold_costs(placed_bars(spark, sf), RUN), 6)


COSTS_ORACLE = f"""WITH {BACKTEST_SQL}, {COSTS_SQL}
SELECT instrument, fold_id, cost_multiplier, {", ".join(r(c, digits=6) for c in COST_COLUMNS)} FROM cs"""


def summary_query(spark: SparkSession, sf: str) -> DataFrame:
    """The whole research run, one row per instrument."""
    return rounded(research_summary(run_research(placed_bars(spark, sf), RUN)), 6)


SUMMARY_ORACLE = f"""WITH {FINAL_SQL}
SELECT instrument, count(*) AS n_folds, {r("avg(sharpe)", "avg_net_sharpe", 6)},
  {r("avg(max_drawdown)", "avg_max_drawdown", 6)} FROM rep GROUP BY 1"""


def averages_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fold_averages(fold_reports(placed_bars(spark, sf), RUN)), 6)


AVERAGES_ORACLE = f"""WITH {FINAL_SQL}
SELECT instrument, count(*) AS n_folds, count(*) < 5 AS few_folds,
  {", ".join(r(f"avg({m})", f"avg_{m}", 6) for m in ("sharpe", "sortino", "max_drawdown", "hit_rate", "profit_factor", "cumulative_return", "turnover"))}
FROM rep GROUP BY 1"""


def curve_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cost_curve(fold_costs(placed_bars(spark, sf), RUN)), 6)


CURVE_SQL = f"""{BACKTEST_SQL}, {COSTS_SQL},
cv AS (SELECT instrument, cost_multiplier, avg(gross_sharpe) AS avg_gross_sharpe,
  avg(net_sharpe) AS avg_net_sharpe, avg(total_cost_drag) AS avg_total_cost_drag FROM cs GROUP BY 1, 2)"""
CURVE_ORACLE = f"""WITH {CURVE_SQL}
SELECT instrument, cost_multiplier, {", ".join(r(c, digits=6) for c in ("avg_gross_sharpe", "avg_net_sharpe", "avg_total_cost_drag"))} FROM cv"""


def insensitive_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cost_insensitive(cost_curve(fold_costs(placed_bars(spark, sf), RUN))), 6)


INSENSITIVE_ORACLE = f"""WITH {CURVE_SQL}
SELECT instrument, {r("max(avg_net_sharpe) - min(avg_net_sharpe)", "net_sharpe_spread", 6)},
  {r("max(abs(avg_total_cost_drag))", "max_drag", 6)},
  coalesce(count(avg_net_sharpe) > 1 AND max(avg_net_sharpe) - min(avg_net_sharpe) < 0.001, false)
    OR coalesce(max(abs(avg_total_cost_drag)) < 1e-9, true) AS cost_insensitive
FROM cv GROUP BY 1"""


def signal_evidence_query(spark: SparkSession, sf: str) -> DataFrame:
    found = signal_evidence(test_evidence(placed_bars(spark, sf), RUN))
    return rounded(found, 6)


SIGNAL_EVIDENCE_ORACLE = f"""WITH {TEST_EVIDENCE_SQL},
ev AS (SELECT * FROM cp WHERE horizon = {RUN.primary_horizon}),
g AS (SELECT instrument, signal, avg(ic) AS avg_ic, avg(p_value) AS avg_p,
  count(*) FILTER (WHERE significant) AS significant_folds, CAST(sum(n_obs) AS BIGINT) AS total_n,
  count(ic) AS judged_folds FROM ev GROUP BY 1, 2),
a AS (SELECT instrument, signal, count(*) FILTER (WHERE sign(ic) = sign(avg_ic)) AS agreeing_folds
  FROM ev JOIN g USING (instrument, signal) GROUP BY 1, 2)
SELECT instrument, signal, {r("avg_ic", digits=6)}, {r("avg_p", digits=6)}, significant_folds, total_n, judged_folds,
  agreeing_folds, CASE WHEN avg_ic IS NULL OR total_n < 30 THEN 'Insufficient sample'
    WHEN significant_folds > 0 AND abs(avg_ic) >= 0.03 THEN 'Positive evidence'
    WHEN significant_folds > 0 THEN 'Weak evidence' ELSE 'Insignificant' END AS evidence
FROM g JOIN a USING (instrument, signal)"""


# --- execution and risk on plain inputs ----------------------------------------

STRESSED = Costs(spread_pips=2.0, slippage_pips=1.0, commission_per_lot=0.01, latency_bars=2, pip_size=0.01)


def plain_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Execution of a simple wish (reversal of the last return) on test slices."""
    m = feature_matrix(placed_bars(spark, sf), HORIZONS, keep=["log_return_1", "realized_vol_20"])
    sliced = assign_folds(m, PLAN, TAIL, roles=["test"])
    wish = sliced.withColumn("_wish", -F.signum(F.coalesce("log_return_1", F.lit(0.0))))
    desired = target_position("_wish", "realized_vol_20", Limits(target_annual_vol=2.0))
    return simulate_execution(wish.withColumn("desired_position", desired), STRESSED)


def execution_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        plain_paths(spark, sf).select(
            "instrument", "fold_id", "ts", "desired_position", "position", "gross_return",
            "turnover", "cost", "net_return",
        )
    )


PLAIN_SQL = f"""{placed_sql()}, {features_sql("bars", "f", "instrument", HORIZONS)},
m AS (SELECT *, -sign(coalesce(log_return_1, 0)) AS wish FROM f WHERE pos < n_bars - {TAIL}),
{folds_sql("m", "te", PLAN, TAIL, "test")},
p0 AS (SELECT *, coalesce(greatest(-1.0, least(1.0, wish * least({2.0 / 252**0.5!r} / nullif(realized_vol_20, 0), 5.0))), 0) AS desired_position FROM te),
p1 AS (SELECT *, coalesce(lag(desired_position, 2) OVER {W}, 0) AS position,
  coalesce(close / lag(close) OVER {W} - 1, 0) AS bar_return FROM p0),
p2 AS (SELECT *, coalesce(lag(position) OVER {W}, 0) * bar_return AS gross_return,
  abs(position - coalesce(lag(position) OVER {W}, 0)) AS turnover FROM p1),
ex AS (SELECT *, turnover * (0.03 / close + 0.01 / close) AS cost,
  gross_return - turnover * (0.03 / close + 0.01 / close) AS net_return FROM p2)"""
EXECUTION_ORACLE = f"""WITH {PLAIN_SQL}
SELECT instrument, fold_id, ts, {", ".join(r(c) for c in ("desired_position", "position", "gross_return", "turnover", "cost", "net_return"))} FROM ex"""


def plain_costs_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cost_table(plain_paths(spark, sf)), 6)


PLAIN_COSTS_ORACLE = f"""WITH {PLAIN_SQL}, {COSTS_SQL}
SELECT instrument, fold_id, cost_multiplier, {", ".join(r(c, digits=6) for c in COST_COLUMNS)} FROM cs"""


def small_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-series returns of a hundredth of the log return, with a position."""
    m = feature_matrix(placed_bars(spark, sf), (), dropna=False, keep=["log_return_1"])
    return m.select(
        "instrument",
        "ts",
        "pos",
        (F.col("log_return_1") / 100).alias("ret"),
        F.when(F.col("pos") % 3 == 0, 1.0).otherwise(-0.5).alias("position"),
    )


SMALL_SQL = f"""{placed_sql()}, sr AS (SELECT instrument, ts, pos,
  (ln(close) - lag(ln(close)) OVER (PARTITION BY instrument ORDER BY pos)) / 100 AS ret,
  CASE WHEN pos % 3 = 0 THEN 1.0 ELSE -0.5 END AS position FROM bars)"""


def drawdown_query(spark: SparkSession, sf: str) -> DataFrame:
    """Equity and drawdown of whole series, carried across chunks of 256 bars."""
    path = with_drawdown(small_returns(spark, sf), "ret", ["instrument"], bounded=False, chunk_rows=256)
    return rounded(path.select("instrument", "ts", "equity", "drawdown"))


DRAWDOWN_ORACLE = f"""WITH {SMALL_SQL}, e AS (SELECT *, product(1 + coalesce(ret, 0)) OVER
  (PARTITION BY instrument ORDER BY pos ROWS UNBOUNDED PRECEDING) AS equity FROM sr)
SELECT instrument, ts, {r("equity")}, {r("equity / max(equity) OVER (PARTITION BY instrument ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1", "drawdown")} FROM e"""


def series_report_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        risk_report(small_returns(spark, sf), "ret", "position", ["instrument"], bounded=False), 6
    )


SERIES_REPORT_ORACLE = f"""WITH {SMALL_SQL},
known AS (SELECT *, coalesce(ret, 0) AS g FROM sr),
e AS (SELECT *, product(1 + g) OVER (PARTITION BY instrument ORDER BY pos ROWS UNBOUNDED PRECEDING) AS equity,
  position - lag(position) OVER (PARTITION BY instrument ORDER BY pos) AS step FROM known),
d AS (SELECT *, equity / max(equity) OVER (PARTITION BY instrument ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS dd,
  quantile_cont(ret, 0.05) OVER (PARTITION BY instrument) AS cut FROM e)
SELECT instrument, {r("avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)", "sharpe", 6)},
  {r("avg(ret) / nullif(stddev_samp(ret) FILTER (WHERE ret < 0), 0) * sqrt(252)", "sortino", 6)},
  {r("min(dd)", "max_drawdown", 6)}, {r("stddev_samp(ret) * sqrt(252)", "volatility_annualized", 6)},
  {r("-max(cut)", "var_95", 6)}, {r("-avg(ret) FILTER (WHERE ret <= cut)", "expected_shortfall_95", 6)},
  {r("avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)", "hit_rate", 6)},
  {r("sum(ret) FILTER (WHERE ret > 0) / nullif(-sum(ret) FILTER (WHERE ret < 0), 0)", "profit_factor", 6)},
  {r("arg_max(equity, pos) - 1", "cumulative_return", 6)}, {r("avg(abs(position))", "avg_exposure", 6)},
  {r("sum(abs(step))", "turnover", 6)} FROM d GROUP BY 1"""


def stop_query(spark: SparkSession, sf: str) -> DataFrame:
    """Positions under a tight drawdown stop, on test slices."""
    path = with_drawdown(plain_paths(spark, sf), "net_return")
    stopped = path.withColumn("stopped_position", stopped_position("position", 0.05, in_order()))
    return rounded(stopped.select("instrument", "fold_id", "ts", "drawdown", "stopped_position"))


STOP_ORACLE = f"""WITH {PLAIN_SQL},
e AS (SELECT *, product(1 + net_return) OVER (PARTITION BY instrument, fold_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS eq FROM ex),
d AS (SELECT *, eq / max(eq) OVER (PARTITION BY instrument, fold_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM e)
SELECT instrument, fold_id, ts, {r("drawdown")},
  {r(f"CASE WHEN drawdown <= -0.05 OR coalesce(lag(drawdown) OVER {W} <= -0.05, false) THEN 0 ELSE position END", "stopped_position")} FROM d"""


def bands_query(spark: SparkSession, sf: str) -> DataFrame:
    """Verbal bands over values derived from every order line."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_discount") * 40 - 1).alias("x"),
        (F.col("l_tax") * 3 - 0.12).alias("y"),
        (F.col("l_discount") + F.col("l_tax")).alias("z"),
        "l_quantity",
    )
    bands = {
        "sharpe": metric_band("sharpe", "x"),
        "sortino": metric_band("sortino", "x"),
        "profit_factor": metric_band("profit_factor", F.abs("x")),
        "max_drawdown": metric_band("max_drawdown", "y"),
        "hit_rate": metric_band("hit_rate", F.col("z") * 4),
        "ic": metric_band("ic", "y"),
        "p_value": metric_band("p_value", "z"),
        "evidence": evidence_class(F.col("y"), F.col("l_quantity"), F.col("z") < 0.05),
    }
    return (
        lines.withColumns(bands)
        .groupBy(*bands)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _case(x: str, bounds: list[tuple[float, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN '{n}'" for b, n in bounds) + f" ELSE '{last}' END"


BANDS_ORACLE = f"""WITH v AS (SELECT l_discount * 40 - 1 AS x, l_tax * 3 - 0.12 AS y, l_discount + l_tax AS z, l_quantity AS q FROM lineitem),
b AS (SELECT {_case("x", [(0, "Negative"), (0.5, "Weak"), (1, "Acceptable"), (2, "Good")], "Strong")} AS sharpe,
  {_case("x", [(0, "Negative"), (0.75, "Weak"), (1.5, "Acceptable"), (2.5, "Good")], "Strong")} AS sortino,
  {_case("abs(x)", [(1, "Losing"), (1.2, "Weak"), (1.5, "Good")], "Strong")} AS profit_factor,
  {_case("abs(y) * 100", [(5, "Very Low"), (10, "Low"), (20, "Moderate")], "High")} AS max_drawdown,
  {_case("z * 4 * 100", [(40, "Low"), (50, "Moderate"), (60, "Good")], "High")} AS hit_rate,
  {_case("abs(y)", [(0.05, "Very Weak"), (0.1, "Weak"), (0.2, "Moderate")], "Strong")} || CASE WHEN y < 0 THEN ' (inverse)' ELSE '' END AS ic,
  CASE WHEN z > 0.10 THEN 'Weak evidence' WHEN z > 0.05 THEN 'Marginal' WHEN z > 0.01 THEN 'Significant' ELSE 'Very Strong evidence' END AS p_value,
  CASE WHEN q < 30 THEN 'Insufficient sample' WHEN z < 0.05 AND abs(y) >= 0.03 THEN 'Positive evidence'
       WHEN z < 0.05 THEN 'Weak evidence' ELSE 'Insignificant' END AS evidence FROM v)
SELECT sharpe, sortino, profit_factor, max_drawdown, hit_rate, ic, p_value, evidence, count(*) AS n FROM b GROUP BY ALL"""

QUERIES = {
    "walk_forward_folds": (folds_query, FOLDS_ORACLE),
    "leakage_check": (leakage_query, LEAKAGE_ORACLE),
    "fold_plan_defaults": (plan_query, PLAN_ORACLE),
    "allowed_timeframes": (allowed_query, ALLOWED_ORACLE),
    "train_signal_weights": (weights_query, WEIGHTS_ORACLE),
    "test_evidence_by_fold": (test_evidence_query, TEST_EVIDENCE_ORACLE),
    "backtest_paths": (paths_query, PATHS_ORACLE),
    "fold_risk_reports": (reports_query, REPORTS_ORACLE),
    "fold_cost_sensitivity": (costs_query, COSTS_ORACLE),
    "research_summary": (summary_query, SUMMARY_ORACLE),
    "fold_averages": (averages_query, AVERAGES_ORACLE),
    "cost_curve": (curve_query, CURVE_ORACLE),
    "cost_insensitivity": (insensitive_query, INSENSITIVE_ORACLE),
    "signal_evidence": (signal_evidence_query, SIGNAL_EVIDENCE_ORACLE),
    "simulate_execution": (execution_query, EXECUTION_ORACLE),
    "cost_sensitivity": (plain_costs_query, PLAIN_COSTS_ORACLE),
    "drawdown_path": (drawdown_query, DRAWDOWN_ORACLE),
    "series_risk_report": (series_report_query, SERIES_REPORT_ORACLE),
    "drawdown_stop": (stop_query, STOP_ORACLE),
    "metric_bands": (bands_query, BANDS_ORACLE),
}
