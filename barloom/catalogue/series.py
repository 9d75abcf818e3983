"""Registered queries: bars, features, targets, signals and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalogue.common import (
    SIGNALS_SQL,
    bars_sql,
    event_bars,
    features_sql,
    ic_sql,
    long_scores_sql,
    p_sql,
    placed_bars,
    placed_sql,
    r,
    rounded,
    scores_sql,
    table,
    ticks,
    with_p_sql,
    TICKS,
)
from barloom.operators import features as feat
from barloom.operators.bars import resample, source_timeframe, tick_bars
from barloom.operators.evaluation import (
    bonferroni,
    bootstrap_mean,
    evaluate_signals,
    information_coefficient,
    rolling_ic,
    sharpe_significance,
)
from barloom.operators.features import feature_matrix
from barloom.operators.signals import mean_reversion, needed_features, score_signals

HORIZONS = (1, 5, 10, 20)
OHLCV = ("open", "high", "low", "close", "volume")


def bars_query(timeframe: str):
    return lambda spark, sf: rounded(event_bars(spark, sf, timeframe))


def bars_oracle(timeframe: str) -> str:
    return f"""WITH {TICKS}, {bars_sql(timeframe)}
SELECT instrument, ts, {", ".join(r(c) for c in OHLCV)} FROM bars"""


def daily_order_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals as ticks per priority: many ticks share one timestamp."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("instrument"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("volume"),
        "o_orderkey",
    )
    return rounded(tick_bars(orders, "1d", tie=["o_orderkey"]))


DAILY_ORDER_BARS = f"""SELECT o_orderpriority AS instrument, time_bucket(INTERVAL '1 day', o_orderdate) AS ts,
  {r("first(o_totalprice ORDER BY o_orderdate, o_orderkey)", "open")}, {r("max(o_totalprice)", "high")},
  {r("min(o_totalprice)", "low")}, {r("last(o_totalprice ORDER BY o_orderdate, o_orderkey)", "close")},
  CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY 1, 2"""


def quoted_resample(spark: SparkSession, sf: str) -> DataFrame:
    """5-minute bars with a patchy bid and ask, to 4 hours."""
    fine = event_bars(spark, sf, "5min").withColumns(
        {
            "bid": F.when(F.minute("ts") % 2 == 0, F.col("close") - 0.5),
            "ask": F.when(F.hour("ts") < 12, F.col("close") + 0.5),
        }
    )
    return rounded(resample(fine, "5min", "4h"))


QUOTED_RESAMPLE = f"""WITH {TICKS}, {bars_sql("5min")},
q AS (SELECT *, CASE WHEN minute(ts) % 2 = 0 THEN close - 0.5 END AS bid,
             CASE WHEN hour(ts) < 12 THEN close + 0.5 END AS ask FROM bars)
SELECT instrument, time_bucket(INTERVAL '4 hours', ts) AS ts,
  {r("arg_min(open, ts)", "open")}, {r("max(high)", "high")}, {r("min(low)", "low")},
  {r("arg_max(close, ts)", "close")}, {r("sum(volume)", "volume")},
  {r("arg_max(bid, ts) FILTER (WHERE bid IS NOT NULL)", "bid")},
  {r("arg_max(ask, ts) FILTER (WHERE ask IS NOT NULL)", "ask")}
FROM q GROUP BY 1, 2"""


def spacing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(source_timeframe(event_bars(spark, sf, "15min")))


SPACING = f"""WITH {TICKS}, {bars_sql("15min")},
g AS (SELECT instrument, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY instrument ORDER BY ts) AS gap FROM bars),
m AS (SELECT instrument, count(*) AS n_bars, quantile_cont(gap, 0.5) / 1e6 AS med FROM g GROUP BY 1),
o AS (SELECT * FROM (VALUES (60,'1min'),(300,'5min'),(900,'15min'),(1800,'30min'),(3600,'1h'),(14400,'4h'),(86400,'1d')) t(s, name))
SELECT instrument, n_bars, {r("med", "median_gap_s")},
  CASE WHEN n_bars < 3 THEN '1min' ELSE (SELECT arg_min(name, abs(s - med) * 1000000 + s) FROM o) END AS timeframe
FROM m"""


def feature_query(names: list[str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        wide = feature_matrix(placed_bars(spark, sf), (), dropna=False, keep=names)
        return rounded(wide.select("instrument", "ts", *names))

    return run


def feature_oracle(names: list[str], ewma: bool = False) -> str:
    shown = [c if c.startswith("session") else r(c) for c in names]
    return f"""WITH {placed_sql()},
{features_sql("bars", "f", "instrument", ewma=ewma)}
SELECT instrument, ts, {", ".join(shown)} FROM f"""


SCORES = ["zscore_20", "zscore_50", "volume_zscore_20", "range_zscore_20", "activity_intensity_10"]


def spiked_query(spark: SparkSession, sf: str) -> DataFrame:
    """Scores beside volume spikes of 1e12 and a price that jumps ten thousandfold."""
    jump = F.when(F.col("pos") % 300 >= 150, 1e4).otherwise(1.0)
    bars = placed_bars(spark, sf).withColumn("volume", F.when(F.col("pos") % 97 == 0, 1e12).otherwise(F.col("volume")))
    bars = bars.withColumns({c: F.col(c) * jump for c in ("open", "high", "low", "close")})
    return rounded(feature_matrix(bars, (), dropna=False, keep=SCORES).select("instrument", "ts", *SCORES), 6)


_JUMP = "* CASE WHEN pos % 300 >= 150 THEN 1e4 ELSE 1.0 END"
SPIKED_ORACLE = f"""WITH {placed_sql()},
j AS (SELECT instrument, ts, pos, {", ".join(f"{c} {_JUMP} AS {c}" for c in ("open", "high", "low", "close"))},
  CASE WHEN pos % 97 = 0 THEN 1e12 ELSE volume END AS volume FROM bars),
{features_sql("j", "f", "instrument")}
SELECT instrument, ts, {", ".join(r(c, digits=6) for c in SCORES)} FROM f"""

TARGETS = [feat.target_column(h, k) for h in HORIZONS for k in ("return", "direction")]


def targets_query(spark: SparkSession, sf: str) -> DataFrame:
    wide = feature_matrix(placed_bars(spark, sf), HORIZONS, keep=[])
    return rounded(wide.select("instrument", "ts", "pos", *TARGETS))


TARGETS_ORACLE = f"""WITH {placed_sql()}, {features_sql("bars", "f", "instrument", HORIZONS)}
SELECT instrument, ts, pos, {", ".join(r(c) for c in TARGETS)} FROM f WHERE pos < n_bars - 20"""


def matrix_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Non-NULL count and mean of all 34 features of the whole matrix."""
    m = feature_matrix(placed_bars(spark, sf), HORIZONS)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
            for c in feat.feature_columns(m)
        ]
    )
    return rounded(
        m.select("instrument", F.inline(cells))
        .groupBy("instrument", "feature")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_known"), F.avg("v").alias("mean")),
        6,
    )


MATRIX_SUMMARY = f"""WITH {placed_sql()}, {features_sql("bars", "f", "instrument", HORIZONS, ewma=True)},
long AS ({" UNION ALL ".join(f"SELECT instrument, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM f WHERE pos < n_bars - 20" for c in feat.FEATURES)})
SELECT instrument, feature, count(*) AS n_rows, count(v) AS n_known, {r("avg(v)", "mean", 6)} FROM long GROUP BY 1, 2"""


def series_scores(spark: SparkSession, sf: str, timeframe: str = "1h") -> DataFrame:
    m = feature_matrix(placed_bars(spark, sf, timeframe), HORIZONS, keep=needed_features())
    return score_signals(m, ["instrument"], bounded=False)


SCORES_SQL = f"""{placed_sql()}, {features_sql("bars", "f", "instrument", HORIZONS)},
m AS (SELECT * FROM f WHERE pos < n_bars - 20),
{scores_sql("m", "s", "instrument")}"""


def scores_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        series_scores(spark, sf).select("instrument", "ts", *[f"score_{s}" for s in SIGNALS_SQL])
    )


SCORES_ORACLE = f"""WITH {SCORES_SQL}
SELECT instrument, ts, {", ".join(r("score_" + s) for s in SIGNALS_SQL)} FROM s"""


def ic_query(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of one reversal signal with the next bar's return, per instrument."""
    signal = mean_reversion(20)
    m = feature_matrix(placed_bars(spark, sf), (1,), keep=list(signal.needs))
    scored = score_signals(m, ["instrument"], bounded=False, signals=[signal])
    return rounded(
        information_coefficient(
            scored, ["instrument"], ["pos"], signal.column, "future_return_1", bounded=False
        ),
        6,
    )


IC_ORACLE = f"""WITH {placed_sql()}, {features_sql("bars", "f", "instrument", (1,))},
m AS (SELECT * FROM f WHERE pos < n_bars - 1),
{scores_sql("m", "s", "instrument")},
l AS (SELECT instrument, score_mean_reversion_20 AS score, future_return_1 AS fwd FROM s),
{ic_sql("l", "c", "instrument")}, {with_p_sql("c", "cp")}
SELECT instrument, n_obs, {r("ic", digits=6)}, {r("p_value", digits=6)}, significant FROM cp"""


def decay_query(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate_signals(series_scores(spark, sf), ["instrument"], ["pos"], HORIZONS, bounded=False)
    return rounded(found, 6)


DECAY_ORACLE = f"""WITH {SCORES_SQL}, {long_scores_sql("s", "l", "instrument", HORIZONS)},
{ic_sql("l", "c", "instrument, signal, horizon")}, {with_p_sql("c", "cp")}
SELECT instrument, signal, CAST(horizon AS INTEGER) AS horizon, n_obs, {r("ic", digits=6)},
  {r("p_value", digits=6)}, significant FROM cp"""

# A label for "by regime" evidence that both engines derive alike.
SESSION = "CASE WHEN hour(ts) < 8 THEN 'night' WHEN hour(ts) < 16 THEN 'day' ELSE 'evening' END"


def labelled_ic(spark: SparkSession, sf: str) -> DataFrame:
    scored = series_scores(spark, sf).withColumn("regime", F.expr(SESSION))
    return rounded(
        evaluate_signals(scored, ["instrument", "regime"], ["pos"], [5], bounded=False), 6
    )


LABELLED_ORACLE = f"""WITH {SCORES_SQL}, sr AS (SELECT *, {SESSION} AS regime FROM s),
{long_scores_sql("sr", "l", "instrument, regime", (5,))},
{ic_sql("l", "c", "instrument, regime, signal, horizon")}, {with_p_sql("c", "cp")}
SELECT instrument, regime, signal, CAST(horizon AS INTEGER) AS horizon, n_obs, {r("ic", digits=6)},
  {r("p_value", digits=6)}, significant FROM cp"""


def rolling_query(spark: SparkSession, sf: str) -> DataFrame:
    signal = mean_reversion(20)
    m = feature_matrix(placed_bars(spark, sf), (1,), keep=list(signal.needs))
    scored = score_signals(m, ["instrument"], bounded=False, signals=[signal])
    return rounded(rolling_ic(scored, signal.column, "future_return_1", 250))


ROLLING_ORACLE = f"""WITH {placed_sql()}, {features_sql("bars", "f", "instrument", (1,))},
m AS (SELECT * FROM f WHERE pos < n_bars - 1),
{scores_sql("m", "s", "instrument")},
l AS (SELECT a.instrument, a.pos AS last_pos, b.score_mean_reversion_20 AS score, b.future_return_1 AS fwd
  FROM s a JOIN s b ON a.instrument = b.instrument AND b.pos BETWEEN a.pos - 249 AND a.pos
  WHERE a.pos >= 249),
{ic_sql("l", "c", "instrument, last_pos")}
SELECT s.instrument, s.ts, s.pos, {r("ic")} FROM s LEFT JOIN c ON s.instrument = c.instrument AND s.pos = c.last_pos"""


def bar_returns(spark: SparkSession, sf: str) -> DataFrame:
    return feature_matrix(placed_bars(spark, sf), (), dropna=False, keep=["log_return_1"])


def sharpe_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sharpe_significance(bar_returns(spark, sf), ["instrument"], "log_return_1"), 6)


RETURNS_SQL = f"""{placed_sql()}, rets AS (SELECT *,
  ln(close) - lag(ln(close)) OVER (PARTITION BY instrument ORDER BY pos) AS x FROM bars)"""

SHARPE_ORACLE = f"""WITH {RETURNS_SQL},
a AS (SELECT instrument, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM rets GROUP BY 1),
t AS (SELECT *, CASE WHEN n >= 10 THEN mean / nullif(sd, 0) * sqrt(252) END AS sharpe,
             CASE WHEN n >= 10 THEN mean / nullif(sd, 0) * sqrt(n) END AS t_stat FROM a)
SELECT instrument, n, {r("sharpe", digits=6)}, {r("t_stat", digits=6)},
  {r(p_sql("t_stat", "(n - 1)"), "p_value", 6)} FROM t"""


def bonferroni_query(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate_signals(series_scores(spark, sf), ["instrument"], ["pos"], HORIZONS, bounded=False)
    return rounded(
        bonferroni(found, ["instrument"]).select(
            "instrument", "signal", "horizon", "p_value", "p_corrected"
        ),
        6,
    )


BONFERRONI_ORACLE = f"""WITH {SCORES_SQL}, {long_scores_sql("s", "l", "instrument", HORIZONS)},
{ic_sql("l", "c", "instrument, signal, horizon")}, {with_p_sql("c", "cp")}
SELECT instrument, signal, CAST(horizon AS INTEGER) AS horizon, {r("p_value", digits=6)},
  {r("least(p_value * count(p_value) OVER (PARTITION BY instrument), 1.0)", "p_corrected", 6)} FROM cp"""


def bootstrap_query(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the mean hourly volume per instrument."""
    bars = placed_bars(spark, sf)
    return rounded(bootstrap_mean(bars, ["instrument"], "volume", "pos"), 6)


def _poisson_sql() -> str:
    p = 2_147_483_647
    first = f"(pos % {p} * 48271 + d * 69621 + 42) % {p}"
    steps, name = [f"m0 AS (SELECT *, {first} AS h FROM draws)"], "m0"
    for i, (a, b) in enumerate(((16807, 7), (40692, 13), (39373, 29)), 1):
        steps.append(
            f"m{i} AS (SELECT instrument, pos, volume, d, ((h * h) % {p} + h * {a} + {b} + d) % {p} AS h FROM {name})"
        )
        name = f"m{i}"
    total, cdf, fact = 0.0, [], 1
    for k in range(12):
        fact = fact * max(k, 1)
        total += 2.718281828459045**-1 / fact
        cdf.append(total)
    times = " + ".join(f"CASE WHEN h / {float(p)!r} > {c!r} THEN 1 ELSE 0 END" for c in cdf)
    return ",\n".join(steps) + f",\nw AS (SELECT *, {times} AS k FROM {name})"


BOOTSTRAP_ORACLE = f"""WITH {placed_sql()},
draws AS (SELECT instrument, pos, volume, unnest(range(0, 2000)) AS d FROM bars),
{_poisson_sql()},
b AS (SELECT instrument, d, sum(volume * k) / sum(k) AS m FROM w GROUP BY 1, 2),
q AS (SELECT instrument, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM b GROUP BY 1),
c AS (SELECT instrument, avg(volume) AS mean FROM bars GROUP BY 1)
SELECT instrument, {r("mean", digits=6)}, {r("lower", digits=6)}, {r("upper", digits=6)} FROM c JOIN q USING (instrument)"""




QUERIES = {
    "tick_bars_5min": (bars_query("5min"), bars_oracle("5min")),
    "tick_bars_1h": (bars_query("1h"), bars_oracle("1h")),
    "tick_bars_1d": (bars_query("1d"), bars_oracle("1d")),
    "daily_order_bars": (daily_order_bars, DAILY_ORDER_BARS),
    "resample_with_quotes": (quoted_resample, QUOTED_RESAMPLE),
    "source_timeframe": (spacing, SPACING),
    "price_features": (feature_query(feat.PRICE), feature_oracle(feat.PRICE)),
    "volatility_features": (feature_query(feat.VOLATILITY), feature_oracle(feat.VOLATILITY, True)),
    "scores_beside_spikes": (spiked_query, SPIKED_ORACLE),
    "volume_features": (feature_query(feat.VOLUME), feature_oracle(feat.VOLUME)),
    "range_features": (feature_query(feat.RANGE), feature_oracle(feat.RANGE)),
    "clock_features": (feature_query(feat.CLOCK), feature_oracle(feat.CLOCK)),
    "forward_targets": (targets_query, TARGETS_ORACLE),
    "feature_matrix": (matrix_summary, MATRIX_SUMMARY),
    "signal_scores": (scores_query, SCORES_ORACLE),
    "information_coefficient": (ic_query, IC_ORACLE),
    "alpha_decay": (decay_query, DECAY_ORACLE),
    "ic_by_label": (labelled_ic, LABELLED_ORACLE),
    "rolling_ic": (rolling_query, ROLLING_ORACLE),
    "sharpe_significance": (sharpe_query, SHARPE_ORACLE),
    "bonferroni": (bonferroni_query, BONFERRONI_ORACLE),
    "bootstrap_mean": (bootstrap_query, BOOTSTRAP_ORACLE),
}
