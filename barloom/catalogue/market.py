"""Registered queries: data quality, order book, regimes and the model ladder."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalogue.common import (
    TICKS,
    bars_sql,
    event_bars,
    features_sql,
    folds_sql,
    placed_bars,
    placed_sql,
    r,
    rounded,
    table,
    ticks,
)
from barloom.operators import book, quality
from barloom.operators.features import FEATURES, feature_matrix
from barloom.operators.folds import FoldPlan, assign_folds
from barloom.operators.ladder import NAIVE, ladder_errors, predict_ladder
from barloom.operators.regimes import (
    PASSES,
    TOLERANCE,
    apply_regimes,
    causal_regimes,
    current_regime,
    detect_regimes,
    fit_regimes,
    series_inputs,
)
from barloom.session import materialized

# --- quality -------------------------------------------------------------------


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a raw bar with planted defects; times rounded to ten minutes
    so that many repeat. `event_id` gives the file position."""
    e = table(spark, sf, "events")
    k, v = F.col("event_id"), F.col("value")
    return e.select(
        F.col("event_type").alias("instrument"),
        F.floor(k / 1000).alias("block"),
        k.alias("line"),
        F.when(k % 97 != 0, F.window("ts", "10 minutes").start).alias("ts"),
        F.when(k % 89 != 0, v).alias("open"),
        F.when(k % 83 == 0, v / 2).otherwise(v + 1).alias("high"),
        F.when(k % 79 == 0, v * 2).otherwise(v - 0.5).alias("low"),
        v.alias("close"),
        F.when(k % 5 != 0, F.col("user_id").cast("double") - 3).alias("volume"),
    )


RAW = """raw AS (SELECT event_type AS instrument, event_id AS line,
  CASE WHEN event_id % 97 <> 0 THEN time_bucket(INTERVAL '10 minutes', ts) END AS ts,
  CASE WHEN event_id % 89 <> 0 THEN value END AS open,
  CASE WHEN event_id % 83 = 0 THEN value / 2 ELSE value + 1 END AS high,
  CASE WHEN event_id % 79 = 0 THEN value * 2 ELSE value - 0.5 END AS low,
  value AS close, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS DOUBLE) - 3 END AS volume FROM events)"""

BAD_OHLC = "(high < low OR high < open OR high < close OR low > open OR low > close)"
DEFECTS = f"""{RAW},
d AS (SELECT *, row_number() OVER (PARTITION BY instrument, ts ORDER BY line) AS nth,
  CASE WHEN ts IS NULL THEN 'invalid_timestamp'
       WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'non_numeric_price'
       WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'invalid_price'
       WHEN {BAD_OHLC} THEN 'invalid_ohlc' END AS defect FROM raw)"""


def removal_query(spark: SparkSession, sf: str) -> DataFrame:
    return quality.row_accounting(raw_rows(spark, sf))


REMOVAL_ORACLE = f"""WITH {DEFECTS}
SELECT instrument, count(*) AS uploaded_rows, count(*) FILTER (WHERE defect IS NULL) AS source_valid_rows,
  count(*) FILTER (WHERE defect IS NULL AND nth = 1) AS usable_rows,
  count(*) FILTER (WHERE NOT (defect IS NULL AND nth = 1)) AS removed_rows,
  {", ".join(f"count(*) FILTER (WHERE defect = '{x}') AS {x}" for x in quality.REASONS[:4])},
  count(*) FILTER (WHERE defect IS NULL AND nth > 1) AS duplicate_timestamp
FROM d GROUP BY 1"""


def normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.normalize(raw_rows(spark, sf)))


NORMALIZE_ORACLE = f"""WITH {DEFECTS}
SELECT instrument, ts, {", ".join(r(c) for c in ("open", "high", "low", "close"))}, {r("coalesce(volume, 0)", "volume")}
FROM d WHERE nth = 1 AND defect IS NULL"""


def clean_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.clean(raw_rows(spark, sf)).drop("block"))


CLEAN_ORACLE = f"""WITH {DEFECTS}
SELECT instrument, ts, line, {", ".join(r(c) for c in ("open", "high", "low", "close", "volume"))}
FROM d WHERE nth = 1 AND ts IS NOT NULL AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low"""


def validate_query(spark: SparkSession, sf: str) -> DataFrame:
    return quality.validate(raw_rows(spark, sf))


VALIDATE_ORACLE = f"""WITH {RAW},
o AS (SELECT *, ts < max(ts) OVER (PARTITION BY instrument ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM raw),
c AS (SELECT instrument, count(*) AS n, count(ts) AS nt,
  count(*) - count(DISTINCT ts) - CASE WHEN count(*) > count(ts) THEN 1 ELSE 0 END AS dup,
  coalesce(bool_or(back), false) AS back,
  count(*) FILTER (WHERE open IS NOT NULL AND high < low AND close IS NOT NULL) AS swapped,
  count(*) FILTER (WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL) AS complete,
  count(*) FILTER (WHERE {BAD_OHLC}) AS bad,
  {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}, count(*) FILTER (WHERE {c} <= 0) AS low_{c}" for c in ("open", "high", "low", "close"))}
  FROM o GROUP BY 1)
SELECT instrument, 'duplicate_timestamps' AS code, 'warning' AS severity, dup AS n FROM c WHERE dup > 0
UNION ALL SELECT instrument, 'unordered_timestamps', 'warning', 1 FROM c WHERE back
{" ".join(f"UNION ALL SELECT instrument, 'invalid_prices:{c}', 'warning', low_{c} FROM c WHERE low_{c} > 0 AND null_{c} <= n * 0.5" for c in ("open", "high", "low", "close"))}
UNION ALL SELECT instrument, 'ohlc_inconsistency', 'warning', bad FROM c WHERE bad > 0 AND swapped <= 0.9 * complete
UNION ALL SELECT instrument, 'insufficient_rows', 'error', n FROM c WHERE n < 200"""


def ticks_query(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    raw = ticks(spark, sf).select(
        "instrument",
        F.when(k % 97 != 0, F.col("ts")).alias("ts"),
        F.when(k % 89 != 0, F.col("price") - 2).alias("price"),
        F.when(k % 7 != 0, (k % 50 - 1).cast("double")).alias("volume"),
        F.when(k % 14 == 0, "").when(k % 7 == 0, "n/a").otherwise("x").alias("volume_text"),
    )
    return quality.tick_accounting(raw)


TICKS_ORACLE = """WITH t AS (SELECT event_type AS instrument, event_id AS k,
  CASE WHEN event_id % 97 <> 0 THEN ts END AS ts, CASE WHEN event_id % 89 <> 0 THEN value - 2 END AS price,
  CASE WHEN event_id % 7 <> 0 THEN event_id % 50 - 1 END AS volume FROM events),
b AS (SELECT *, ts IS NULL AS b1, price IS NULL AS b2, coalesce(price <= 0, false) AS b3,
  coalesce(volume < 0, false) OR (k % 7 = 0 AND k % 14 <> 0) AS b4 FROM t)
SELECT instrument, count(*) AS uploaded_rows, count(*) FILTER (WHERE NOT (b1 OR b2 OR b3 OR b4)) AS source_valid_rows,
  count(*) FILTER (WHERE b1 OR b2 OR b3 OR b4) AS removed_rows, count(*) FILTER (WHERE b1) AS invalid_timestamp,
  count(*) FILTER (WHERE b2) AS non_numeric_price, count(*) FILTER (WHERE b3) AS invalid_price,
  count(*) FILTER (WHERE b4) AS invalid_volume FROM b GROUP BY 1"""


def audit_query(spark: SparkSession, sf: str) -> DataFrame:
    return quality.audit(raw_rows(spark, sf))


AUDIT_ORACLE = f"""WITH {RAW},
o AS (SELECT *, ts < max(ts) OVER (PARTITION BY instrument ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM raw)
SELECT instrument, {", ".join(f"count(*) FILTER (WHERE {c} <= 0) AS nonpositive_{c}, count(*) FILTER (WHERE {c} IS NULL) AS missing_{c}" for c in ("open", "high", "low", "close"))},
  count(*) FILTER (WHERE high < low) AS high_below_low, count(*) FILTER (WHERE volume < 0) AS negative_volume,
  count(*) - count(DISTINCT ts) - CASE WHEN count(*) > count(ts) THEN 1 ELSE 0 END AS duplicate_timestamps,
  coalesce(bool_or(back), false) AS unordered FROM o GROUP BY 1"""


def bar_checks_query(spark: SparkSession, sf: str) -> DataFrame:
    return quality.bar_checks(event_bars(spark, sf, "1d"))


BAR_CHECKS_ORACLE = f"""WITH {TICKS}, {bars_sql("1d")},
c AS (SELECT instrument, count(*) AS n, count(*) FILTER (WHERE {BAD_OHLC} OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS bad FROM bars GROUP BY 1)
SELECT instrument, 'insufficient_rows_after_aggregation' AS code, 'error' AS severity, n FROM c WHERE n < 200
UNION ALL SELECT instrument, 'aggregated_ohlc_invalid', 'error', bad FROM c WHERE bad > 0"""


def spacing_query(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between single ticks: at tick level some are far above the median."""
    return rounded(quality.irregular_spacing(ticks(spark, sf)))


SPACING_ORACLE = f"""WITH g AS (SELECT event_type AS instrument, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS DOUBLE) AS gap FROM events),
m AS (SELECT instrument, quantile_cont(gap, 0.5) AS med FROM g WHERE gap > 0 GROUP BY 1)
SELECT instrument, {r("max(med)", "median_gap_us")}, count(*) FILTER (WHERE gap > med * 100) AS extreme_gaps
FROM g JOIN m USING (instrument) WHERE gap > 0 GROUP BY 1"""


def anomalies_query(spark: SparkSession, sf: str) -> DataFrame:
    """5-minute bars, where ranges far above the local median are common."""
    return quality.range_anomalies(placed_bars(spark, sf, "5min"), chunk_rows=1024).select(
        "instrument", "ts", "range_anomaly"
    )


ANOMALIES_ORACLE = f"""WITH {placed_sql("5min")},
w AS (SELECT *, high - low AS rng,
  quantile_cont(high - low, 0.5) OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS med,
  count(*) OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS seen FROM bars)
SELECT instrument, ts, seen >= 10 AND rng > med * 20 AND n_bars > 50 AS range_anomaly FROM w"""


def confidence_query(spark: SparkSession, sf: str) -> DataFrame:
    """Status of the raw rows as one upload per instrument and day."""
    daily = raw_rows(spark, sf).withColumn("day", F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date")))
    facts = quality.row_accounting(daily.withColumn("instrument", F.concat_ws(" ", "instrument", F.col("day").cast("string"))))
    status = quality.confidence(
        F.col("uploaded_rows"),
        F.col("usable_rows"),
        F.when(F.col("usable_rows") < 20, 1).otherwise(0),
        F.col("invalid_ohlc"),
    )
    return facts.select("instrument", "uploaded_rows", "usable_rows", status.alias("status"))


CONFIDENCE_ORACLE = f"""WITH {DEFECTS},
g AS (SELECT instrument || ' ' || CAST(coalesce(CAST(ts AS DATE), DATE '1970-01-01') AS VARCHAR) AS instrument, defect, nth FROM d),
c AS (SELECT instrument, count(*) AS uploaded_rows, count(*) FILTER (WHERE defect IS NULL AND nth = 1) AS usable_rows,
  count(*) FILTER (WHERE defect = 'invalid_ohlc') AS warned FROM g GROUP BY 1)
SELECT instrument, uploaded_rows, usable_rows, CASE WHEN usable_rows < 20 THEN 'DATA_REJECTED'
  WHEN usable_rows < uploaded_rows * 0.95 AND uploaded_rows - usable_rows > 100 THEN 'DATA_NEEDS_REVIEW'
  WHEN warned > 0 OR usable_rows < uploaded_rows THEN 'DATA_READY_WITH_CLEANING' ELSE 'DATA_READY' END AS status FROM c"""

# --- order book ----------------------------------------------------------------


def resting(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as resting orders of one book per supplier. Status O bids below
    F's asks; prices are whole dozens, so levels hold many orders."""
    lines = table(spark, sf, "lineitem")
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 12) * 0.25
    return lines.select(
        F.col("l_suppkey").alias("instrument"),
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        F.when(F.col("l_linestatus") == "O", 1000 - unit).otherwise(1001 + unit).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"),
    )


RESTING = """o AS (SELECT l_suppkey AS instrument, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS id,
  CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
  CASE WHEN l_linestatus = 'O' THEN 1000 - floor(l_extendedprice / l_quantity / 12) * 0.25
       ELSE 1001 + floor(l_extendedprice / l_quantity / 12) * 0.25 END AS price,
  l_quantity AS quantity, CAST(epoch(l_shipdate) AS BIGINT) AS ts FROM lineitem)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier's book is hit by twelve requests of different size and limit."""
    books = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("instrument"))
    k = F.col("k")
    return books.select("instrument", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k")).select(
        "instrument",
        (F.col("instrument") * 100 + k).alias("request_id"),
        F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"),
        (k * k * 55.5).alias("quantity"),
        F.when(k % 3 == 0, F.lit(None))
        .otherwise(F.when(k % 2 == 0, 1001 + k).otherwise(1000 - k))
        .cast("double")
        .alias("limit_price"),
        (k * 1000).cast("bigint").alias("submit_time"),
    )


REQUESTS = """q AS (SELECT s_suppkey AS instrument, s_suppkey * 100 + k AS request_id,
  CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, k * k * 55.5 AS quantity,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN 1001.0 + k ELSE 1000.0 - k END AS limit_price,
  k * 1000 AS submit_time FROM supplier, (SELECT unnest(range(1, 13)) AS k))"""

FILLS = f"""{RESTING}, {REQUESTS},
m AS (SELECT q.instrument, q.side, request_id, q.quantity AS wanted, o.id, o.price, o.quantity AS resting,
  coalesce(sum(o.quantity) OVER (PARTITION BY request_id
    ORDER BY CASE WHEN q.side = 'buy' THEN o.price ELSE -o.price END, o.ts, o.id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM q JOIN o ON q.instrument = o.instrument AND q.side <> o.side
    AND (limit_price IS NULL OR CASE WHEN q.side = 'buy' THEN o.price <= limit_price ELSE o.price >= limit_price END)),
fl AS (SELECT *, least(resting, wanted - ahead) AS fill FROM m WHERE ahead < wanted)"""


def top_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(book.top_of_book(resting(spark, sf)))


TOP_ORACLE = f"""WITH {RESTING}, t AS (SELECT instrument, max(price) FILTER (WHERE side = 'buy') AS best_bid,
  min(price) FILTER (WHERE side = 'sell') AS best_ask, count(*) FILTER (WHERE side = 'buy') AS bid_orders,
  count(*) FILTER (WHERE side = 'sell') AS ask_orders FROM o GROUP BY 1)
SELECT instrument, best_bid, best_ask, bid_orders, ask_orders, (best_bid + best_ask) / 2 AS mid_price,
  coalesce(best_ask - best_bid, 0) AS spread FROM t"""


def levels_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(book.price_levels(resting(spark, sf)))


LEVELS_ORACLE = f"""WITH {RESTING} SELECT instrument, side, price, sum(quantity) AS quantity, count(*) AS orders FROM o GROUP BY 1, 2, 3"""


def depth_at_query(spark: SparkSession, sf: str) -> DataFrame:
    """Depth at every quarter within five of each book's middle."""
    books = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("instrument"))
    steps = books.select("instrument", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k"))
    probes = steps.select("instrument", (F.col("k") * 0.25 + 995.5).alias("price"))
    return rounded(book.depth_at(resting(spark, sf), probes))


DEPTH_AT_ORACLE = f"""WITH {RESTING}, p AS (SELECT s_suppkey AS instrument, 995.5 + k * 0.25 AS price FROM supplier, (SELECT unnest(range(0, 41)) AS k))
SELECT p.instrument, CAST(p.price AS DOUBLE) AS price, coalesce(sum(quantity) FILTER (WHERE side = 'buy'), 0) AS bid_depth,
  coalesce(sum(quantity) FILTER (WHERE side = 'sell'), 0) AS ask_depth
FROM p LEFT JOIN o ON p.instrument = o.instrument AND p.price = o.price GROUP BY 1, 2"""


def depth_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(book.depth_within(resting(spark, sf), 5))


DEPTH_ORACLE = f"""WITH {RESTING}, k AS (SELECT *, dense_rank() OVER (PARTITION BY instrument, side
  ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END) AS lv FROM o)
SELECT instrument, coalesce(sum(quantity) FILTER (WHERE side = 'buy' AND lv <= 5), 0) AS bid_depth,
  coalesce(sum(quantity) FILTER (WHERE side = 'sell' AND lv <= 5), 0) AS ask_depth FROM k GROUP BY 1"""


def sweep_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(book.sweep(resting(spark, sf), requests(spark, sf)), 6)


SWEEP_ORACLE = f"""WITH {FILLS} SELECT instrument, side, request_id, id AS order_id, price AS fill_price,
  {r("fill", "fill_quantity", 6)} FROM fl"""


def execution_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(book.execution_report(resting(spark, sf), requests(spark, sf), latency=7), 6)


EXECUTION_ORACLE = f"""WITH {FILLS},
t AS (SELECT request_id, sum(fill) AS filled, sum(fill * price) AS notional FROM fl GROUP BY 1),
b AS (SELECT instrument, (max(price) FILTER (WHERE side = 'buy') + min(price) FILTER (WHERE side = 'sell')) / 2 AS mid FROM o GROUP BY 1)
SELECT q.instrument, q.request_id, q.side, {r("coalesce(filled, 0)", "filled_quantity", 6)},
  {r("quantity - coalesce(filled, 0)", "remaining_quantity", 6)}, {r("coalesce(notional / filled, 0)", "average_price", 6)},
  {r("CASE WHEN mid IS NOT NULL AND filled > 0 THEN CASE WHEN q.side = 'buy' THEN 1 ELSE -1 END * (notional / filled - mid) ELSE 0 END", "slippage", 6)},
  submit_time + 7 AS execution_time, quantity - coalesce(filled, 0) <= 1e-12 AS fully_filled
FROM q LEFT JOIN t USING (request_id) LEFT JOIN b ON q.instrument = b.instrument"""

# --- regimes -------------------------------------------------------------------

PLAN = FoldPlan(train=300, test=100, step=100, embargo=10)


SCORE = "ln(w) - " + " - ".join(f"(ln(v{d}) + pow(z{d} - m{d}, 2) / v{d}) / 2" for d in range(3))


def em_sql(source: str, keys: str) -> str:
    """Mixture CTEs (recursive) over `source(keys, pos, ret, vol, trend)`; parameters in long form.

    A group goes on while its mean log-likelihood moves by the tolerance.
    """
    k = ", ".join(f"s.{c.strip()}" for c in keys.split(","))
    first = {"w": 0.25, "m0": 0.0, "m1": "cos", "m2": "sin", "v0": 1.0, "v1": 1.0, "v2": 1.0}

    def number(x, i: int) -> str:
        return f"{x if isinstance(x, float) else getattr(math, x)(math.pi * i / 2)!r}::DOUBLE"

    start = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS c, {', '.join(f'{number(x, i)} AS {n}' for n, x in first.items())},"
        " NULL::DOUBLE AS ll, false AS done, 0 AS t FROM em_scale"
        for i in range(4)
    )
    over = f"OVER (PARTITION BY {keys}, pos)"
    means = [f"sum(p * z{d}) / (sum(p) + 1e-10)" for d in range(3)]
    step = f"""SELECT {keys}, c, (sum(p) + 1e-10) / count(*), {", ".join(means)},
    {", ".join(f"greatest(sum(p * z{d} * z{d}) / (sum(p) + 1e-10) - pow({m}, 2), 0) + 1e-6" for d, m in enumerate(means))},
    avg(l), coalesce(abs(avg(l) - any_value(ll)) < {TOLERANCE!r}, false), t + 1
  FROM (SELECT *, e / sum(e) {over} AS p, top + ln(sum(e) {over}) AS l
    FROM (SELECT *, exp(s - top) AS e FROM (SELECT *, max(s) {over} AS top
      FROM (SELECT {keys}, pos, z0, z1, z2, c, ll, t, {SCORE} AS s FROM em_z JOIN em_p USING ({keys}) WHERE NOT done AND t < {PASSES}))))
  GROUP BY {keys}, c, t"""
    return f"""em_scale AS (SELECT {keys}, avg(ret) AS a0, avg(vol) AS a1, avg(trend) AS a2, stddev_pop(ret) AS s0,
  stddev_pop(vol) AS s1, stddev_pop(trend) AS s2 FROM {source} GROUP BY {keys}),
em_z AS MATERIALIZED (SELECT {k}, s.pos, (ret - a0) / s0 AS z0, (vol - a1) / s1 AS z1, (trend - a2) / s2 AS z2
  FROM {source} s JOIN em_scale e USING ({keys})),
em_p AS ({start} UNION ALL {step}),
em_f AS (SELECT * FROM em_p QUALIFY row_number() OVER (PARTITION BY {keys}, c ORDER BY t DESC) = 1),
em_u AS (SELECT {keys}, c, w, m1 * s1 + a1 AS vol, m2 * s2 + a2 AS trend FROM em_f JOIN em_scale USING ({keys})),
em_n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {keys} ORDER BY vol DESC, c) = 1
    AND vol > 1.3 * quantile_cont(vol, 0.5) OVER (PARTITION BY {keys}) THEN 'high_vol'
  WHEN trend > 1e-5 THEN 'trend_up' WHEN trend < -1e-5 THEN 'trend_down' ELSE 'mean_revert' END AS name FROM em_u)"""


def posterior_sql(out: str, rows: str, params: str, keys: str) -> str:
    over = f"OVER (PARTITION BY {keys}, pos)"
    return f"""{out}_s AS (SELECT {keys}, pos, z0, z1, z2, c, {SCORE} AS s FROM {rows} JOIN {params} USING ({keys})),
{out}_e AS (SELECT *, exp(s - max(s) {over}) AS e FROM {out}_s),
{out} AS (SELECT *, e / sum(e) {over} AS p FROM {out}_e)"""


INPUTS_SQL = f"""{placed_sql()}, {features_sql("bars", "f", "instrument")},
x AS (SELECT instrument, ts, pos, log_return_1 AS ret, realized_vol_20 / sqrt(20) AS vol, momentum_20 / 20 AS trend
  FROM f WHERE realized_vol_20 IS NOT NULL)"""


def inputs_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series_inputs(placed_bars(spark, sf)))


INPUTS_ORACLE = f"""WITH {INPUTS_SQL} SELECT instrument, ts, pos, {r("ret")}, {r("vol")}, {r("trend")} FROM x"""


def components_query(spark: SparkSession, sf: str) -> DataFrame:
    """Named components of each instrument's mixture."""
    fitted = fit_regimes(series_inputs(placed_bars(spark, sf)), ["instrument"])
    return rounded(
        fitted.select("instrument", F.inline("components")).select(
            "instrument", "component", "name", "vol", "trend"
        ),
        6,
    )


COMPONENTS_ORACLE = f"""WITH RECURSIVE {INPUTS_SQL}, {em_sql("x", "instrument")}
SELECT instrument, CAST(c AS INTEGER) AS component, name, {r("vol", digits=6)}, {r("trend", digits=6)} FROM em_n"""


def labels_query(spark: SparkSession, sf: str) -> DataFrame:
    inputs = materialized(series_inputs(placed_bars(spark, sf)))
    fitted = fit_regimes(inputs, ["instrument"])
    labelled = apply_regimes(inputs, fitted, ["instrument"])
    best = F.array_max(F.map_values("probabilities"))
    return rounded(labelled.select("instrument", "ts", "component", "regime", best.alias("probability")), 5)


LABELS_ORACLE = f"""WITH RECURSIVE {INPUTS_SQL}, {em_sql("x", "instrument")}, {posterior_sql("ap", "em_z", "em_f", "instrument")},
b AS (SELECT instrument, pos, arg_max(c, p) AS c, max(p) AS p FROM ap GROUP BY 1, 2)
SELECT b.instrument, x.ts, CAST(b.c AS INTEGER) AS component, n.name AS regime, {r("b.p", "probability", 5)}
FROM b JOIN x ON b.instrument = x.instrument AND b.pos = x.pos JOIN em_n n ON b.instrument = n.instrument AND b.c = n.c"""


def causal_query(spark: SparkSession, sf: str) -> DataFrame:
    """Mixtures fitted on every train slice, labelling every test slice."""
    bars = placed_bars(spark, sf)
    keys = ["instrument", "fold_id"]
    slices = {role: assign_folds(bars, PLAN, 20, roles=[role]).drop("role") for role in ("train", "test")}
    labelled = causal_regimes(slices["train"], slices["test"], keys)
    best = F.array_max(F.map_values("probabilities"))
    return rounded(labelled.select(*keys, "ts", "component", "regime", best.alias("probability"), "causal"), 5)


CAUSAL_ORACLE = f"""WITH RECURSIVE {placed_sql()}, {folds_sql("bars", "tr", PLAN, 20, "train")}, {folds_sql("bars", "te", PLAN, 20, "test")},
{features_sql("tr", "ftr", "instrument, fold_id")}, {features_sql("te", "fte", "instrument, fold_id")},
x AS (SELECT instrument, fold_id, pos, log_return_1 AS ret, realized_vol_20 / sqrt(20) AS vol, momentum_20 / 20 AS trend
  FROM ftr WHERE realized_vol_20 IS NOT NULL),
{em_sql("x", "instrument, fold_id")},
y AS (SELECT f.instrument, f.fold_id, f.ts, f.pos, (log_return_1 - a0) / s0 AS z0, (realized_vol_20 / sqrt(20) - a1) / s1 AS z1,
  (momentum_20 / 20 - a2) / s2 AS z2 FROM fte f JOIN em_scale USING (instrument, fold_id) WHERE realized_vol_20 IS NOT NULL),
{posterior_sql("ap", "y", "em_f", "instrument, fold_id")},
b AS (SELECT instrument, fold_id, pos, arg_max(c, p) AS c, max(p) AS p FROM ap GROUP BY 1, 2, 3)
SELECT b.instrument, b.fold_id, y.ts, CAST(b.c AS INTEGER) AS component, n.name AS regime, {r("b.p", "probability", 5)}, true AS causal
FROM b JOIN y USING (instrument, fold_id, pos) JOIN em_n n ON b.instrument = n.instrument AND b.fold_id = n.fold_id AND b.c = n.c"""


def current_query(spark: SparkSession, sf: str) -> DataFrame:
    inputs = materialized(series_inputs(placed_bars(spark, sf)))
    labelled = apply_regimes(inputs, fit_regimes(inputs, ["instrument"]), ["instrument"])
    return current_regime(labelled).select("instrument", "ts", "regime")


CURRENT_ORACLE = f"""WITH RECURSIVE {INPUTS_SQL}, {em_sql("x", "instrument")}, {posterior_sql("ap", "em_z", "em_f", "instrument")},
b AS (SELECT instrument, pos, arg_max(c, p) AS c FROM ap GROUP BY 1, 2),
l AS (SELECT instrument, max(pos) AS pos FROM x GROUP BY 1)
SELECT b.instrument, x.ts, n.name AS regime FROM b JOIN l USING (instrument, pos)
JOIN x USING (instrument, pos) JOIN em_n n ON b.instrument = n.instrument AND b.c = n.c"""


def _posterior_rows(labelled: DataFrame, *kept: str) -> DataFrame:
    """One row for each posterior of a label."""
    rows = labelled.select("instrument", "ts", "regime", *kept, F.explode("probabilities").alias("column", "probability"))
    return rounded(rows, 5)


def detected_query(spark: SparkSession, sf: str) -> DataFrame:
    """Exploratory regimes of whole series with every posterior."""
    return _posterior_rows(detect_regimes(placed_bars(spark, sf)), "causal")


_POSTERIORS = f"""{INPUTS_SQL}, {em_sql("x", "instrument")}, {posterior_sql("ap", "em_z", "em_f", "instrument")},
named AS (SELECT instrument, c, name, row_number() OVER (PARTITION BY instrument, name ORDER BY c) AS i FROM em_n),
b AS (SELECT instrument, pos, arg_max(c, p) AS c FROM ap GROUP BY 1, 2),
rows_ AS (SELECT x.instrument, x.ts, x.pos, t.name AS regime, n.name || CASE WHEN n.i > 1 THEN '_' || n.i ELSE '' END AS "column", ap.p
  FROM ap JOIN x USING (instrument, pos) JOIN named n ON n.instrument = x.instrument AND n.c = ap.c
  JOIN b ON b.instrument = x.instrument AND b.pos = x.pos JOIN named t ON t.instrument = x.instrument AND t.c = b.c)"""
DETECTED_ORACLE = f"""WITH RECURSIVE {_POSTERIORS}
SELECT instrument, ts, regime, false AS causal, "column", {r("p", "probability", 5)} FROM rows_"""


def current_posterior_query(spark: SparkSession, sf: str) -> DataFrame:
    """The last bar's regime of each instrument with every posterior."""
    return _posterior_rows(current_regime(detect_regimes(placed_bars(spark, sf))))


CURRENT_POSTERIOR_ORACLE = f"""WITH RECURSIVE {_POSTERIORS}
SELECT instrument, ts, regime, "column", {r("p", "probability", 5)} FROM rows_
QUALIFY pos = max(pos) OVER (PARTITION BY instrument)"""

# --- model ladder --------------------------------------------------------------

TARGET = "future_return_5"


def _halves(spark: SparkSession, sf: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """First 60 % of each series to train, the rest to test, ten bars apart."""
    m = materialized(feature_matrix(placed_bars(spark, sf), (1, 5, 10, 20), keep=features))
    share = F.col("pos") / F.col("n_bars")
    return m.where(share < 0.6), m.where((share >= 0.6) & (F.col("pos") - F.floor(F.col("n_bars") * 0.6) >= 10))


def linear_query(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _halves(spark, sf, ["zscore_20"])
    rungs = [NAIVE, "linear_regression"]
    predicted = predict_ladder(train, test, ["zscore_20"], TARGET, rungs)
    return rounded(predicted.select("instrument", "ts", *rungs), 6)


LINEAR_ORACLE = f"""WITH {placed_sql()}, {features_sql("bars", "f", "instrument", (1, 5, 10, 20))},
m AS (SELECT * FROM f WHERE pos < n_bars - 20 AND zscore_20 IS NOT NULL),
c AS (SELECT avg({TARGET}) AS mean, regr_slope({TARGET}, zscore_20) AS b, regr_intercept({TARGET}, zscore_20) AS a
  FROM m WHERE pos / n_bars < 0.6)
SELECT instrument, ts, {r("mean", "naive_mean_baseline", 6)}, {r("a + b * zscore_20", "linear_regression", 6)}
FROM m, c WHERE pos / n_bars >= 0.6 AND pos - floor(n_bars * 0.6) >= 10"""


def trees_query(spark: SparkSession, sf: str) -> DataFrame:
    """All rungs; tree ensembles have no SQL counterpart.

    All features but range_zscore_20, which has no value in nearly all of these bars, so that
    their rows would go.
    """
    features = [f for f in FEATURES if f != "range_zscore_20"]
    train, test = _halves(spark, sf, features)
    rungs = [NAIVE, "linear_regression", "random_forest", "gradient_boosting"]
    predicted = predict_ladder(train, test, features, TARGET, rungs)
    return rounded(ladder_errors(predicted, TARGET, rungs), 6)


QUERIES = {
    "row_removal_reasons": (removal_query, REMOVAL_ORACLE),
    "normalize_bars": (normalize_query, NORMALIZE_ORACLE),
    "clean_bars": (clean_query, CLEAN_ORACLE),
    "validation_issues": (validate_query, VALIDATE_ORACLE),
    "tick_removal_reasons": (ticks_query, TICKS_ORACLE),
    "bar_audit": (audit_query, AUDIT_ORACLE),
    "aggregated_bar_checks": (bar_checks_query, BAR_CHECKS_ORACLE),
    "irregular_spacing": (spacing_query, SPACING_ORACLE),
    "range_anomalies": (anomalies_query, ANOMALIES_ORACLE),
    "data_confidence": (confidence_query, CONFIDENCE_ORACLE),
    "top_of_book": (top_query, TOP_ORACLE),
    "price_levels": (levels_query, LEVELS_ORACLE),
    "depth_at_price": (depth_at_query, DEPTH_AT_ORACLE),
    "depth_within_levels": (depth_query, DEPTH_ORACLE),
    "sweep_fills": (sweep_query, SWEEP_ORACLE),
    "execution_reports": (execution_query, EXECUTION_ORACLE),
    "regime_inputs": (inputs_query, INPUTS_ORACLE),
    "regime_components": (components_query, COMPONENTS_ORACLE),
    "regime_labels": (labels_query, LABELS_ORACLE),
    "causal_regimes": (causal_query, CAUSAL_ORACLE),
    "current_regime": (current_query, CURRENT_ORACLE),
    "detected_regimes": (detected_query, DETECTED_ORACLE),
    "current_regime_posterior": (current_posterior_query, CURRENT_POSTERIOR_ORACLE),
    # Earlier names of the same queries.
    "regime_components_full": (components_query, COMPONENTS_ORACLE),
    "regime_labels_full": (labels_query, LABELS_ORACLE),
    "causal_regimes_full": (causal_query, CAUSAL_ORACLE),
    "current_regime_full": (current_query, CURRENT_ORACLE),
    "linear_model": (linear_query, LINEAR_ORACLE),
    "model_ladder": (trees_query, None),
}
