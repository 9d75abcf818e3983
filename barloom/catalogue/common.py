"""Shared inputs of the registered queries, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.timeframes import minutes
from barloom.operators.bars import tick_bars
from barloom.operators.positions import with_position
from barloom.session import configure, materialized


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ticks: the event type is the instrument, the value the price."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("instrument"), "ts", F.col("value").alias("price"), "event_id"
    )


def event_bars(spark: SparkSession, sf: str, timeframe: str = "1h") -> DataFrame:
    return tick_bars(ticks(spark, sf).where("price > 0"), timeframe, tie=["event_id"])


def placed_bars(spark: SparkSession, sf: str, timeframe: str = "1h") -> DataFrame:
    """Bars with positions, stored once as a research run would load them."""
    return materialized(with_position(materialized(event_bars(spark, sf, timeframe))))


def rounded(df: DataFrame, digits: int = 8, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every DOUBLE column for comparison; zero has no sign."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in skip else F.col(c)
            for c, t in df.dtypes
        ]
    )


def r(x: str, name: str | None = None, digits: int = 8) -> str:
    out = f"CASE WHEN round({x}, {digits}) = 0 THEN 0.0 ELSE round({x}, {digits}) END"
    return f"{out} AS {name or x}"


def ratio_sql(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


TICKS = """ticks AS (
  SELECT event_type AS instrument, ts, value AS price, event_id FROM events WHERE value > 0)"""


def bars_sql(timeframe: str = "1h", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT instrument, time_bucket(INTERVAL '{minutes(timeframe)} minutes', ts) AS ts,
         arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM ticks GROUP BY 1, 2)"""


def placed_sql(timeframe: str = "1h") -> str:
    return f"""{TICKS},
{bars_sql(timeframe, "raw_bars")},
bars AS (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS pos,
         count(*) OVER (PARTITION BY instrument) AS n_bars FROM raw_bars)"""


def features_sql(source: str, out: str, part: str, horizons=(), ewma: bool = False) -> str:
    """CTEs computing the features of `source` rows within `part`, plain sliding frames."""

    def w(n: int) -> str:
        return f"(PARTITION BY {part} ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    whole = f"(PARTITION BY {part} ORDER BY pos)"

    def full(fn: str, x: str, n: int) -> str:
        return f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {fn}({x}) OVER {w(n)} END"

    lag = lambda x, n: f"lag({x}, {n}) OVER {whole}"
    single = ["ln(close) - " + lag("ln(close)", 1) + " AS log_return_1"]
    for n in (5, 10, 20, 50):
        single.append(f"close / {lag('close', n)} - 1 AS return_{n}")
        single.append(f"ln(close) - {lag('ln(close)', n)} AS momentum_{n}")
    single.append(f"volume / nullif({lag('volume', 5)}, 0) - 1 AS volume_change_5")
    single.append(f"close / {lag('close', 1)} - 1 AS ret1")
    single.append("nullif(high - low, 0) AS rng")
    single.append("ln(high / low) * ln(high / low) AS hl2")
    for h in horizons:
        single.append(f"lead(ln(close), {h}) OVER {whole} - ln(close) AS future_return_{h}")
    rolled = []
    for n in (20, 50):
        rolled.append(
            f"(close - {full('avg', 'close', n)}) / nullif({full('stddev_samp', 'close', n)}, 0) AS zscore_{n}"
        )
    rolled.append(f"close / {full('avg', 'close', 20)} - 1 AS dist_from_ma_20")
    for n in (10, 20, 50):
        rolled.append(f"{full('stddev_samp', 'log_return_1', n)} * sqrt({n}) AS realized_vol_{n}".replace("CASE", "(CASE").replace("END *", "END) *"))
    rolled.append(f"sqrt({full('avg', 'hl2', 20)}) / (2 * sqrt(ln(2))) AS parkinson_vol_20")
    rolled.append(
        f"(volume - {full('avg', 'volume', 20)}) / nullif({full('stddev_samp', 'volume', 20)}, 0) AS volume_zscore_20"
    )
    rolled.append(f"ret1 / nullif({full('avg', 'volume', 20)}, 0) AS volume_norm_return")
    rolled.append(
        f"({full('avg', 'volume', 10)}) / nullif({full('avg', 'volume', 50)}, 0) AS activity_intensity_10"
    )
    rolled.append("(close - low) / rng AS close_loc_in_range")
    rolled.append("rng / close AS bar_range_pct")
    rolled.append(
        f"(rng - {full('avg', 'rng', 20)}) / nullif({full('stddev_samp', 'rng', 20)}, 0) AS range_zscore_20"
    )
    rolled += [
        "sin(2 * pi() * hour(ts) / 24) AS hour_sin",
        "cos(2 * pi() * hour(ts) / 24) AS hour_cos",
        "sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin",
        "cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos",
        "CAST(hour(ts) BETWEEN 7 AND 15 AS INTEGER) AS session_london",
        "CAST(hour(ts) BETWEEN 12 AND 20 AS INTEGER) AS session_ny",
        "CAST(hour(ts) BETWEEN 0 AND 8 AS INTEGER) AS session_tokyo",
    ]
    last = [
        "realized_vol_10 / nullif(realized_vol_50, 0) AS vol_ratio_10_50",
        f"realized_vol_10 - {lag('realized_vol_10', 5)} AS vol_change_10",
        *[f"CAST(sign(future_return_{h}) AS DOUBLE) AS future_direction_{h}" for h in horizons],
    ]
    base = out if not ewma else f"{out}_base"
    sql = f"""{out}_1 AS (SELECT *, {", ".join(single)} FROM {source}),
{out}_2 AS (SELECT *, {", ".join(rolled)} FROM {out}_1),
{base} AS (SELECT *, {", ".join(last)} FROM {out}_2)"""
    if not ewma:
        return sql
    spreads = []
    for span in (10, 30):
        weight = f"pow({1 - 2 / (span + 1)!r}, a.pos - b.pos)"
        x = "b.log_return_1"
        sw, sw2 = f"sum({weight})", f"sum({weight} * {weight})"
        var = f"(sum({weight}*{x}*{x})/{sw} - pow(sum({weight}*{x})/{sw}, 2))"
        spreads.append(
            f"CASE WHEN count(*) > 1 THEN sqrt({var} * {sw}*{sw} / ({sw}*{sw} - {sw2})) END AS ewma_vol_{span}"
        )
    return f"""{sql},
{out}_e AS (SELECT a.{part}, a.pos, {", ".join(spreads)} FROM {out}_1 a JOIN {out}_1 b
  ON a.{part} = b.{part} AND b.pos <= a.pos AND b.pos > a.pos - 700 AND b.log_return_1 IS NOT NULL
  GROUP BY 1, 2),
{out} AS (SELECT f.*, e.ewma_vol_10, e.ewma_vol_30 FROM {base} f
  LEFT JOIN {out}_e e ON f.{part} = e.{part} AND f.pos = e.pos)"""


SIGNALS_SQL = {
    "momentum_5": "coalesce(momentum_5, 0)",
    "momentum_20": "coalesce(momentum_20, 0)",
    "momentum_50": "coalesce(momentum_50, 0)",
    "mean_reversion_20": "coalesce(zscore_20, 0)",
    "mean_reversion_50": "coalesce(zscore_50, 0)",
    "vol_adjusted_momentum_10": (
        "coalesce(coalesce(momentum_10, 0) / (abs(nullif(vol_ratio_10_50, 0)) + 1e-6), 0)"
    ),
    "microstructure_proxy": "coalesce(close_loc_in_range, 0.5) - 0.5",
}


def scores_sql(source: str, out: str, part: str) -> str:
    scores = []
    for name, raw in SIGNALS_SQL.items():
        sign = "-" if name.startswith("mean_reversion") else ""
        w = f"OVER (PARTITION BY {part})"
        z = f"(({raw}) - avg({raw}) {w}) / (stddev_samp({raw}) {w} + 1e-12)"
        scores.append(
            f"CASE WHEN count(*) {w} < 2 THEN 0.0 ELSE"
            f" {sign}(greatest(-3.0, least(3.0, coalesce({z}, 0))) / 3) END AS score_{name}"
        )
    return f"{out} AS (SELECT *, {', '.join(scores)} FROM {source})"


def long_scores_sql(source: str, out: str, keys: str, horizons) -> str:
    """One row per key, bar, signal and horizon."""
    parts = [
        f"SELECT {keys}, pos, '{s}' AS signal, {h} AS horizon, score_{s} AS score,"
        f" future_return_{h} AS fwd FROM {source}"
        for s in SIGNALS_SQL
        for h in horizons
    ]
    return f"{out} AS ({' UNION ALL '.join(parts)})"


def ic_sql(source: str, out: str, keys: str) -> str:
    """Average-rank correlation of `score` and `fwd` per `keys`."""

    def rank(x: str) -> str:
        return (
            f"rank() OVER (PARTITION BY {keys} ORDER BY {x})"
            f" + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"
        )

    return f"""{out}_pairs AS (SELECT * FROM {source} WHERE score IS NOT NULL AND fwd IS NOT NULL),
{out}_ranks AS (SELECT {keys}, {rank("score")} AS rs, {rank("fwd")} AS rf FROM {out}_pairs),
{out} AS (SELECT {keys}, count(*) AS n_obs,
  CASE WHEN count(*) >= 30 AND stddev_pop(rs) > 0 AND stddev_pop(rf) > 0
       THEN greatest(-1.0, least(1.0, corr(rs, rf))) END AS ic
  FROM {out}_ranks GROUP BY ALL)"""


def p_sql(t: str, df: str, steps: int = 4000) -> str:
    """Two-sided Student t tail by Simpson's rule over the angle atan(t / sqrt(df))."""
    start = f"atan(abs({t}) / sqrt({df}))"
    h = f"((pi() / 2 - {start}) / {steps})"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    body = f"list_sum(list_transform(range(0, {steps} + 1), lambda i: {weight} * pow(greatest(cos({start} + i * {h}), 0), {df} - 1)))"
    front = f"2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    return f"(CASE WHEN {t} IS NULL THEN NULL ELSE {front} * {h} / 3 * {body} END)"


def with_p_sql(source: str, out: str) -> str:
    t = "CASE WHEN 1 - ic * ic <= 0 THEN 1e9 ELSE abs(ic) * sqrt((n_obs - 2) / (1 - ic * ic)) END"
    return f"""{out}_t AS (SELECT *, {t} AS t_ic FROM {source}),
{out}_p AS (SELECT *, {p_sql("t_ic", "(n_obs - 2)")} AS p_value FROM {out}_t),
{out} AS (SELECT *, coalesce(p_value < 0.05, false) AS significant FROM {out}_p)"""


def folds_sql(source: str, out: str, plan, tail: int, role: str) -> str:
    """Slices by joining bars to the list of complete folds."""
    start = 0 if role == "train" else plan.train + plan.embargo
    length = plan.train if role == "train" else plan.test
    return f"""{out}_k AS (SELECT instrument, unnest(range(0,
    CASE WHEN max(n_bars) - {tail} >= {plan.span}
         THEN (max(n_bars) - {tail} - {plan.span}) // {plan.step} + 1 ELSE 0 END)) AS fold_id
  FROM {source} GROUP BY 1),
{out} AS (SELECT b.*, CAST(k.fold_id AS INTEGER) AS fold_id FROM {source} b JOIN {out}_k k
  ON b.instrument = k.instrument AND b.pos >= k.fold_id * {plan.step} + {start}
  AND b.pos < k.fold_id * {plan.step} + {start} + {length})"""


def col(name: str) -> Column:
    return F.col(name)
