"""Registered queries: delimited text, parsing, file names, ranges and ingest.

Lines and names are spelled from the given tables, as an upload would hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.catalogue.common import TICKS, bars_sql, event_bars, r, rounded, table
from barloom.catalogue.market import DEFECTS, raw_rows
from barloom.operators.bars import tick_bars
from barloom.operators.quality import cleaning_checks, row_accounting
from barloom.plans.ingest import ingest
from barloom.plans.research import load_bars
from barloom.session import materialized
from barloom.sources import naming, ranges
from barloom.sources.delimited import field_profile, separator_quality
from barloom.sources.parsing import choose_readings, joined_date_time
from barloom.sources.schema import ALIASES, header_test
from barloom.sources.tables import fingerprint

# --- lines and fields ----------------------------------------------------------


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document, as a text nobody promised to be a table."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("block"), F.posexplode(F.split("text", "\n")).alias("line", "value")
    )


def profile_query(spark: SparkSession, sf: str) -> DataFrame:
    return field_profile(document_lines(spark, sf))


def _sql_fields(mark: str) -> str:
    quoted = f"""regexp_replace(value, '(^|{mark})"[^"]*(""[^"]*)*("|$)', '\\1', 'g')"""
    return f"CAST(len(string_split({quoted}, '{mark}')) AS INTEGER)"


PROFILE_ORACLE = rf"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents),
n AS (SELECT value FROM l WHERE trim(value) <> '')
SELECT 'comma' AS separator, {_sql_fields(",")} AS fields, count(*) AS n_lines FROM n GROUP BY ALL
UNION ALL SELECT 'semicolon', {_sql_fields(";")}, count(*) FROM n GROUP BY ALL
UNION ALL SELECT 'tab', {_sql_fields(chr(9))}, count(*) FROM n GROUP BY ALL
UNION ALL SELECT 'space', CAST(len(regexp_split_to_array(regexp_replace(value, '^\s+|\s+$', '', 'g'), '\s+')) AS INTEGER), count(*) FROM n GROUP BY ALL"""


def quality_query(spark: SparkSession, sf: str) -> DataFrame:
    """Separator quality over event lines, a few of which have a field too many."""
    e = table(spark, sf, "events")
    tail = F.when(F.col("event_id") % 211 == 0, ";extra").otherwise("")
    value = F.concat(F.concat_ws(";", F.date_format("ts", "dd.MM.yyyy HH:mm"), "event_type", "user_id"), tail)
    lines = e.select(F.lit(0).alias("block"), F.col("event_id").alias("line"), value.alias("value"))
    return rounded(separator_quality(field_profile(lines)))


QUALITY_ORACLE = """WITH e AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 211 = 0) AS x FROM events)
SELECT 'comma' AS separator, 1 AS fields, 1.0::DOUBLE AS consistency, 0 AS deviating_lines FROM e
UNION ALL SELECT 'tab', 1, 1.0, 0 FROM e UNION ALL SELECT 'space', 2, 1.0, 0 FROM e
UNION ALL SELECT 'semicolon', 3, round((n - x) / n, 8), x FROM e"""


def header_query(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a document's first line would pass for a header."""
    first = table(spark, sf, "documents").select(
        "doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("value")
    )
    marks = F.transform(F.split(F.trim("value"), r"\s+"), naming.normalized_header)
    return first.select("doc_id", header_test(marks).alias("header"))


_KNOWN = ", ".join(f"'{a}'" for a in sorted({a for v in ALIASES.values() for a in v}))
HEADER_ORACLE = rf"""WITH f AS (SELECT doc_id, list_distinct(list_transform(regexp_split_to_array(
    regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g'), '\s+'),
  lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')))) AS h FROM documents)
SELECT doc_id, len(list_intersect(h, [{_KNOWN}])) >= 2 OR (list_contains(h, 'date') AND list_contains(h, 'time')) AS header FROM f"""

# --- parsing -------------------------------------------------------------------


def parse_query(spark: SparkSession, sf: str) -> DataFrame:
    """The same instant in five spellings and a comma price, read back."""
    e = table(spark, sf, "events")
    spelled = e.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"),
        F.concat(
            F.date_format(F.col("ts") + F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd HH:mm:ss"), F.lit("+0530")
        ).alias("shifted"),
        F.date_format("ts", "dd.MM.yyyy HH:mm:ss.SSS").alias("dotted"),
        F.date_format("ts", "dd/MM/yyyy HH:mm").alias("slashed"),
        F.date_format("ts", "yyyyMMdd HHmmss").alias("compact"),
        F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(","))).alias("price"),
        F.format_string("%.3f", "value").alias("plain"),
    )
    times = ["iso", "shifted", "dotted", "slashed", "compact"]
    chosen, _ = choose_readings(spelled, times, ["price", "plain"])
    return rounded(spelled.select("event_id", *[c.alias(n) for n, c in chosen.items()]))


PARSE_ORACLE = """SELECT event_id, ts AS iso, date_trunc('second', ts) AS shifted, date_trunc('millisecond', ts) AS dotted,
  date_trunc('minute', ts) AS slashed, date_trunc('second', ts) AS compact,
  CASE WHEN event_id % 50 <> 0 THEN CAST(printf('%.2f', value) AS DOUBLE) END AS price,
  CAST(printf('%.3f', value) AS DOUBLE) AS plain FROM events"""


def date_time_query(spark: SparkSession, sf: str) -> DataFrame:
    """Date and time that lost their leading zeros, joined and read."""
    e = table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyyMMdd").cast("int").cast("string").alias("Date"),
        F.date_format("ts", "HHmm").cast("int").cast("string").alias("Time"),
    )
    joined = joined_date_time(e, "Date", "Time", "when")
    chosen, _ = choose_readings(joined, ["when"], [])
    return joined.select("event_id", F.col("when").alias("text"), chosen["when"].alias("ts"))


DATE_TIME_ORACLE = """SELECT event_id, strftime(ts, '%Y%m%d %H%M') AS text, date_trunc('minute', ts) AS ts FROM events"""

# --- file names ----------------------------------------------------------------

_CODES = [*naming.CODES, "ABC"]


def names(spark: SparkSession, sf: str) -> DataFrame:
    """One file name per order, from currency codes, separators and periods."""
    codes = F.array(*[F.lit(c) for c in _CODES])
    periods = F.array(*[F.lit(p) for p in ("1", "5", "15", "60", "240", "1440", "7", "")])
    joints = F.array(*[F.lit(j) for j in ("", "_", "-")])
    tails = F.array(*[F.lit(t) for t in (".csv", "_Candlestick_1_M_BID.csv", " export (2).txt")])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = len(_CODES)
    name = F.concat(
        F.lit("in/"),
        F.get(codes, (k % n).cast("int")),
        F.get(joints, (c % 3).cast("int")),
        F.get(codes, (c % n).cast("int")),
        F.get(periods, (k % 8).cast("int")),
        F.get(tails, F.when(k % 4 == 0, 1).when(k % 5 == 0, 2).otherwise(0)),
    )
    return table(spark, sf, "orders").select("o_orderkey", name.alias("path"))


def names_query(spark: SparkSession, sf: str) -> DataFrame:
    base = naming.base_name("path")
    headers = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Gmt time"), F.lit("Open"))).otherwise(
        F.array(F.lit("Date"), F.lit("Close"))
    )
    return names(spark, sf).select(
        "o_orderkey",
        naming.instrument_from_name(base).alias("instrument"),
        naming.timeframe_from_name(base).alias("timeframe"),
        naming.provider(base, headers).alias("provider"),
        naming.safe_file_name("path").alias("stored_name"),
        naming.instrument_spelling(F.concat(F.lit("eur/"), F.substring(base, 1, 3))).alias("spelled"),
    )


_LIST = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"
_OK = "[" + ", ".join(f"'{c}'" for c in naming.CODES) + "]"
NAMES_ORACLE = rf"""WITH p AS (SELECT o_orderkey AS k, {_LIST}[1 + o_orderkey % {len(_CODES)}] AS a, ['', '_', '-'][1 + o_custkey % 3] AS j,
  {_LIST}[1 + o_custkey % {len(_CODES)}] AS b, ['1','5','15','60','240','1440','7',''][1 + o_orderkey % 8] AS m,
  ['.csv', '_Candlestick_1_M_BID.csv', ' export (2).txt'][1 + CASE WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END] AS t FROM orders),
n AS (SELECT *, a || j || b || m || t AS name, list_contains({_OK}, a) AND list_contains({_OK}, b) AS known FROM p)
SELECT k AS o_orderkey, CASE WHEN known AND a <> b THEN a || '_' || b END AS instrument,
  CASE WHEN known AND t = '.csv' THEN CASE m WHEN '1' THEN '1min' WHEN '5' THEN '5min' WHEN '15' THEN '15min' WHEN '60' THEN '1h' WHEN '240' THEN '4h' WHEN '1440' THEN '1d' END END AS timeframe,
  CASE WHEN t = '.csv' AND m <> '' THEN 'FOREX_SOFTWARE' WHEN contains(t, 'Candlestick') OR k % 3 = 0 THEN 'DUKASCOPY' ELSE 'UNKNOWN' END AS provider,
  regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g') AS stored_name, 'EUR_' || substr(name, 1, 3) AS spelled FROM n"""

# --- ranges --------------------------------------------------------------------

START, END = "2024-01-05T06:00:00", "2024-02-10T00:00:00+02:00"


def range_query(spark: SparkSession, sf: str) -> DataFrame:
    """Hours 5 January to 10 February of 15-minute bars, made hourly."""
    bars = load_bars(event_bars(spark, sf, "15min"), "15min", "1h", START, END)
    return rounded(bars.select("instrument", "ts", "close", "pos", "n_bars"))


RANGE_ORACLE = f"""WITH {TICKS}, {bars_sql("1h")},
b AS (SELECT * FROM bars WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-02-09 22:00:00')
SELECT instrument, ts, {r("close")}, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS pos,
  count(*) OVER (PARTITION BY instrument) AS n_bars FROM b"""


def coverage_query(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.coverage(event_bars(spark, sf, "1h"), START, END)


COVERAGE_ORACLE = f"""WITH {TICKS}, {bars_sql("1h")},
b AS (SELECT *, ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-02-09 22:00:00' AS inside FROM bars)
SELECT instrument, min(ts) AS available_start, max(ts) AS available_end, min(ts) FILTER (WHERE inside) AS selected_start,
  max(ts) FILTER (WHERE inside) AS selected_end, count(*) FILTER (WHERE inside) AS bars_selected, count(*) AS bars_available,
  TIMESTAMP '2024-01-05 06:00:00' < min(ts) OR TIMESTAMP '2024-02-09 22:00:00' > max(ts) AS requested_out_of_range,
  count(*) FILTER (WHERE inside) >= 151 AS sufficient_for_research FROM b GROUP BY 1"""


def preset_query(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each priority's last half year."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("instrument"), F.col("o_orderdate").alias("ts"), "o_orderkey"
    )
    return ranges.preset_range(orders, "6m")


PRESET_ORACLE = """SELECT o_orderpriority AS instrument, o_orderdate AS ts, o_orderkey FROM orders
QUALIFY o_orderdate >= max(o_orderdate) OVER (PARTITION BY o_orderpriority) - INTERVAL 182 DAYS"""


def tail_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranges.tail(event_bars(spark, sf, "1h"), 100))


TAIL_ORACLE = f"""WITH {TICKS}, {bars_sql("1h")}
SELECT instrument, ts, {", ".join(r(c) for c in ("open", "high", "low", "close", "volume"))} FROM bars
QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) <= 100"""


def sanitize_query(spark: SparkSession, sf: str) -> DataFrame:
    """Unguarded ratios of every order line with what is not a number taken out."""
    x = F.col("l_discount")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.when(x == 0, F.lit(float("inf"))).when(x == 0.05, F.lit(float("nan"))).otherwise(1 / F.nullif(x, F.lit(0.0))).alias("x"),
    )
    return rounded(ranges.sanitized(ranges.with_provenance(lines, "PARQUET_LOCAL")))


SANITIZE_ORACLE = f"""SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_discount <> 0 AND l_discount <> 0.05 THEN round(1 / l_discount, 8) END AS x,
  'PARQUET_LOCAL' AS source, false AS is_synthetic FROM lineitem"""

# --- ingest --------------------------------------------------------------------


def _lines(bars: DataFrame, value) -> DataFrame:
    """Bars of all instruments as lines; a field names the instrument in no way."""
    return bars.select(F.lit(0).alias("block"), F.col("line"), value.alias("value"))


def one_series(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one hourly series."""
    everything = table(spark, sf, "events").select(
        F.lit("ALL").alias("instrument"), "ts", F.col("value").alias("price"), "event_id"
    )
    bars = tick_bars(everything.where("price > 0"), "1h", tie=["event_id"])
    return bars.withColumn("line", F.unix_seconds(F.col("ts").cast("timestamp")))


def continuous_series(spark: SparkSession, sf: str) -> DataFrame:
    """The same series with each bar opening at the close before, as in a market:
    which of the inner prices is the open shows in nothing else."""
    before = F.coalesce(F.lag("close").over(Window.partitionBy("instrument").orderBy("ts")), F.col("open"))
    opened = one_series(spark, sf).withColumn("open", before)
    return opened.withColumns({"high": F.greatest("high", "open"), "low": F.least("low", "open")})


def headerless_query(spark: SparkSession, sf: str) -> DataFrame:
    """Unnamed columns, date and time apart, comma decimals: read back as bars."""
    def number(c: str):
        return F.replace(F.format_string("%.4f", c), F.lit("."), F.lit(","))

    value = F.concat_ws(
        ";",
        F.date_format("ts", "yyyy.MM.dd"),
        F.date_format("ts", "HH:mm"),
        *[number(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").cast("string"),
    )
    found = ingest(materialized(_lines(continuous_series(spark, sf), value)), "ALL")
    return rounded(found.bars, 4)


ONE_SERIES = """ticks AS (SELECT 'ALL' AS instrument, ts, value AS price FROM events WHERE value > 0)"""
INGEST_ORACLE = f"""WITH {ONE_SERIES}, {bars_sql("1h")}
SELECT instrument, ts, {", ".join(r(c, digits=4) for c in ("open", "high", "low", "close", "volume"))} FROM bars"""

HEADERLESS_ORACLE = f"""WITH {ONE_SERIES}, {bars_sql("1h")},
c AS (SELECT instrument, ts, coalesce(lag(close) OVER (ORDER BY ts), open) AS open, high, low, close, volume FROM bars)
SELECT instrument, ts, {r("open", digits=4)}, {r("greatest(high, open)", "high", 4)}, {r("least(low, open)", "low", 4)},
  {r("close", digits=4)}, {r("volume", digits=4)} FROM c"""


def headered_query(spark: SparkSession, sf: str) -> DataFrame:
    """Named columns in day-first spelling, with defects; the row accounting."""
    k = F.hour("ts") + F.dayofmonth("ts")
    header = "Gmt time,Open,High,Low,Close,Volume"
    value = F.when(F.col("ts") == F.col("_first"), header).otherwise(
        F.concat_ws(
            ",",
            F.date_format("ts", "dd.MM.yyyy HH:mm:ss.SSS"),
            F.when(k % 17 == 0, "bad").otherwise(F.format_string("%.4f", "open")),
            F.format_string("%.4f", F.when(k % 13 == 0, F.col("low") / 2).otherwise(F.col("high"))),
            F.format_string("%.4f", "low"),
            F.format_string("%.4f", F.when(k % 19 == 0, -F.col("close")).otherwise(F.col("close"))),
            F.col("volume").cast("string"),
        )
    )
    bars = one_series(spark, sf)
    marked = bars.join(bars.groupBy("instrument").agg(F.min("ts").alias("_first")), "instrument")
    found = ingest(materialized(_lines(marked, value)), "ALL")
    return found.accounting


HEADERED_ORACLE = f"""WITH {ONE_SERIES}, {bars_sql("1h")},
k AS (SELECT *, hour(ts) + day(ts) AS k FROM bars QUALIFY ts > min(ts) OVER ()),
d AS (SELECT CASE WHEN k % 17 = 0 THEN 1 WHEN k % 19 = 0 THEN 2 WHEN k % 13 = 0 THEN 3 END AS defect FROM k)
SELECT 'ALL' AS instrument, count(*) AS uploaded_rows, count(*) FILTER (WHERE defect IS NULL) AS source_valid_rows,
  count(*) FILTER (WHERE defect IS NULL) AS usable_rows, count(*) FILTER (WHERE defect IS NOT NULL) AS removed_rows,
  0 AS invalid_timestamp, count(*) FILTER (WHERE defect = 1) AS non_numeric_price,
  count(*) FILTER (WHERE defect = 2) AS invalid_price, count(*) FILTER (WHERE defect = 3) AS invalid_ohlc,
  0 AS duplicate_timestamp FROM d"""


def tick_file_query(spark: SparkSession, sf: str) -> DataFrame:
    """A tick file with bid, ask and last: every event, to hourly bars."""
    e = table(spark, sf, "events").where(F.col("value") > 0)
    header = spark.range(1).select(
        F.lit(-1).alias("block"), F.lit(0).cast("bigint").alias("line"), F.lit("Timestamp,Bid,Ask,Last").alias("value")
    )
    rows = e.select(
        F.lit(0).alias("block"),
        F.col("event_id").alias("line"),
        F.concat_ws(
            ",",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            F.format_string("%.4f", F.col("value") - 1),
            F.format_string("%.4f", F.col("value") + 1),
            F.format_string("%.4f", "value"),
        ).alias("value"),
    )
    found = ingest(materialized(header.unionByName(rows)), "ALL", timeframe="1h")
    return rounded(found.bars, 4)


def cleaning_query(spark: SparkSession, sf: str) -> DataFrame:
    by_user = raw_rows(spark, sf).withColumn("instrument", F.concat_ws("-", "instrument", F.dayofmonth("ts").cast("string")))
    return cleaning_checks(row_accounting(by_user))


CLEANING_ORACLE = f"""WITH {DEFECTS},
g AS (SELECT concat_ws('-', instrument, CAST(day(ts) AS VARCHAR)) AS instrument, defect IS NULL AND nth = 1 AS kept FROM d),
c AS (SELECT instrument, count(*) FILTER (WHERE NOT kept) AS removed, count(*) FILTER (WHERE kept) AS usable FROM g GROUP BY 1)
SELECT instrument, 'rows_removed_accounting' AS code, 'warning' AS severity, removed AS n FROM c WHERE removed > 0
UNION ALL SELECT instrument, 'insufficient_rows_after_cleaning', 'error', usable FROM c WHERE usable < 200"""


def fingerprint_query(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of the bars and of the same bars shuffled: one value, one row."""
    bars = event_bars(spark, sf, "1h")
    shuffled = bars.repartition(5, "close").sortWithinPartitions("volume")
    both = fingerprint(bars).unionByName(fingerprint(shuffled))
    return both.groupBy("n_rows").agg(F.countDistinct("content_hash").alias("distinct_hashes"))


FINGERPRINT_ORACLE = f"""WITH {TICKS}, {bars_sql("1h")} SELECT count(*) AS n_rows, 1 AS distinct_hashes FROM bars"""

QUERIES = {
    "field_profile": (profile_query, PROFILE_ORACLE),
    "field_profile_whole": (profile_query, PROFILE_ORACLE),
    "separator_quality": (quality_query, QUALITY_ORACLE),
    "header_test": (header_query, HEADER_ORACLE),
    "parse_columns": (parse_query, PARSE_ORACLE),
    "join_date_time": (date_time_query, DATE_TIME_ORACLE),
    "file_names": (names_query, NAMES_ORACLE),
    "research_range": (range_query, RANGE_ORACLE),
    "dataset_coverage": (coverage_query, COVERAGE_ORACLE),
    "preset_range": (preset_query, PRESET_ORACLE),
    "bars_tail": (tail_query, TAIL_ORACLE),
    "sanitized_output": (sanitize_query, SANITIZE_ORACLE),
    "ingest_headerless": (headerless_query, HEADERLESS_ORACLE),
    "ingest_headered": (headered_query, HEADERED_ORACLE),
    "ingest_ticks": (tick_file_query, INGEST_ORACLE),
    "cleaning_checks": (cleaning_query, CLEANING_ORACLE),
    "fingerprint": (fingerprint_query, FINGERPRINT_ORACLE),
}
