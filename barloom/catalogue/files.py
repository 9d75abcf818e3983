"""Registered queries over directories of files, written from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalogue.common import TICKS, bars_sql, event_bars, r, rounded, table
from barloom.plans.ingest import ingest_directory
from barloom.session import new_path
from barloom.sources.parsing import choose_readings
from barloom.sources.tables import differing_parts, fingerprint, part_fingerprints, united, whole_fingerprint
from barloom.sources.timestamps import recognized

# --- timestamps ------------------------------------------------------------------

#: Spark and DuckDB spellings of an instant, and what is left of it.
SPELLINGS = (
    ("d MMM yyyy HH:mm", "%-d %b %Y %H:%M", "minute"),
    ("dd.MM.yy", "%d.%m.%y", "day"),
    ("MMMM d, yyyy h:mm a", "%B %-d, %Y %-I:%M %p", "minute"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "%Y-%m-%dT%H:%M:%S.%gZ", "millisecond"),
    ("M/d/yyyy hh:mm:ss a", "%-m/%-d/%Y %I:%M:%S %p", "second"),
    ("yyyyMMdd HHmm", "%Y%m%d %H%M", "minute"),
    ("EEE dd-MMM-yy h a", "%a %d-%b-%y %-I %p", "hour"),
)


def mixed_times(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's time in one of seven spellings, by its id, in one column; some unreadable."""
    kind = F.col("event_id") % (len(SPELLINGS) + 1)
    text = F.lit("yesterday")
    for i, (spelling, _, _) in enumerate(SPELLINGS):
        text = F.when(kind == i, F.date_format("ts", spelling)).otherwise(text)
    # Month before day is only told apart after the twelfth.
    text = F.when((kind == 4) & (F.dayofmonth("ts") <= 12), F.date_format("ts", "d/M/yyyy hh:mm:ss a")).otherwise(text)
    return table(spark, sf, "events").select("event_id", text.alias("text"))


def times_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixed_times(spark, sf)
    chosen, _ = choose_readings(rows, ["text"], [])
    return rows.select("event_id", chosen["text"].alias("ts"), recognized("text").isNotNull().alias("known"))


TIMES_ORACLE = f"""SELECT event_id, CASE event_id % {len(SPELLINGS) + 1}
  {" ".join(f"WHEN {i} THEN CAST(date_trunc('{unit}', ts) AS TIMESTAMP)" for i, (_, _, unit) in enumerate(SPELLINGS))} END AS ts,
  event_id % {len(SPELLINGS) + 1} < {len(SPELLINGS)} AS known FROM events"""

# --- a directory of bars ------------------------------------------------------------

PAIRS = {"click": "EURUSD", "error": "GBPUSD", "purchase": "USDJPY", "signup": "AUDCAD", "view": "XAUUSD"}
BY_COMMA = "Date,Open,High,Low,Close,Volume"
REVERSED = "Close,Low,High,Open,Volume,Timestamp"
BY_SEMICOLON = "Gmt time;Open;Low;High;Close;Volume"


def _number(c: str) -> Column:
    return F.format_string("%.4f", c)


def _with_comma(c: str) -> Column:
    return F.replace(_number(c), F.lit("."), F.lit(","))


def write_files(lines: DataFrame) -> str:
    """Text files of (name, part, at, value), one for each name and part, in the order of `at`."""
    path = new_path(lines.sparkSession)
    ordered = lines.repartition("name", "part").sortWithinPartitions("name", "part", "at")
    ordered.select("name", "part", "value").write.partitionBy("name", "part").text(path)
    return path


def folder_name(file: Column) -> Column:
    return F.regexp_extract(file, "name=([^/]+)/", 1)


def bar_files(spark: SparkSession, sf: str) -> DataFrame:
    """15-minute bars of five instruments by week, in three layouts and spellings of the time."""
    bars = event_bars(spark, sf, "15min")
    names = F.create_map(*[F.lit(x) for k, v in PAIRS.items() for x in (k, v + "15")])
    bars = bars.withColumns({"name": names[F.col("instrument")], "part": F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd")})
    volume = F.col("volume").cast("long").cast("string")
    comma = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm"), *map(_number, ("open", "high", "low", "close")), volume)
    clock = F.concat(F.lit('"'), F.date_format("ts", "MMM d, yyyy h:mm a"), F.lit('"'))
    back = F.concat_ws(",", *map(_number, ("close", "low", "high", "open")), volume, clock)
    semicolon = F.concat_ws(";", F.date_format("ts", "dd.MM.yy HH:mm"), *map(_with_comma, ("open", "low", "high", "close")), volume)

    def pick(a, b, c) -> Column:
        first, second = F.col("instrument").isin("click", "view"), F.col("instrument").isin("error", "purchase")
        return F.when(first, a).when(second, b).otherwise(c)

    lines = bars.select("name", "part", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), pick(comma, back, semicolon).alias("value"))
    heads = bars.select("name", "part", F.lit(-1).cast("long").alias("at"), pick(F.lit(BY_COMMA), F.lit(REVERSED), F.lit(BY_SEMICOLON)).alias("value"))
    return lines.unionByName(heads.distinct())


def directory_query(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of all instruments, read back from their files."""
    found = ingest_directory(spark, write_files(bar_files(spark, sf)), name_of=folder_name)
    return rounded(found.bars, 4)


_NAMED = "CASE instrument " + " ".join(f"WHEN '{k}' THEN '{v[:3]}_{v[3:]}'" for k, v in PAIRS.items()) + " END AS instrument"
DIRECTORY_ORACLE = f"""WITH {TICKS}, {bars_sql("15min")}
SELECT {_NAMED}, ts, {", ".join(r(c, digits=4) for c in ("open", "high", "low", "close", "volume"))} FROM bars"""


def refused_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same bars with a defect in each instrument's files, by instrument."""
    lines = bar_files(spark, sf)
    head, at = F.col("at") < 0, F.col("at")
    short = F.col("name") == "EURUSD15"
    value = (
        F.when(short & (at % 7200 == 0), F.concat("value", F.lit(",x")))  # a field too many
        .when(F.col("name") == "GBPUSD15", F.regexp_replace("value", "Low", "Lowest"))  # no low
        .when((F.col("name") == "USDJPY15") & ~head, F.regexp_replace("value", '"[^"]*"', "some day"))  # no time
        .when((F.col("name") == "AUDCAD15") & ~head & (at % 3600 == 0), F.regexp_replace("value", r";[^;]*$", ";"))  # no volume
        .when((F.col("name") == "XAUUSD15") & ~head & (at % 5400 == 0), F.regexp_replace("value", r"^[^,]*,", ","))  # no date
        .otherwise(F.col("value"))
    )
    return lines.withColumn("value", value)


def refused_query(spark: SparkSession, sf: str) -> DataFrame:
    """Row accounting and issues of files with defects, in one long table."""
    found = ingest_directory(spark, write_files(refused_files(spark, sf)), name_of=folder_name)
    counts = ["uploaded_rows", "parsed_rows", "usable_rows", "removed_rows", "invalid_timestamp"]
    pairs = F.array(*[F.struct(F.lit(c).alias("code"), F.lit("count").alias("severity"), F.col(c).alias("n")) for c in counts])
    return found.issues.unionByName(found.accounting.select("instrument", F.inline(pairs)))


REFUSED_ORACLE = f"""WITH {TICKS}, {bars_sql("15min")},
b AS (SELECT {_NAMED}, ts, CAST(epoch(ts) AS BIGINT) AS sec, date_trunc('week', ts) AS part FROM bars),
w AS (SELECT *, bool_or(sec % 7200 = 0) OVER (PARTITION BY instrument, part) AS bad FROM b),
d AS (SELECT *, CASE WHEN instrument = 'EUR_USD' THEN NOT bad WHEN instrument = 'GBP_USD' THEN false ELSE true END AS parsed,
  CASE WHEN instrument = 'USD_JPY' THEN true WHEN instrument = 'XAU_USD' THEN sec % 5400 = 0 ELSE false END AS timeless FROM w),
c AS (SELECT instrument, count(*) AS uploaded_rows, count(*) FILTER (WHERE parsed) AS parsed_rows,
  count(*) FILTER (WHERE parsed AND NOT timeless) AS usable_rows, count(*) FILTER (WHERE parsed AND timeless) AS removed_rows,
  count(*) FILTER (WHERE parsed AND timeless) AS invalid_timestamp,
  count(*) FILTER (WHERE instrument = 'EUR_USD' AND sec % 7200 = 0) AS malformed, count(DISTINCT part) AS files FROM d GROUP BY 1)
SELECT instrument, code, 'count' AS severity, n FROM (
  UNPIVOT (SELECT instrument, uploaded_rows, parsed_rows, usable_rows, removed_rows, invalid_timestamp FROM c)
  ON uploaded_rows, parsed_rows, usable_rows, removed_rows, invalid_timestamp INTO NAME code VALUE n)
UNION ALL SELECT instrument, 'malformed_rows', 'error', malformed FROM c WHERE malformed > 0
UNION ALL SELECT instrument, 'missing_columns', 'error', files FROM c WHERE instrument = 'GBP_USD'
UNION ALL SELECT instrument, 'bad_timestamp_format', 'error', parsed_rows FROM c WHERE instrument = 'USD_JPY'
UNION ALL SELECT instrument, 'duplicate_timestamps', 'warning', invalid_timestamp - 1 FROM c WHERE instrument = 'XAU_USD' AND invalid_timestamp > 1
UNION ALL SELECT instrument, 'rows_removed_accounting', 'warning', removed_rows FROM c WHERE removed_rows > 0
UNION ALL SELECT instrument, 'insufficient_rows_after_cleaning', 'error', usable_rows FROM c WHERE parsed_rows > 0 AND usable_rows < 200
UNION ALL SELECT instrument, 'insufficient_rows', 'error', parsed_rows FROM c WHERE parsed_rows > 0 AND usable_rows > 0 AND parsed_rows < 200"""

# --- fingerprints of parts ------------------------------------------------------------


def parts_query(spark: SparkSession, sf: str) -> DataFrame:
    """Days whose bars changed: one price of the first hour, and the last hour lost.

    `same` are the days that differ after a shuffle, after reading in two portions, and whether
    the parts make up the fingerprint of the whole: none.
    """
    bars = event_bars(spark, sf, "1h")
    ends = bars.groupBy("instrument").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    changed = bars.join(ends, "instrument").where("ts < last")
    changed = changed.withColumn("close", F.when(F.col("ts") == F.col("first"), F.col("close") + 0.01).otherwise(F.col("close")))
    known = part_fingerprints(bars, part="yyyy-MM-dd")
    early = F.dayofmonth("ts") < 15
    portions = united(*[part_fingerprints(bars.where(c), part="yyyy-MM-dd") for c in (early, ~early)])
    shuffled = part_fingerprints(bars.repartition(7, "close"), part="yyyy-MM-dd")
    whole = whole_fingerprint(known).exceptAll(fingerprint(bars))
    found = differing_parts(known, part_fingerprints(changed.select(bars.columns), part="yyyy-MM-dd")).select(F.lit("changed").alias("kind"), "*")
    for frame in (differing_parts(known, shuffled), differing_parts(known, portions)):
        found = found.unionByName(frame.select(F.lit("same").alias("kind"), "*"))
    return found.unionByName(whole.select(F.lit("same").alias("kind"), F.col("n_rows").alias("found_rows")), allowMissingColumns=True)


PARTS_ORACLE = f"""WITH {TICKS}, {bars_sql("1h")},
d AS (SELECT instrument, strftime(ts, '%Y-%m-%d') AS part, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY ALL),
e AS (SELECT *, lo = min(lo) OVER (PARTITION BY instrument) AS f, hi = max(hi) OVER (PARTITION BY instrument) AS l FROM d)
SELECT 'changed' AS kind, instrument, part, n AS recorded_rows, CASE WHEN l THEN nullif(n - 1, 0) ELSE n END AS found_rows
FROM e WHERE f OR l"""

QUERIES = {
    "fingerprint_parts": (parts_query, PARTS_ORACLE),
    "mixed_timestamps": (times_query, TIMES_ORACLE),
    "ingest_directory": (directory_query, DIRECTORY_ORACLE),
    "ingest_refused_files": (refused_query, REFUSED_ORACLE),
}
