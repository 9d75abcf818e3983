"""Date ranges, coverage summaries, previews and provenance of bar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import finite
from barloom.operators.positions import KEY

# Calendar days of each preset.
PRESET_DAYS = {"30d": 30, "3m": 90, "6m": 182, "1y": 365, "3y": 1095}
# Warm-up and tail 80, smallest train 30, embargo 1, smallest test 40.
MIN_RESEARCH_BARS = 151
MAX_PREVIEW = 5000


def utc(text: str) -> Column:
    """UTC wall clock of an ISO text; offsets are applied, zone-less text is UTC."""
    return F.lit(text).cast("timestamp").cast("timestamp_ntz")


def between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Inclusive time bounds; they reach the file scan as pushed filters."""
    if start:
        df = df.where(F.col("ts") >= utc(start))
    if end:
        df = df.where(F.col("ts") <= utc(end))
    return df


def research_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the range; bounds outside the data clamp, an empty range is an error."""
    if not start and not end:
        return bars
    chosen = between(bars, start, end)
    spark = bars.sparkSession
    if start and end:
        if spark.range(1).select((utc(start) > utc(end)).alias("x")).first()["x"]:
            raise ValueError("the range starts after its end")
    if chosen.isEmpty():
        raise ValueError(f"no bars between {start} and {end}")
    return chosen


def preset_range(bars: DataFrame, preset: str, keys: Sequence[str] = KEY) -> DataFrame:
    """The last days before each instrument's own latest bar."""
    last = bars.groupBy(*keys).agg(F.max("ts").alias("_last"))
    span = F.expr(f"INTERVAL {PRESET_DAYS[preset]} DAYS")
    return bars.join(last, list(keys)).where(F.col("ts") >= F.col("_last") - span).drop("_last")


def coverage(
    bars: DataFrame, start: str | None = None, end: str | None = None, keys: Sequence[str] = KEY
) -> DataFrame:
    """Available and selected extent of a window, in one aggregate."""
    inside = F.lit(True)
    early = late = F.lit(False)
    if start:
        inside &= F.col("ts") >= utc(start)
        early = utc(start) < F.min("ts")
    if end:
        inside &= F.col("ts") <= utc(end)
        late = utc(end) > F.max("ts")
    picked = F.when(inside, F.col("ts"))
    return bars.groupBy(*keys).agg(
        F.min("ts").alias("available_start"),
        F.max("ts").alias("available_end"),
        F.min(picked).alias("selected_start"),
        F.max(picked).alias("selected_end"),
        F.count_if(inside).alias("bars_selected"),
        F.count(F.lit(1)).alias("bars_available"),
        (early | late).alias("requested_out_of_range"),
        (F.count_if(inside) >= MIN_RESEARCH_BARS).alias("sufficient_for_research"),
    )


def tail(bars: DataFrame, n: int, keys: Sequence[str] = KEY) -> DataFrame:
    """The last `n` bars of each instrument (the rank limit applies before the shuffle)."""
    if not 1 <= n <= MAX_PREVIEW:
        raise ValueError(f"n must be between 1 and {MAX_PREVIEW}")
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    return bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def with_provenance(
    df: DataFrame, source: str, synthetic: bool = False, instrument: str | None = None
) -> DataFrame:
    tags = {"source": F.lit(source), "is_synthetic": F.lit(synthetic)}
    if instrument is not None:
        tags["instrument"] = F.lit(instrument)
    return df.withColumns(tags)


def sanitized(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating column."""
    return df.select(*[finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
