"""Data quality: issues, removal reasons, normalization, audits.

Raw rows carry `instrument, block, line` and the parsed `ts, open..close, volume`.
(block, line) is the file position: `block` names a file split and orders splits,
`line` orders rows inside one. A split is bounded by the reader's split size, so
file-order checks run inside splits and compare neighbours' ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import all_of, any_of
from barloom.operators.bars import PRICES
from barloom.operators.positions import (
    CHUNK_ROWS,
    KEY,
    chunk_window,
    core_only,
    with_gap,
    with_halo,
    with_position,
)
from barloom.operators.ranks import exact_percentile

# Removal reasons in order of precedence.
REASONS = (
    "invalid_timestamp",
    "non_numeric_price",
    "invalid_price",
    "invalid_ohlc",
    "duplicate_timestamp",
)
MIN_ROWS = 200


def inconsistent() -> Column:
    high, low = F.col("high"), F.col("low")
    return any_of(
        [high < low, high < F.col("open"), high < F.col("close"), low > F.col("open"), low > F.col("close")]
    )


def defect() -> Column:
    """First defect of a row, NULL for a valid one; duplicates are judged per key."""
    prices = [F.col(c) for c in PRICES]
    return (
        F.when(F.col("ts").isNull(), REASONS[0])
        .when(any_of([p.isNull() for p in prices]), REASONS[1])
        .when(any_of([p <= 0 for p in prices]), REASONS[2])
        .when(inconsistent(), REASONS[3])
    )


def _file_order() -> Column:
    return F.struct("block", "line")


def row_accounting(raw: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows per removal reason. A duplicate is a valid row that is not the first of
    its timestamp, even where that first row is itself removed."""
    flagged = raw.withColumn("_defect", defect())
    valid = F.col("_defect").isNull()
    per_time = flagged.groupBy(*keys, "ts").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(valid).alias("_valid"),
        F.min_by(valid, _file_order()).alias("_first_valid"),
        *[F.count_if(F.col("_defect") == r).alias(f"_{r}") for r in REASONS[:4]],
    )
    kept = F.when(F.col("_first_valid"), 1).otherwise(0)
    return per_time.groupBy(*keys).agg(
        F.sum("_rows").alias("uploaded_rows"),
        F.sum("_valid").alias("source_valid_rows"),
        F.sum(kept).cast("bigint").alias("usable_rows"),
        (F.sum("_rows") - F.sum(kept)).alias("removed_rows"),
        *[F.sum(f"_{r}").alias(r) for r in REASONS[:4]],
        F.sum(F.col("_valid") - kept).alias(REASONS[4]),
    )


def reasons_map() -> Column:
    """Removal reasons with a count, as a map."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(r) for r in REASONS]), F.array(*[F.col(r) for r in REASONS])
    )
    return F.map_filter(pairs, lambda _, n: n > 0)


def first_per_time(raw: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Keep the first row of each timestamp in file order (reduced before the shuffle)."""
    w = Window.partitionBy(*keys, "ts").orderBy("block", "line")
    return raw.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def normalize(raw: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Bars from raw rows: first per timestamp, then only valid ones.

    The order matters: an invalid first row also removes its valid twin.
    """
    quotes = [c for c in ("bid", "ask") if c in raw.columns]
    volume = F.col("volume") if "volume" in raw.columns else F.lit(None).cast("double")
    return (
        first_per_time(raw.where(F.col("ts").isNotNull()), keys)
        .where(defect().isNull())
        .select(*keys, "ts", *PRICES, F.coalesce(volume, F.lit(0.0)).alias("volume"), *quotes)
    )


def clean(raw: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Looser batch cleaning: positive prices and high not below low."""
    good = all_of([F.col(c) > 0 for c in PRICES]) & (F.col("high") >= F.col("low"))
    return first_per_time(raw.where(F.col("ts").isNotNull()), keys).where(good)


def out_of_order(raw: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Whether timestamps ever step back in file order, per instrument."""
    inside = Window.partitionBy(*keys, "block").orderBy("line")
    per_block = (
        raw.where(F.col("ts").isNotNull())
        .withColumn("_back", F.col("ts") < F.lag("ts").over(inside))
        .groupBy(*keys, "block")
        .agg(F.max("_back").alias("_back"), F.min("ts").alias("_min"), F.max("ts").alias("_max"))
    )
    across = Window.partitionBy(*keys).orderBy("block")
    earlier_max = F.max("_max").over(across.rowsBetween(Window.unboundedPreceding, -1))
    return (
        per_block.withColumn("_cross", F.col("_min") < earlier_max)
        .groupBy(*keys)
        .agg(F.coalesce(F.max(F.col("_back") | F.coalesce("_cross", F.lit(False))), F.max("_cross"), F.lit(False)).alias("unordered"))
    )


def _issue(code: str, severity: str, n: Column, when: Column) -> Column:
    return F.when(
        when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.cast("bigint").alias("n"))
    )


def _listed(df: DataFrame, keys: Sequence[str], issues: list[Column]) -> DataFrame:
    return df.select(*keys, F.inline(F.filter(F.array(*issues), lambda i: i.isNotNull())))


def _counted(raw: DataFrame, keys: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """Rows, known times, repeated times and the checks, counted in one scan."""
    per_time = raw.groupBy(*keys, "ts").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(name) for name, c in checks.items()]
    )
    return per_time.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"),
        F.coalesce(F.sum(F.when(F.col("ts").isNotNull(), F.col("_n"))), F.lit(0)).alias("_times"),
        F.sum(F.col("_n") - 1).alias("_repeats"),
        *[F.sum(name).alias(name) for name in checks],
    )


def validate(raw: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Issues of mapped raw rows, one row `(code, severity, n)` each.

    Consistency checks across prices are made only if no price column is mostly
    non-numeric; a suspected high/low swap ends the checks.
    """
    complete = all_of([F.col(c).isNotNull() for c in PRICES])
    checks = {
        "_complete": complete,
        "_swapped": complete & (F.col("high") < F.col("low")),
        "_inconsistent": inconsistent(),
        **{f"_bad_{c}": F.col(c).isNull() for c in PRICES},
        **{f"_low_{c}": F.col(c) <= 0 for c in PRICES},
    }
    counts = _counted(raw, keys, checks)
    facts = counts.join(out_of_order(raw, keys), list(keys), "left")
    rows, parsed = F.col("_rows"), F.col("_times") > 0
    textual = [F.col(f"_bad_{c}") / rows > 0.5 for c in PRICES]
    numeric = parsed & ~any_of(textual)
    swapped = numeric & (F.col("_complete") > 0) & (F.col("_swapped") / F.col("_complete") > 0.9)
    issues = [
        _issue("bad_timestamp_format", "error", rows, ~parsed),
        _issue("duplicate_timestamps", "warning", F.col("_repeats"), parsed & (F.col("_repeats") > 0)),
        _issue("unordered_timestamps", "warning", F.lit(1), parsed & F.coalesce("unordered", F.lit(False))),
    ]
    for c, text in zip(PRICES, textual):
        issues.append(_issue(f"non_numeric_prices:{c}", "error", F.col(f"_bad_{c}"), parsed & text))
        low = F.col(f"_low_{c}")
        issues.append(_issue(f"invalid_prices:{c}", "warning", low, parsed & ~text & (low > 0)))
    issues += [
        _issue("systematic_high_low_swap_suspected", "error", F.col("_swapped"), swapped),
        _issue(
            "ohlc_inconsistency",
            "warning",
            F.col("_inconsistent"),
            numeric & ~swapped & (F.col("_inconsistent") > 0),
        ),
        _issue("insufficient_rows", "error", rows, parsed & ~swapped & (rows < MIN_ROWS)),
    ]
    return _listed(facts, keys, issues)


def tick_accounting(ticks: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Tick defects (not exclusive) and valid rows. `volume_text` is the unparsed
    volume where the source has one: negative or garbled volumes are invalid."""
    checks = {
        "invalid_timestamp": F.col("ts").isNull(),
        "non_numeric_price": F.col("price").isNull(),
        "invalid_price": F.coalesce(F.col("price") <= 0, F.lit(False)),
    }
    if "volume_text" in ticks.columns:
        garbled = F.col("volume").isNull() & (F.trim("volume_text") != "")
        checks["invalid_volume"] = F.coalesce((F.col("volume") < 0) | garbled, F.lit(False))
    bad = any_of(list(checks.values()))
    return ticks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("uploaded_rows"),
        F.count_if(~bad).alias("source_valid_rows"),
        F.count_if(bad).alias("removed_rows"),
        *[F.count_if(c).alias(name) for name, c in checks.items()],
    )


def valid_ticks(ticks: DataFrame) -> DataFrame:
    kept = ticks.where(F.col("ts").isNotNull() & (F.col("price") > 0))
    if "volume_text" in ticks.columns:
        garbled = F.col("volume").isNull() & (F.trim("volume_text") != "")
        kept = kept.where(~F.coalesce((F.col("volume") < 0) | garbled, F.lit(False)))
    return kept


def bar_checks(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Issues of bars made from ticks: too few, or failing the price relations."""
    bad = F.coalesce(inconsistent() | any_of([F.col(c) <= 0 for c in PRICES]), F.lit(True))
    facts = bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(bad).alias("_bad")
    )
    return _listed(
        facts,
        keys,
        [
            _issue("insufficient_rows_after_aggregation", "error", F.col("_rows"), F.col("_rows") < MIN_ROWS),
            _issue("aggregated_ohlc_invalid", "error", F.col("_bad"), F.col("_bad") > 0),
        ],
    )


def cleaning_checks(accounting: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Issues after normalization: removed rows, and too few left."""
    return _listed(
        accounting,
        keys,
        [
            _issue("rows_removed_accounting", "warning", F.col("removed_rows"), F.col("removed_rows") > 0),
            _issue(
                "insufficient_rows_after_cleaning",
                "error",
                F.col("usable_rows"),
                F.col("usable_rows") < MIN_ROWS,
            ),
        ],
    )


def irregular_spacing(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Gaps above 100 times the median positive gap, per instrument."""
    gaps = with_gap(with_position(bars, keys), keys).where(F.col("gap_us") > 0)
    median = exact_percentile(gaps, keys, "gap_us", [0.5], ["median_gap_us"])
    return (
        gaps.join(median, list(keys))
        .groupBy(*keys)
        .agg(
            F.first("median_gap_us").alias("median_gap_us"),
            F.count_if(F.col("gap_us") > F.col("median_gap_us") * 100).alias("extreme_gaps"),
        )
    )


def range_anomalies(
    bars: DataFrame, keys: Sequence[str] = KEY, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Bars whose range exceeds 20 times the median of the last 50 (10 at least);
    series of 50 bars or fewer are not judged. Needs `pos, n_bars`."""
    spread = with_halo(bars, back=49, chunk_rows=chunk_rows).withColumn(
        "_range", F.col("high") - F.col("low")
    )
    frame = chunk_window(keys).rowsBetween(-49, 0)
    median = F.percentile("_range", 0.5).over(frame)
    seen = F.count("_range").over(frame)
    odd = (seen >= 10) & (F.col("_range") > median * 20) & (F.col("n_bars") > 50)
    return core_only(spread.withColumn("range_anomaly", F.coalesce(odd, F.lit(False)))).drop("_range")


def audit(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Counts of a stored bar table's defects (`block, line` give its order)."""
    checks = {
        **{f"nonpositive_{c}": F.col(c) <= 0 for c in PRICES},
        **{f"missing_{c}": F.col(c).isNull() for c in PRICES},
        "high_below_low": F.col("high") < F.col("low"),
        "negative_volume": F.col("volume") < 0,
    }
    counts = _counted(bars, keys, checks).withColumnRenamed("_repeats", "duplicate_timestamps")
    return counts.drop("_rows", "_times").join(out_of_order(bars, keys), list(keys), "left")


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in PRICES if c not in df.columns]


def confidence(uploaded: Column, usable: Column, errors: Column, warnings: Column) -> Column:
    """Overall status of an upload from its row counts and issue counts."""
    lost = uploaded - usable
    return (
        F.when(errors > 0, "DATA_REJECTED")
        .when((usable < uploaded * 0.95) & (lost > 100), "DATA_NEEDS_REVIEW")
        .when((warnings > 0) | (lost > 0), "DATA_READY_WITH_CLEANING")
        .otherwise("DATA_READY")
    )
