"""Delimited text to quality-checked bars."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import PRICES, source_timeframe, tick_bars
from barloom.operators.quality import (
    bar_checks,
    cleaning_checks,
    irregular_spacing,
    normalize,
    row_accounting,
    tick_accounting,
    valid_ticks,
    validate,
)
from barloom.session import materialized
from barloom.sources.delimited import (
    CORRUPT,
    MIN_FIELDS,
    Layout,
    by_layout,
    choose_layout,
    layouts,
    read_files,
    read_lines,
    to_table,
)
from barloom.sources.naming import base_name, instrument_from_name, timeframe_from_name
from barloom.sources.parsing import choose_readings, joined_date_time, measure, measure_all, named, number_reading
from barloom.sources.schema import (
    JOINED,
    Mapping,
    SchemaError,
    map_headerless,
    map_headers,
    split_date_time,
    tick_layout,
)
from barloom.sources.timestamps import recognized

ISSUE_SCHEMA = "instrument string, code string, severity string, n bigint"
BAR_SCHEMA = (
    "instrument string, ts timestamp_ntz, open double, high double, low double, close double,"
    " volume double"
)


@dataclass
class Ingested:
    """Bars with their row accounting and issues; `accounting` is None where the
    columns could not be mapped, and the bars are then empty."""

    kind: str
    bars: DataFrame
    accounting: DataFrame | None
    issues: DataFrame
    mapping: Mapping

    def timeframes(self) -> DataFrame:
        """Spacing of the bars per instrument, from their median gap."""
        return source_timeframe(self.bars)

    def spacing_issues(self) -> DataFrame:
        """Gaps above 100 times the median, as warnings."""
        odd = irregular_spacing(self.bars).where(F.col("extreme_gaps") > 0)
        return odd.select(
            "instrument",
            F.lit("irregular_bar_spacing").alias("code"),
            F.lit("warning").alias("severity"),
            F.col("extreme_gaps").alias("n"),
        )


def _numbers(mapping: Mapping) -> dict[str, str]:
    """The columns of a mapping that hold numbers."""
    return {k: v for k, v in mapping.columns.items() if k in {*PRICES, "volume", "bid", "ask"}}


def mapped_rows(
    table: DataFrame, mapping: Mapping, instrument: str | Column, measured: dict[str, float] | None = None
) -> DataFrame:
    """Typed raw rows of a mapped all-string table; `measured` tells how numbers are spelled."""
    key = F.lit(instrument) if isinstance(instrument, str) else instrument
    names, time = _numbers(mapping), mapping.columns["timestamp"]
    chosen = mapping.readings
    if not chosen:
        measured = measured or measure(table, [], sorted(set(names.values())))
        chosen = {c: number_reading(measured, c)[0] for c in names.values()}
        chosen[time] = recognized(named(time))
    return table.select(
        key.alias("instrument"),
        "block",
        "line",
        chosen[time].cast("timestamp_ntz").alias("ts"),
        *[chosen[source].alias(name) for name, source in names.items()],
    )


def ingest(
    lines: DataFrame,
    instrument: str | Column,
    timeframe: str | None = None,
    pair_period_name: bool = False,
) -> Ingested:
    """Bars, row accounting and issues of lines that share one layout.

    `timeframe` is what the file names say; tick files cannot do without it.
    """
    layout = choose_layout(lines)
    table, mapping, ticks = mapped(to_table(lines, layout), layout, pair_period_name)
    if ticks is not None:
        if timeframe is None:
            raise SchemaError("tick files need a target timeframe")
        return _ticks(table, ticks, mapping, instrument, timeframe)
    if problem(mapping):
        return _unmapped(table, mapping)
    return _bars(table, mapping, instrument)


def mapped(
    table: DataFrame, layout: Layout, pair_period_name: bool = False
) -> tuple[DataFrame, Mapping, dict[str, str] | None]:
    """The table with a date and a time joined, what its columns are, and a tick file's columns."""
    if layout.header is None:
        mapping = map_headerless(table, pair_period_name)
        second = mapping.columns.pop("timestamp_secondary", None)
        if second is not None:
            table = joined_date_time(table, mapping.columns["timestamp"], second, JOINED)
            mapping.columns["timestamp"] = JOINED
        return table, mapping, None
    table, joined = split_date_time(table)
    named = [c for c in table.columns if c not in ("block", "line")]
    mapping = map_headers(named, table)
    if joined is not None:
        mapping.columns["timestamp"] = joined
        mapping.unmapped = [c for c in mapping.unmapped if c != joined]
    return table, mapping, tick_layout(named)


def problem(mapping: Mapping) -> tuple[str, int] | None:
    """The issue of a table whose columns don't make bars."""
    if mapping.missing:
        return "missing_columns", len(mapping.missing)
    return None if "timestamp" in mapping.columns else ("missing_timestamp", 1)


def _unmapped(table: DataFrame, mapping: Mapping) -> Ingested:
    """No bars, and an issue saying which kind of column was not found."""
    spark = table.sparkSession
    issues = spark.createDataFrame([(None, problem(mapping)[0], "error", problem(mapping)[1])], ISSUE_SCHEMA)
    return Ingested("OHLCV", spark.createDataFrame([], BAR_SCHEMA), None, issues, mapping)


def _bars(table: DataFrame, mapping: Mapping, instrument: str | Column) -> Ingested:
    raw = mapped_rows(table, mapping, instrument)
    accounting = row_accounting(raw)
    issues = validate(raw).unionByName(cleaning_checks(accounting))
    return Ingested("OHLCV", normalize(raw), accounting, issues, mapping)


def _ticks(
    table: DataFrame, layout: dict[str, str], mapping: Mapping, instrument: str | Column, timeframe: str
) -> Ingested:
    ticks = _tick_rows(table, layout, instrument)
    bars = tick_bars(valid_ticks(ticks), timeframe, tie=["block", "line"])
    return Ingested("TICK_AGGREGATED", bars, tick_accounting(ticks), bar_checks(bars), mapping)


def _tick_rows(table: DataFrame, layout: dict[str, str], instrument: str | Column) -> DataFrame:
    key = F.lit(instrument) if isinstance(instrument, str) else instrument
    numbers = sorted({layout["price"], layout.get("volume", layout["price"])})
    chosen, _ = choose_readings(table, [layout["timestamp"]], numbers)
    extra = []
    if "volume" in layout:
        extra = [chosen[layout["volume"]].alias("volume"), named(layout["volume"]).alias("volume_text")]
    return table.select(
        key.alias("instrument"),
        "block",
        "line",
        chosen[layout["timestamp"]].alias("ts"),
        chosen[layout["price"]].alias("price"),
        *extra,
    )


@dataclass
class IngestedFiles(Ingested):
    """Bars of a directory. `files` has one row per file with what was found of it, and in `code`
    why it was left out, if it was; `mappings` has what the columns of each layout are."""

    files: DataFrame
    mappings: list[tuple[Layout, Mapping]]


def ingest_directory(
    spark: SparkSession, path: str, instrument: str | None = None, name_of: Callable[[Column], Column] = base_name
) -> IngestedFiles:
    """All files under `path`; names give the instruments and the spacing.

    Every file has a layout of its own. Files of the same separator and header are read and
    mapped together, so columns in another order never mix. A file that can't be read is an
    issue of its instrument and gives no bars: `not_delimited`, `too_few_columns`,
    `malformed_rows` (lines, or quoted records, of another number of fields),
    `missing_columns`, `missing_timestamp`, `ambiguous_columns`, `missing_timeframe` (ticks).
    `instrument` stands in where a name tells none; `name_of` gets the name from a path. The text
    is scanned for the layouts, for the spelling of numbers, and for the typed rows, which are
    written once.
    """
    name = name_of(F.col("file"))
    key = F.coalesce(instrument_from_name(name), F.lit(instrument))
    lines = read_lines(spark, path).withColumn("file", F.col("block.file"))
    refused = (
        F.when(F.col("fields").isNull(), "not_delimited")
        .when(F.col("fields") < MIN_FIELDS, "too_few_columns")
        .when((F.col("deviating_lines") > 0) & ~F.col("open"), "malformed_rows")
    )
    files = materialized(
        layouts(lines, ["file"]).select(
            "*", key.alias("instrument"), timeframe_from_name(name).alias("timeframe"), refused.alias("code")
        )
    )
    listed = files.select("file", "open", "separator", "fields", "headed", "first", "timeframe", "code", "instrument").collect()
    if any(f["instrument"] is None for f in listed):
        raise SchemaError("some file names tell no instrument and none was given")
    of_row = F.coalesce(instrument_from_name(name_of(F.col("block.file"))), F.lit(instrument))
    bars, ticks, left_out, mappings = [], [], [], []
    for layout, found in by_layout([f for f in listed if f["code"] is None]):
        paths = [f["file"] for f in found]
        several = any(f["open"] for f in found)
        table = read_files(spark, paths, layout, several)
        if several:
            # Lines don't tell the records of quoted line breaks; the reader does.
            bad = table.where(F.col(CORRUPT).isNotNull()).groupBy(F.col("block.file").alias("file"))
            bad = {r["file"]: r["n"] for r in bad.agg(F.count("*").alias("n")).collect()}  # at most one per file
            left_out += [(f, "malformed_rows", n) for f, n in bad.items()]
            found = [f for f in found if f["file"] not in bad]
            paths = [f["file"] for f in found]
            if not paths:
                continue
            table = read_files(spark, paths, layout, several)
        try:
            table, mapping, tick = mapped(table.drop(CORRUPT), layout, all(f["timeframe"] for f in found))
        except SchemaError:
            left_out += [(f, "ambiguous_columns", None) for f in paths]
            continue
        mappings.append((layout, mapping))
        if tick is None and problem(mapping):
            left_out += [(f, *problem(mapping)) for f in paths]
        elif tick is None:
            bars.append((table, mapping))
        else:
            rows = _tick_rows(table, tick, of_row)
            left_out += [(f["file"], "missing_timeframe", None) for f in found if f["timeframe"] is None]
            of_file = timeframe_from_name(name_of(F.col("block.file")))
            ticks += [(t, rows.where(of_file == t)) for t in sorted({f["timeframe"] for f in found} - {None})]
    plain = [i for i, (_, mapping) in enumerate(bars) if not mapping.readings]
    spelled = measure_all([(bars[i][0], [], sorted(set(_numbers(bars[i][1]).values()))) for i in plain]) if plain else []
    spelled = dict(zip(plain, spelled))
    bars = [mapped_rows(table, mapping, of_row, spelled.get(i)) for i, (table, mapping) in enumerate(bars)]
    return _together(spark, files, left_out, bars, ticks, mappings)


def _together(spark, files, left_out, bars, ticks, mappings) -> IngestedFiles:
    if left_out:
        more = spark.createDataFrame(left_out, "file string, late string, late_n long")
        files = files.join(more, "file", "left")
    else:
        files = files.withColumns({"late": F.lit(None).cast("string"), "late_n": F.lit(None).cast("long")})
    n = F.when(F.col("code") == "malformed_rows", F.col("deviating_lines")).otherwise(F.coalesce("late_n", "n_lines"))
    files = files.select(
        "file", "instrument", "timeframe", "separator", "fields", (F.col("n_lines") - F.col("headed").cast("int")).alias("rows"),
        F.coalesce("code", "late").alias("code"), n.alias("n"),
    )
    issues = files.where("code IS NOT NULL").groupBy("instrument", "code").agg(F.sum("n").alias("n"))
    issues = [issues.select("instrument", "code", F.lit("error").alias("severity"), "n")]
    out = spark.createDataFrame([], BAR_SCHEMA)
    accounts = spark.createDataFrame([], "instrument string, uploaded_rows long, usable_rows long, removed_rows long")
    if bars:
        raw = materialized(_union(bars))
        rows = row_accounting(raw)
        out = out.unionByName(normalize(raw), allowMissingColumns=True)
        accounts = accounts.unionByName(rows, allowMissingColumns=True)
        issues += [validate(raw), cleaning_checks(rows)]
    for timeframe, rows in ticks:
        rows = materialized(rows)
        made = tick_bars(valid_ticks(rows), timeframe, tie=["block", "line"])
        counts = made.groupBy("instrument").agg(F.count("*").alias("usable_rows"))
        out = out.unionByName(made, allowMissingColumns=True)
        accounts = accounts.unionByName(tick_accounting(rows).join(counts, "instrument", "left"), allowMissingColumns=True)
        issues.append(bar_checks(made))
    totals = files.groupBy("instrument").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("uploaded_rows"))
    per = [c for c in accounts.columns if c not in ("instrument", "uploaded_rows")]
    sums = accounts.groupBy("instrument").agg(F.sum("uploaded_rows").alias("parsed_rows"), *[F.sum(c).alias(c) for c in per])
    accounting = totals.join(sums, "instrument", "left").na.fill(0)
    kind = "TICK_AGGREGATED" if ticks and not bars else "OHLCV"
    mapping = mappings[0][1] if mappings else Mapping({})
    return IngestedFiles(kind, out, accounting, _union(issues), mapping, files, mappings)


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
