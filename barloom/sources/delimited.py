"""Delimited text: profile, layout and all-string tables.

Profiles work on a frame of lines (`value`, plus `block, line` giving the file position), so a
directory of any size is profiled in parallel and the driver only sees counts per separator.
Records are read by Spark's CSV reader.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import as_col
from barloom.sources.naming import normalized_header
from barloom.sources.schema import header_test

# Separators tried.
SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t", "space": r"\s+"}
HEADER_BONUS = 20.0
MIN_FIELDS = 3
#: Holds a record whose number of fields is not the layout's.
CORRUPT = "_corrupt"


class LayoutError(ValueError):
    """The text is not one consistently delimited table."""


@dataclass(frozen=True)
class Layout:
    separator: str
    fields: int
    header: tuple[str, ...] | None

    @property
    def columns(self) -> list[str]:
        if self.header is None:
            return [f"column_{i + 1}" for i in range(self.fields)]
        return [h if h else f"column_{i + 1}" for i, h in enumerate(self.header)]

    @property
    def schema(self) -> str:
        return ", ".join(f"f{i} string" for i in range(self.fields))

    @property
    def options(self) -> dict[str, str]:
        """Of the CSV reader: a doubled quote inside quotes is one quote."""
        return {"sep": self.separator, "quote": '"', "escape": '"'}


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines of all files under `path` with their file and position."""
    raw = spark.read.option("encoding", encoding).text(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    return raw.select("value", place.alias("block"), F.monotonically_increasing_id().alias("line"))


def field_count(value: str | Column, separator: str) -> Column:
    """Fields of a line; a field that starts with a quote runs to the closing one."""
    v = as_col(value)
    if separator == SEPARATORS["space"]:
        return F.size(F.split(F.trim(v), separator))
    quoted = rf'(^|{separator})"[^"]*+(?:""[^"]*+)*+(?:"|$)'
    return F.size(F.split(F.regexp_replace(v, quoted, "$1"), separator, -1))


def _nonblank(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("value") != "")


def _counts(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines by their four field counts, with the earliest and whether quotes stay open."""
    return (
        _nonblank(lines)
        .groupBy(*keys, *[field_count("value", s).alias(name) for name, s in SEPARATORS.items()])
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("block", "line", "value")).alias("first"),
            F.max(F.length(F.regexp_replace("value", '[^"]', "")) % 2 > 0).alias("open"),
        )
    )


def _by_separator(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("separator"), F.col(s).alias("fields")) for s in SEPARATORS])
    return counts.select(*keys, "n", F.inline(pairs)).groupBy(*keys, "separator", "fields").agg(F.sum("n").alias("n_lines"))


def field_profile(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lines per separator and field count, over the whole text; for each of `keys` if given."""
    return _by_separator(_counts(lines, keys), keys)


def separator_quality(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent field count per separator, its share, and the deviating lines."""
    return profile.groupBy(*keys, "separator").agg(
        F.max_by("fields", F.struct("n_lines", "fields")).alias("fields"),
        (F.max("n_lines") / F.sum("n_lines")).alias("consistency"),
        (F.sum("n_lines") - F.max("n_lines")).alias("deviating_lines"),
    )


def layouts(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best separator of each text: keys, separator, fields, deviating_lines, n_lines, first,
    open, headed. Fields is NULL where no separator gives two.

    A separator counts by its consistency times its fields, up to ten, and by a bonus where the
    first line is then a header.
    """
    counts = _counts(lines, keys)
    whole = counts.groupBy(*keys).agg(
        F.min("first")["value"].alias("first"), F.sum("n").alias("n_lines"), F.max("open").alias("open")
    )
    quality = separator_quality(_by_separator(counts, keys), keys)
    cells = F.create_map(*[x for name, s in SEPARATORS.items() for x in (F.lit(name), F.split(F.trim("first"), s, -1))])
    headed = header_test(F.transform(F.element_at(cells, F.col("separator")), normalized_header))
    score = F.col("consistency") * F.least("fields", F.lit(10)) + F.when(F.col("headed"), HEADER_BONUS).otherwise(0.0)
    sign = F.create_map(*[F.lit(x) for name, s in SEPARATORS.items() for x in (name, s)])
    chosen = F.struct(score.alias("score"), "fields", F.element_at(sign, F.col("separator")).alias("sign"), "separator", "deviating_lines", "headed")
    joined = quality.join(whole, list(keys)) if keys else quality.crossJoin(whole)
    best = (
        joined.withColumn("headed", headed)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("fields") >= 2, chosen)).alias("best"),
            *[F.first(c).alias(c) for c in ("first", "n_lines", "open")],
        )
    )
    return best.select(*keys, "best.separator", "best.fields", "best.deviating_lines", "n_lines", "first", "open", "best.headed")


def choose_layout(lines: DataFrame) -> Layout:
    """Separator and header of a text whose first line is its earliest."""
    found = layouts(lines, []).first()
    if found is None or found["first"] is None:
        raise LayoutError("the text holds no lines")
    if found["fields"] is None:
        raise LayoutError("the text is not consistently delimited")
    if found["deviating_lines"]:
        raise LayoutError(f"{found['deviating_lines']} line(s) do not have {found['fields']} fields")
    if found["fields"] < MIN_FIELDS:
        raise LayoutError("fewer than three columns")
    plain = Layout(SEPARATORS[found["separator"]], found["fields"], None)
    if not found["headed"]:
        return plain
    return by_layout([Row(file="", **found.asDict())])[0][0]


def by_layout(files: Sequence[Row]) -> list[tuple[Layout, list[Row]]]:
    """The different layouts of files, rows like those of `layouts` with a column `file`."""
    out: dict = {}
    for row in files:
        sign, header = SEPARATORS[row["separator"]], None
        if row["headed"]:
            first = row["first"].strip()
            cells = first.split() if row["separator"] == "space" else next(csv.reader([first], delimiter=sign))
            header = tuple(c.strip() for c in cells)
        out.setdefault(Layout(sign, row["fields"], header), []).append(row)
    return sorted(out.items(), key=lambda x: min(r["file"] for r in x[1]))


def read_files(spark: SparkSession, files: Sequence[str], layout: Layout, multi_line: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """All-string table of files of one layout, with `block, line` and records of another number
    of fields in CORRUPT.

    Records may hold line breaks inside quotes if `multi_line` is set; a file is then read by
    one task, else its blocks are read by many.
    """
    paths = [unquote(f) for f in files]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block")
    line = F.monotonically_increasing_id().alias("line")
    if layout.separator == SEPARATORS["space"]:
        lines = _nonblank(spark.read.option("encoding", encoding).text(paths)).select(place, line, F.col("value"))
        cells = F.split(F.trim("value"), layout.separator)
        rows = lines.select("block", "line", *[F.get(cells, F.lit(i)).alias(f"f{i}") for i in range(layout.fields)], F.when(F.size(cells) != layout.fields, F.col("value")).alias(CORRUPT))
    else:
        reader = spark.read.schema(f"{layout.schema}, {CORRUPT} string").options(**layout.options)
        # Pruned columns would leave the number of fields unchecked.
        reader = reader.options(encoding=encoding, multiLine=multi_line, columnPruning=False, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        rows = reader.csv(paths).select(place, line, *[f"f{i}" for i in range(layout.fields)], CORRUPT)
        blank = F.lit(True)
        for i in range(layout.fields):
            blank &= F.coalesce(F.trim(f"f{i}"), F.lit("")) == ""
        rows = rows.where(~blank)
    return _named(rows, layout, [CORRUPT])


def _named(rows: DataFrame, layout: Layout, more: Sequence[str] = ()) -> DataFrame:
    """Fields under the layout's names, without lines that repeat the header."""
    if layout.header is not None:
        cells = F.array(*[F.coalesce(F.trim(f"f{i}"), F.lit("")) for i in range(layout.fields)])
        rows = rows.where(cells != F.array(*[F.lit(h) for h in layout.header]))
    names = [F.col(f"f{i}").alias(c) for i, c in enumerate(layout.columns)]
    return rows.select("block", "line", *names, *more)


def to_table(lines: DataFrame, layout: Layout) -> DataFrame:
    """All-string table with the layout's column names; header lines are dropped."""
    text = _nonblank(lines)
    if layout.separator == SEPARATORS["space"]:
        cells = F.split(F.trim("value"), layout.separator)
        rows = text.select("block", "line", *[F.get(cells, F.lit(i)).alias(f"f{i}") for i in range(layout.fields)])
    else:
        rows = text.select("block", "line", F.from_csv("value", layout.schema, layout.options).alias("_f"))
        rows = rows.select("block", "line", "_f.*")
    return _named(rows, layout)
