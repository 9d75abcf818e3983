"""Timestamps in text, recognized row by row from the classes of their tokens.

A text is cut into a date and a clock. In the date, runs of one or two digits become `d`, of
four digits `y` and month names `M`; this pattern is looked up in a table of patterns, which
says what each number is. So a column may mix spellings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.columns import as_col

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH = "(" + "|".join(MONTHS[i : i + 3] for i in range(0, 36, 3)) + r")[a-z]*\.?"
WEEKDAY = r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[., ]+"
#: Stands between the parts of a text.
MARK = "\x01"
#: Two-digit years up to this one are of this century.
LAST_SHORT_YEAR = 75

#: Hour, minute, second, fraction, half of the day (twice), sign, hours and minutes of the offset.
CLOCK = (
    r"[t, ]+(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\.?)?|\s*([ap])\.?m\.?)"
    r"\s*(?:z|utc|gmt)?\s*(?:([+-])(\d{2}):?(\d{2}))?$"
)


def _patterns() -> dict[str, str]:
    """What the numbers of a pattern are: Y, y (two digits), M, D; the month of an `M` has a name."""
    table = {"dMy": "DY", "dMd": "Dy"}
    for mark in "-/. ":
        for pattern, roles in {
            "y d d": "YMD", "d d y": "DMY", "d d d": "DMy", "d M y": "DY", "d M d": "Dy",
            "M d y": "DY", "M d d": "Dy", "y M d": "YD",
        }.items():
            table[pattern.replace(" ", mark)] = roles
    return table


PATTERNS = _patterns()


def _without_compact(x: Column) -> Column:
    """Digits without marks, `20240131 0900` or `20240131090000`, with marks."""
    plain = x
    x = F.regexp_replace(x, r"^(\d{8}|\d{12}|\d{14}|\d{8} \d{4}(?:\d{2})?)\.0$", "$1")
    x = F.regexp_replace(x, r"^(\d{8})(\d{4}(?:\d{2})?)$", "$1 $2")
    x = F.regexp_replace(x, r"^(\d{8})[ t]+(\d{2})(\d{2})(\d{2})$", "$1 $2:$3:$4")
    x = F.regexp_replace(x, r"^(\d{8})[ t]+(\d{2})(\d{2})$", "$1 $2:$3")
    x = F.regexp_replace(x, r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    return F.when(plain.rlike(r"^\d{8}"), x).otherwise(plain)


def date_pattern(date: Column) -> Column:
    """The token classes of a lower-case date."""
    named = F.regexp_replace(F.regexp_replace(date, MONTH, "M"), r"(\d)(st|nd|rd|th)\b", "$1")
    named = F.when(date.rlike("[a-z]"), named).otherwise(date)
    short = F.regexp_replace(F.regexp_replace(named, r"(?<!\d)\d{4}(?!\d)", "y"), r"(?<!\d)\d{1,2}(?!\d)", "d")
    return F.regexp_replace(short, "[, ]+", " ")


def _with(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def recognized(text: str | Column) -> Column:
    """Timestamp without zone, in UTC, or NULL.

    Read are dates with the year first, with the day first (the month if only that makes a
    date), with month names, two-digit years, and 8 digits; clocks of 24 or 12 hours, with
    fractions and offsets, which are applied. Everything else, null and empty texts are NULL.
    """
    x = F.regexp_replace(F.lower(F.trim(as_col(text))), WEEKDAY, "")
    return _with(x, lambda x: _with(_parts(_without_compact(x)), lambda p: _with(_cut(p), _read)))


def _parts(x: Column) -> Column:
    """What stands before the clock, the clock's nine parts and what is left, by one search.

    Without a clock the text alone; texts that hold the mark between parts are no timestamps.
    """
    marked = F.regexp_replace(x, CLOCK, MARK + MARK.join(f"${i}" for i in range(1, 10)) + MARK)
    return F.split(F.when(~F.contains(x, F.lit(MARK)), marked), MARK)


def _cut(parts: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in PATTERNS.items() for v in pair])
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    def fields(date: Column) -> Column:
        return F.struct(
            F.try_element_at(table, date_pattern(date)).alias("roles"),
            F.regexp_extract_all(date, F.lit(r"\d+"), F.lit(0)).alias("numbers"),
            F.when(date.rlike("[a-z]"), F.regexp_extract(date, MONTH, 1)).otherwise("").alias("month"),
            *[part(i).alias(f"c{i}") for i in range(1, 10)],
        )

    return _with(F.trim(F.concat(F.get(parts, F.lit(0)), part(10))), fields)


def _read(t: Column) -> Column:
    """The timestamp of the parts that `_cut` found."""

    def number(role: str) -> Column:
        place = F.nullif(F.instr(t.roles, role), F.lit(0))
        return F.try_element_at(t.numbers, place).try_cast("int")

    short = number("y")
    year = F.coalesce(number("Y"), short + F.when(short <= LAST_SHORT_YEAR, 2000).otherwise(1900))
    first, second = number("D"), number("M")
    swapped = F.startswith(t.roles, F.lit("DM")) & (second > 12) & (first <= 12)
    named = F.when(t.month != "", ((F.instr(F.lit(MONTHS), t.month) + 2) / 3).cast("int"))
    month = F.coalesce(F.when(swapped, first).otherwise(second), named)
    day = F.when(swapped, second).otherwise(first)
    half = F.concat(t.c5, t.c6)
    hour = F.coalesce(t.c1.try_cast("int"), F.lit(0))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    minute = F.coalesce(t.c2.try_cast("int"), F.lit(0))
    seconds = F.concat(F.when(t.c3 == "", "0").otherwise(t.c3), F.lit("."), F.substring(t.c4, 1, 6), F.lit("0"))
    at = F.call_function("try_make_timestamp_ntz", year, month, day, hour, minute, seconds.try_cast("decimal(16,6)"))
    minutes = (t.c8.try_cast("int") * 60 + t.c9.try_cast("int")) * F.when(t.c7 == "-", 1).otherwise(-1)
    return F.when(t.c7 == "", at).otherwise(F.timestamp_add("MINUTE", minutes, at))
