"""Text to timestamps and numbers.

Timestamps are recognized row by row. Of numbers one spelling is chosen per column: shares of
readable values over the whole column come from one aggregate; the driver sees those few numbers
and picks the expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import as_col
from barloom.sources.timestamps import recognized

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
COMMA_RETRY = 0.3


def number(text: str | Column) -> Column:
    """Plain decimal number, else NULL."""
    x = F.trim(as_col(text))
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def comma_number(text: str | Column) -> Column:
    return number(F.replace(as_col(text), F.lit(","), F.lit(".")))


def share(known: Column) -> Column:
    return F.avg(F.when(known.isNotNull(), 1.0).otherwise(0.0))


def named(column: str) -> Column:
    """A column by its name, whatever marks that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def measure(df: DataFrame, times: Sequence[str], numbers: Sequence[str]) -> dict[str, float]:
    return measure_all([(df, times, numbers)])[0]


def measure_all(asked: Sequence[tuple[DataFrame, Sequence[str], Sequence[str]]]) -> list[dict[str, float]]:
    """Shares of readable, non-negative and whole values per reading, of all tables in one pass.

    Columns are stacked, so each reading is compiled once whatever the table's width;
    a column is only tried as what it is listed for. One row per column comes back.
    """
    stacked = None
    for i, (df, times, numbers) in enumerate(asked):
        cells = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    named(c).alias("text"),
                    F.lit(c in times).alias("as_time"),
                    F.lit(c in numbers).alias("as_number"),
                )
                for c in dict.fromkeys([*times, *numbers])
            ]
        )
        rows = df.select(F.lit(i).alias("table"), F.inline(cells))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    wanted = [share(F.when(F.col("as_time"), recognized("text"))).alias("t")]
    for kind, e in (("n", number("text")), ("c", comma_number("text"))):
        v = F.when(F.col("as_number"), e)
        whole = F.abs(v - F.round(v)) < 1e-9
        wanted += [
            share(v).alias(kind),
            share(F.when(v >= 0, v)).alias(f"{kind}+"),
            F.avg(F.when(v.isNotNull(), whole.cast("double"))).alias(f"{kind}i"),
        ]
    rows = stacked.groupBy("table", "column").agg(*wanted).collect()
    kinds = ["t", "n", "n+", "ni", "c", "c+", "ci"]
    found = {(r["table"], f"{r['column']}#{k}"): r[k] or 0.0 for r in rows for k in kinds}
    out = []
    for i, (_, times, numbers) in enumerate(asked):
        listed = dict.fromkeys([*times, *numbers])
        out.append({f"{c}#{k}": found.get((i, f"{c}#{k}"), 0.0) for c in listed for k in kinds})
    return out


def time_reading(measured: dict[str, float], column: str) -> tuple[Column, float]:
    """Reading of a time column and the share of its rows that have one."""
    return recognized(named(column)), measured[f"{column}#t"]


def _number_kind(measured: dict[str, float], column: str) -> str:
    plain, comma = measured[f"{column}#n"], measured[f"{column}#c"]
    return "c" if 1 - plain > COMMA_RETRY and comma > plain else "n"


def number_reading(measured: dict[str, float], column: str) -> tuple[Column, float]:
    """Chosen reading of a numeric column and its share."""
    kind = _number_kind(measured, column)
    reading = comma_number(named(column)) if kind == "c" else number(named(column))
    return reading, measured[f"{column}#{kind}"]


def number_traits(measured: dict[str, float], column: str) -> tuple[float, float]:
    """Shares of non-negative values among all, and of whole ones among numbers."""
    kind = _number_kind(measured, column)
    return measured[f"{column}#{kind}+"], measured[f"{column}#{kind}i"]


def choose_readings(
    df: DataFrame, times: Sequence[str], numbers: Sequence[str]
) -> tuple[dict[str, Column], dict[str, float]]:
    """Expression per column and its share of readable values, from one pass."""
    measured = measure(df, times, numbers)
    found = {t: time_reading(measured, t) for t in times}
    found |= {n: number_reading(measured, n) for n in numbers}
    return {c: f[0] for c, f in found.items()}, {c: f[1] for c, f in found.items()}


def joined_date_time(df: DataFrame, date: str, time: str, name: str) -> DataFrame:
    """One text column from Date and Time; digits lost to number types come back.

    Numeric dates are padded to 8 digits; numeric times to 6 if any exceeds 2359,
    else to 4. Columns that are mostly text stay as they are.
    """
    d, t = number(date), number(time)
    facts = df.agg(share(d).alias("d"), share(t).alias("t"), F.max(t).alias("top")).first()
    width = 6 if (facts["top"] or 0) > 2359 else 4

    def padded(text: str, value: Column, known: float | None, n: int) -> Column:
        if (known or 0) < 0.95:
            return F.trim(text)
        return F.coalesce(F.lpad(value.cast("bigint").cast("string"), n, "0"), F.lit(""))

    combined = F.concat_ws(" ", padded(date, d, facts["d"], 8), padded(time, t, facts["t"], width))
    return df.withColumn(name, combined)
