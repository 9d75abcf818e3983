"""Bar positions, and windows over time chunks instead of whole instruments.

Nearly every operator means "the previous n rows of this instrument". A window
partitioned by instrument alone would put an instrument that holds a third of
all rows into one task. So rows first get their exact 0-based position, computed
from per-day counts, and windows then run over fixed-size runs of positions that
also receive the few rows before and after them that their frames reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per chunk: a few hundred MB of task memory at most, and a multiple of the
# block length used by the exponentially weighted sums.
CHUNK_ROWS = 65_536

KEY = ("instrument",)


def with_position(
    bars: DataFrame,
    keys: Sequence[str] = KEY,
    order: str = "ts",
    bucket: Column | None = None,
) -> DataFrame:
    """Add `pos` (0-based rank of `order` within the keys) and `n_bars`.

    `bucket` must be monotone in `order`; a UTC day by default. Only one small
    row per (keys, bucket) enters the running sum, and no task sorts more than
    one bucket of bars.
    """
    bucket = F.date_trunc("day", F.col(order)) if bucket is None else bucket
    marked = bars.withColumn("_bucket", bucket)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("n_bars"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        marked.join(offsets, [*keys, "_bucket"])
        .withColumn("pos", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def with_halo(
    df: DataFrame, back: int, forward: int = 0, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add `_chunk` and `_core`; copy the rows around each chunk into it.

    Every row is core in exactly one chunk. The last `back` rows of a chunk are
    repeated in the next one and the first `forward` rows in the previous one,
    so a frame reaching that far sees the same rows as over the whole series.
    """
    if back > chunk_rows or forward > chunk_rows:
        raise ValueError("the halo must not be longer than a chunk")
    chunk = F.floor(F.col("pos") / chunk_rows)
    offset = F.col("pos") % chunk_rows

    def place(c: Column, core: bool) -> Column:
        return F.struct(c.alias("_chunk"), F.lit(core).alias("_core"))

    placements = [place(chunk, True)]
    if back:
        placements.append(F.when(offset >= chunk_rows - back, place(chunk + 1, False)))
    if forward:
        placements.append(F.when((offset < forward) & (chunk > 0), place(chunk - 1, False)))
    return df.select("*", F.inline(F.filter(F.array(*placements), lambda p: p.isNotNull())))


def core_only(df: DataFrame) -> DataFrame:
    """Drop the copies made by `with_halo`."""
    return df.where("_core").drop("_core", "_chunk")


def chunk_window(keys: Sequence[str] = KEY, order: str = "pos") -> Window:
    return Window.partitionBy(*keys, "_chunk").orderBy(order)


def with_gap(df: DataFrame, keys: Sequence[str] = KEY, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `gap_us`, microseconds since the instrument's previous bar."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(chunk_window(keys))
    return core_only(with_halo(df, back=1, chunk_rows=chunk_rows).withColumn("gap_us", gap))
