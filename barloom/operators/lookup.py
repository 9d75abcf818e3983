"""Order over whole groups of any size: sums and last steps carried from range to range.

Rows are range-partitioned by group and order, so a large group lies in as many ranges as its
share of the rows asks for. Within a range a window does the work; what all earlier ranges of
the group bring along is one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialized

BEFORE = (Window.unboundedPreceding, -1)


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with `_piece`, the number of their range of keys and order, written once.

    Ranges come from a sample, so they balance the work but change no result; writing them
    keeps them the same wherever the rows are read, also after an executor is lost.
    """
    return materialized(df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the sum of an expression over all earlier rows of the group."""
    placed = in_pieces(df.withColumns({f"_s_{n}": e for n, e in sums.items()}), keys, order)
    across = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(*BEFORE)
    zero = {n: F.lit(0).cast(dict(placed.dtypes)[f"_s_{n}"]) for n in sums}
    totals = placed.groupBy(*keys, "_piece").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    starts = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"),
        *[F.coalesce(F.sum(f"_t_{n}").over(across), zero[n]).alias(f"_b_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(*BEFORE)
    summed = placed.select("*", *[F.coalesce(F.sum(f"_s_{n}").over(inside), zero[n]).alias(f"_i_{n}") for n in sums])
    same = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return summed.join(starts, same).select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])


def last_step(
    steps: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    at: str,
    payload: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Add to each probe the payload of the last step with `at` <= (or <) its own.

    Steps and probes are sorted together, and one step per range is carried on. Probes before
    every step get NULLs.
    """
    types = dict(steps.dtypes)
    extra = [c for c in probes.columns if c not in {*keys, at}]
    carried = F.struct(*payload)
    absent = F.lit(None).cast("struct<" + ",".join(f"`{c}`:{types[c]}" for c in payload) + ">")
    left = steps.select(
        *keys,
        at,
        F.lit(1 if strict else 0).alias("_order"),
        carried.alias("_step"),
        *[F.lit(None).cast(dict(probes.dtypes)[c]).alias(c) for c in extra],
    )
    right = probes.select(
        *keys, at, F.lit(0 if strict else 1).alias("_order"), absent.alias("_step"), *extra
    )
    is_probe = F.col("_order") == (0 if strict else 1)
    both = in_pieces(left.unionByName(right), keys, [at, "_order"])
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(*BEFORE)
    known = F.when(F.col("_step").isNotNull(), F.struct(at, "_order"))
    before = (
        both.groupBy(*keys, "_piece")
        .agg(F.max_by("_step", known).alias("_last"))
        .select(*keys, "_piece", F.last("_last", True).over(earlier).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(at, "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_step", True).over(inside)).where(is_probe)
    hit = F.coalesce("_in", "_before")
    return found.join(before, [*keys, "_piece"]).select(*probes.columns, *[hit.getField(c).alias(c) for c in payload])
