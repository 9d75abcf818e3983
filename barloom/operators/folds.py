"""Walk-forward folds: train slice, embargo gap, test slice, by bar position."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.timeframes import MINUTES
from barloom.operators.positions import KEY

TRAIN, TEST = "train", "test"


@dataclass(frozen=True)
class FoldPlan:
    train: int = 2000
    test: int = 500
    step: int = 500
    embargo: int = 10

    def __post_init__(self):
        if min(self.train, self.test, self.step) < 1 or self.embargo < 0:
            raise ValueError("fold sizes must be positive")

    @property
    def span(self) -> int:
        return self.train + self.embargo + self.test


def assign_folds(
    df: DataFrame, plan: FoldPlan, tail: int = 0, roles: Sequence[str] = (TRAIN, TEST)
) -> DataFrame:
    """Repeat each row once per slice holding its `pos`; adds `fold_id, role`.

    Slices are intervals of positions, so a row finds its folds by arithmetic and
    no join is needed. The last `tail` rows of each series belong to no fold.
    A slice never exceeds `plan.train` or `plan.test` rows.
    """
    last = f"CASE WHEN n_bars - {tail} >= {plan.span} THEN (n_bars - {tail} - {plan.span}) DIV {plan.step} ELSE -1 END"

    def holding(start: int, length: int, role: str) -> str:
        shifted = f"(pos - {start})"
        low = f"greatest(0, ceil(({shifted} - {length - 1}) / {plan.step}))"
        high = f"least(floor({shifted} / {plan.step}), {last})"
        ids = f"CASE WHEN {shifted} >= 0 AND {low} <= {high} THEN sequence({low}, {high}) ELSE array() END"
        return (
            f"transform({ids}, k -> named_struct('fold_id', cast(k AS int), 'role', '{role}'))"
        )

    slices = {TRAIN: (0, plan.train), TEST: (plan.train + plan.embargo, plan.test)}
    placements = ", ".join(holding(*slices[r], r) for r in roles)
    return df.selectExpr("*", f"inline(concat({placements}))")


def detect_leakage(
    folded: DataFrame, keys: Sequence[str] = KEY, ts: str = "ts"
) -> DataFrame:
    """One row per fold: shared timestamps, slice order and the verdict."""
    by = [*keys, "fold_id"]
    train, test = F.col("role") == TRAIN, F.col("role") == TEST
    return (
        folded.groupBy(*by, ts)
        .agg(F.max(train).alias("_train"), F.max(test).alias("_test"))
        .groupBy(*by)
        .agg(
            F.count_if(F.col("_train")).alias("train_bars"),
            F.count_if(F.col("_test")).alias("test_bars"),
            F.count_if(F.col("_train") & F.col("_test")).alias("overlap"),
            F.max(F.when(F.col("_train"), F.col(ts))).alias("train_end"),
            F.min(F.when(F.col("_test"), F.col(ts))).alias("test_start"),
        )
        .withColumn(
            "starts_after_train", F.coalesce(F.col("test_start") > F.col("train_end"), F.lit(True))
        )
        .withColumn("ok", (F.col("overlap") == 0) & F.col("starts_after_train"))
    )


# Rows kept back for warm-up and tail, and the smallest slices.
BUFFER, MIN_TRAIN, MIN_TEST, MIN_EMBARGO = 80, 30, 40, 1
MAX_SHRINK_STEPS = 200


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def plan_defaults(
    sizes: DataFrame, source: str | Column, target: str | Column, rows: str = "n_bars"
) -> DataFrame:
    """Proposed fold sizes for datasets of `rows` bars at spacing `source`.

    Starts from 60 % train, 18 % test and 5 % of test as embargo (1 to 10 bars)
    of the usable rows, then shrinks train, then test, until one fold fits.
    """
    from barloom.functions.timeframes import minutes_column

    def spacing(tf: str | Column) -> Column:
        if isinstance(tf, str) and tf in MINUTES:
            return F.lit(MINUTES[tf])
        return F.coalesce(minutes_column(tf), F.lit(60))

    src, dst, n = spacing(source), spacing(target), F.col(rows)
    at_target = F.when(dst <= src, n).otherwise(F.floor(n * (src / dst)))
    sized = sizes.withColumn("rows_at_timeframe", at_target.cast("bigint")).withColumn(
        "usable_bars", F.greatest(F.col("rows_at_timeframe") - BUFFER, F.lit(0))
    )
    usable = F.col("usable_bars")
    first_test = _half_up(usable * 0.18)
    embargo = F.greatest(F.lit(MIN_EMBARGO), F.least(F.lit(10), _half_up(first_test * 0.05)))
    start = F.struct(
        F.greatest(_half_up(usable * 0.6), F.lit(MIN_TRAIN)).cast("bigint").alias("train"),
        F.greatest(first_test, F.lit(MIN_TEST)).cast("bigint").alias("test"),
    )
    planned = sized.withColumn("embargo_bars", embargo.cast("int")).withColumn("_start", start)

    def shrink(state: Column, _: Column) -> Column:
        train, test = state.getField("train"), state.getField("test")
        too_big = train + F.col("embargo_bars") + test > F.col("usable_bars")
        cut = F.greatest(F.lit(1), F.floor(train * 0.05))
        smaller_train = too_big & (train > MIN_TRAIN)
        smaller_test = too_big & (train <= MIN_TRAIN) & (test > MIN_TEST)
        return F.struct(
            F.when(smaller_train, train - cut).otherwise(train).cast("bigint").alias("train"),
            F.when(smaller_test, test - 1).otherwise(test).cast("bigint").alias("test"),
        )

    settled = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_SHRINK_STEPS)), F.col("_start"), shrink)
    fitted = planned.withColumn("_fit", settled)
    train, test, gap = F.col("_fit.train"), F.col("_fit.test"), F.col("embargo_bars")
    feasible = (usable >= MIN_TRAIN + MIN_EMBARGO + MIN_TEST) & (train + gap + test <= usable)
    zero = F.lit(0)
    folds = F.greatest(F.lit(1), F.floor((usable - train - gap - test) / test) + 1)
    return fitted.select(
        *sizes.columns,
        "rows_at_timeframe",
        "usable_bars",
        feasible.alias("feasible"),
        F.when(feasible, train).otherwise(zero).alias("train_bars"),
        F.when(feasible, test).otherwise(zero).alias("test_bars"),
        F.when(feasible, test).otherwise(zero).alias("step_bars"),
        F.when(feasible, gap).otherwise(zero).cast("bigint").alias("embargo_bars"),
        F.when(feasible, folds).otherwise(zero).cast("bigint").alias("estimated_folds"),
    )


def fold_fits(usable: Column, plan: FoldPlan) -> Column:
    """Whether at least one fold fits into the usable bars."""
    return F.lit(plan.span) <= usable
