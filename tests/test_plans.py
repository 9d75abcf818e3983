"""Physical plans: what is shuffled, sorted, pruned and pushed down."""

from pyspark.sql import functions as F

from barloom.operators.bars import tick_bars
from barloom.operators.features import feature_matrix
from barloom.operators.folds import FoldPlan, assign_folds
from barloom.operators.quality import first_per_time
from barloom.plans.backtest import Research, scored_train
from barloom.sources.ranges import tail
from barloom.sources.tables import parquet_bars


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_take_one_shuffle_and_one_sort(bars):
    text = plan(feature_matrix(bars))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [") == 1
    assert "_chunk" in text.split("Exchange hashpartitioning")[1][:80]


def test_unwanted_features_cost_nothing(bars):
    text = plan(feature_matrix(bars, (), keep=["momentum_5"]))
    assert text.count("Window [") == 1 and "stddev" not in text
    narrow = plan(feature_matrix(bars, (), keep=["momentum_5"]).select("momentum_5"))
    assert "volume" not in narrow[narrow.index("ReadSchema") :]


def test_folds_need_no_join(bars):
    assert "Join" not in plan(assign_folds(bars, FoldPlan(200, 50, 50, 5)))


def test_train_slices_shuffle_once(bars):
    text = plan(scored_train(bars, Research(plan=FoldPlan(200, 50, 50, 5))))
    assert text.count("Exchange hashpartitioning") == 1


def test_ticks_aggregate_by_hash(spark):
    ticks = spark.range(10).selectExpr(
        "'A' AS instrument", "cast(timestamp_seconds(id) AS timestamp_ntz) AS ts", "1D AS price", "id"
    )
    for tie in ([], ["id"]):
        text = plan(tick_bars(ticks, "1min", tie=tie))
        assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_time_bounds_reach_the_scan(spark, bars, tmp_path):
    path = str(tmp_path / "b")
    bars.write.parquet(path)
    text = plan(parquet_bars(spark, path, "2024-01-05", "2024-01-09T12:00:00Z").select("ts", "close"))
    pushed = text[text.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed
    assert "struct<ts:timestamp_ntz,close:double>" in text


def test_rank_limits_apply_before_the_shuffle(bars):
    raw = bars.withColumn("block", F.lit(0)).withColumn("line", F.col("pos"))
    for df in (tail(bars, 5), first_per_time(raw)):
        text = plan(df)
        assert "WindowGroupLimit" in text[text.index("Exchange") :]
