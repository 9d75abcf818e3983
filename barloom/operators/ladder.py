"""Models of rising complexity behind one fit and predict contract.

Fitting is MLlib's distributed training over the given train rows; rows with a
missing feature or target are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES, PREDICTION = "_features", "_prediction"
NAIVE = "naive_mean_baseline"


def ladder(target: str, trees: int = 200, rounds: int = 200, seed: int = 42) -> dict[str, Callable]:
    """Estimators by name, simplest first; the naive mean needs none."""
    common = {"featuresCol": FEATURES, "labelCol": target, "predictionCol": PREDICTION}
    return {
        "linear_regression": LinearRegression(**common),
        "random_forest": RandomForestRegressor(numTrees=trees, maxDepth=4, seed=seed, **common),
        "gradient_boosting": GBTRegressor(maxIter=rounds, maxDepth=3, seed=seed, **common),
    }


def predict_ladder(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    target: str,
    rungs: Sequence[str] | None = None,
    trees: int = 200,
    rounds: int = 200,
    seed: int = 42,
) -> DataFrame:
    """Test rows with one prediction column per rung."""
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="skip")
    known = train.dropna(subset=[*features, target])
    fitted = assembler.transform(known.select(*features, target))
    models = ladder(target, trees, rounds, seed)
    chosen = [NAIVE, *models] if rungs is None else list(rungs)
    out = assembler.transform(test.dropna(subset=list(features)))
    for name in chosen:
        if name == NAIVE:
            mean = known.agg(F.avg(target)).first()[0]
            out = out.withColumn(name, F.lit(mean))
        else:
            out = models[name].fit(fitted).transform(out).withColumnRenamed(PREDICTION, name)
    return out.drop(FEATURES)


def ladder_errors(predicted: DataFrame, target: str, rungs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Root mean square and mean absolute error of each rung."""
    rows = F.array(
        *[F.struct(F.lit(n).alias("model"), (F.col(n) - F.col(target)).alias("_e")) for n in rungs]
    )
    return (
        predicted.where(F.col(target).isNotNull())
        .select(*keys, F.inline(rows))
        .groupBy(*keys, "model")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
            F.avg(F.abs("_e")).alias("mae"),
        )
    )
