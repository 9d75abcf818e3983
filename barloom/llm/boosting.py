"""Gradient-boosted trees of MLlib on a bounded sample, as SQL or as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialized


@dataclass(frozen=True)
class Trees:
    """trees: (feature, threshold, left, right), or a number at a leaf; without trees, `prior`."""

    features: tuple[str, ...]
    trees: tuple
    prior: float

    def probability(self) -> Column:
        """Of class 1, over columns named as the features."""
        if not self.trees:
            return F.lit(self.prior)
        return F.expr(f"1 / (1 + exp(-2 * ({' + '.join(self._sql(t) for t in self.trees)})))")

    def _sql(self, node) -> str:
        if isinstance(node, float):
            return f"{node!r}D"
        f, at, left, right = node
        return f"(CASE WHEN `{self.features[f]}` <= {at!r}D THEN {self._sql(left)} ELSE {self._sql(right)} END)"

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same probability for rows of features."""
        if not self.trees:
            return np.full(len(x), self.prior)
        margin = np.zeros(len(x))
        for tree in self.trees:
            self._add(tree, x, np.arange(len(x)), margin)
        return 1 / (1 + np.exp(-2 * margin))

    def _add(self, node, x, rows, margin) -> None:
        if isinstance(node, float):
            margin[rows] += node
        elif len(rows):
            f, at, left, right = node
            low = x[rows, f] <= at
            self._add(left, x, rows[low], margin)
            self._add(right, x, rows[~low], margin)


def bounded(rows: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """About `most` rows of each label, chosen by a hash of key."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes or max(sizes.values()) <= most:
        return rows
    keep = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(1.0)
    for value, n in sizes.items():
        share = F.when(F.col(label).eqNullSafe(F.lit(value)), most / n).otherwise(share)
    return rows.where(keep < share)


def train(rows: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 4) -> Trees:
    """Trees from rows with numeric features and a 0/1 label; one class only gives its share."""
    rows = materialized(rows.select(F.col(label).cast("double").alias("label"), *(F.col(f).cast("double") for f in features)))
    ones, n = rows.agg(F.sum("label"), F.count("*")).first()
    if not n or ones in (0, n):
        return Trees(tuple(features), (), float(ones / n) if n else 0.0)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", "label").coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32).fit(data)
    weights = model.treeWeights
    grown = tuple(_grown(t._java_obj.rootNode(), w) for t, w in zip(model.trees, weights))
    return Trees(tuple(features), grown, float(ones / n))


def _grown(node, weight: float):
    if node.subtreeDepth() == 0:
        return float(node.prediction() * weight)
    split = node.split()
    return (split.featureIndex(), float(split.threshold()), _grown(node.leftChild(), weight), _grown(node.rightChild(), weight))
