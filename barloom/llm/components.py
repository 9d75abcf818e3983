"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import discard, materialized


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; component is its smallest node.

    Each round joins every node with the smallest node around it, first for the larger
    neighbours, then for the smaller ones, until the links are stars. Hubs are reduced to
    their minimum before they are joined, so that skewed joins can be split. Each round is
    written to the shared folder. Links with a null end or to themselves are left out; no
    links give no rows.
    """
    ends = [F.col(a).cast("long"), F.col(b).cast("long")]
    edges = materialized(
        links.where(ends[0] != ends[1])
        .select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v"))
        .distinct()
    )
    while _unsettled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        settled = materialized(small)
        discard(edges)
        edges = settled
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _unsettled(edges: DataFrame) -> bool:
    """Whether the links aren't stars yet, with the smallest node in the middle."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not sums.where("up > 1 or up > 0 and down > 0").isEmpty()
