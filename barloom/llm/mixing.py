"""Mixing sources to target weights: hash-random order, prefix sums, one exact cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.session import materialized

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a bucket at least, and buckets of all sources together at most (apart from one for
#: each source): what one task sorts.
BUCKET_ROWS, BUCKETS = 1000, 20_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.0, epochs: float = 3.0) -> DataFrame:
    """Adds `target` to one row per source (source, rows, source_size).

    Sources by code point, null last, weigh `weights`, repeating, and share `share` of all
    sizes. A target stops at `epochs` times its source's size; the excess goes to the others by
    weight until none is above. With sources by rising size for their weight, the full ones are
    those before the first whose share of what the full ones leave lies below its limit.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    by = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / (F.sum("_w").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
    open_ = F.col("_level") * F.col("_w") < F.col("_cap")
    return (
        ranked.withColumn("_level", level)
        .withColumn("_level", F.max(F.when(open_, F.col("_level"))).over(W.partitionBy()))
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))))
        .drop("_w", "_cap", "_level")
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights=WEIGHTS,
    share: float = 1.0,
    epochs: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken.

    Documents get a hash-random key; a source's key range is cut into buckets by its number of
    rows, rows are sorted within a bucket, and the sums of the buckets before are added. A
    source takes whole epochs as far as they fit its target and then, in key order, words up to
    exactly the rest, so the last document is cut. The key depends on id and seed only, so
    reruns agree; equal keys go by id and size. Null or empty text has size 0 and is taken 0
    times; null sources are one source, null ids one key; repeated rows count each. An empty
    table gives no rows. Other columns are not read.
    """
    rows = materialized(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            (word_count(F.col(text_col)) if size is None else size.cast("long")).alias("size"),
        )
    )
    per_source = rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    total = F.sum("rows").over(W.partitionBy())
    targets = materialized(
        source_targets(per_source, weights, share, epochs)
        .withColumn("buckets", F.ceil(F.col("rows") / F.greatest(F.lit(BUCKET_ROWS), F.ceil(total / BUCKETS))))
        .withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    )
    # 52 random bits; bucket b of n holds the keys from b / n of their range on.
    text = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f":{seed}"))
    keyed = (
        rows.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("key", F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"))
        .withColumn("bucket", F.floor(F.col("key") / F.lit(float(1 << 52)) * F.col("buckets")))
    )
    size_sum = F.sum("size").alias("bucket_size")
    up_to = F.sum("bucket_size").over(W.partitionBy("source_no").orderBy("bucket"))
    sums = (
        keyed.groupBy("source_no", "bucket")
        .agg(size_sum)
        .select("source_no", "bucket", (up_to - F.col("bucket_size")).alias("ahead"))
    )
    inside = W.partitionBy("source_no", "bucket").orderBy("key", "id", "size")
    placed = keyed.withColumn(
        "inside", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    )
    whole, of = F.floor("target"), F.col("source_size")
    rounds = F.when(of > 0, F.floor(whole / of)).otherwise(F.lit(0))
    rest = whole - rounds * of - F.col("ahead") - F.col("inside")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.join(sums, ["source_no", "bucket"]).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """The mix of all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL_MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
-- Full sources: those that stay at three times their size at any level found so far.
lvl AS (
  SELECT 0 AS i, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s) AS level
  UNION ALL
  SELECT i + 1, ((SELECT sum(source_size) FROM s)
                 - (SELECT coalesce(sum(3 * source_size), 0) FROM s WHERE level * w >= 3 * source_size))::DOUBLE
                / (SELECT nullif(sum(w), 0) FROM s WHERE level * w < 3 * source_size)
  FROM lvl WHERE i < (SELECT count(*) FROM s) AND level IS NOT NULL),
f AS (SELECT max(level) AS level FROM lvl),
t AS (
  SELECT source, source_size, least(3.0 * source_size, coalesce(level * w, 3.0 * source_size))::DOUBLE AS target
  FROM s CROSS JOIN f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         floor(t.target)::BIGINT AS whole,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS rounds,
         (sum(d.size) OVER (PARTITION BY d.source
            ORDER BY ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':17'), 1, 13))::BIGINT, d.doc_id, d.size
            ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(size, whole - rounds * source_size - before)))::BIGINT AS taken
FROM p
"""
