"""Bar tables at rest: providers, sink, fingerprint, dataset and experiment records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.operators.bars import PRICES
from barloom.sources.ranges import between, with_provenance

BAR_SCHEMA = "instrument string, ts timestamp_ntz, open double, high double, low double, close double, volume double"

DATASET_SCHEMA = (
    "dataset_id string, original_filename string, instrument string, source_timeframe string,"
    " storage_key string, content_hash string, n_rows bigint, start_time timestamp_ntz,"
    " end_time timestamp_ntz, columns array<string>, timezone string, is_synthetic boolean,"
    " uploaded_at timestamp_ntz"
)

EXPERIMENT_SCHEMA = (
    "experiment_id string, instrument string, timeframe string, model string, data_mode string,"
    " random_seed int, git_commit string, created_at timestamp_ntz, config string, metrics string,"
    " features array<string>"
)


class StoreError(ValueError):
    """A stored dataset does not match its record."""


def csv_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Headered CSV bars with a `timestamp` column, inside the bounds."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    typed = raw.select(
        F.col("timestamp").cast("timestamp").cast("timestamp_ntz").alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in raw.columns if c in {*PRICES, "volume", "bid", "ask"}],
        *[F.col(c) for c in raw.columns if c == "instrument"],
    )
    return with_provenance(between(typed, start, end), "CSV_LOCAL")


def parquet_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parquet bars inside the bounds (pushed down to the scan)."""
    return with_provenance(between(spark.read.parquet(path), start, end), "PARQUET_LOCAL")


def write_bars(bars: DataFrame, path: str, timeframe: str) -> None:
    """Bars by instrument and timeframe; each file holds one instrument in time order.

    A hot instrument spreads over many tasks: rows are also split by month.
    """
    month = F.date_trunc("month", F.col("ts"))
    (
        bars.withColumn("timeframe", F.lit(timeframe))
        .repartition(F.col("instrument"), month)
        .sortWithinPartitions("instrument", "ts")
        .write.mode("append")
        .partitionBy("instrument", "timeframe")
        .parquet(path)
    )


def _sums(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Rows and the order-free sum of their hashes; a null counts in its own column."""
    hashed = F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())]).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(hashed), F.lit(0).cast("decimal(38,0)")).alias("total")]


def _content_hash() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.col("total").cast("string"), "n_rows"), 256), 1, 16).alias("content_hash")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free hash of the content: 16 hex digits."""
    return df.agg(*_sums(df, sorted(columns or df.columns))).select("n_rows", _content_hash())


def part_fingerprints(bars: DataFrame, columns: Sequence[str] | None = None, part: str = "yyyy-MM") -> DataFrame:
    """Fingerprints of the parts of a table: instrument, part (of ts), n_rows, total, content_hash.

    Sums add up, so what is appended is read alone and its parts are united with those known.
    """
    keyed = bars.select("*", F.date_format("ts", part).alias("part"))
    sums = keyed.groupBy("instrument", "part").agg(*_sums(bars, sorted(columns or bars.columns)))
    return sums.select("*", _content_hash())


def united(*parts: DataFrame) -> DataFrame:
    """Fingerprints of parts that several tables hold, as if of one table."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    sums = rows.groupBy("instrument", "part").agg(F.sum("n_rows").alias("n_rows"), F.sum("total").cast("decimal(38,0)").alias("total"))
    return sums.select("*", _content_hash())


def whole_fingerprint(parts: DataFrame) -> DataFrame:
    """The fingerprint of the table that has these parts."""
    sums = parts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(38,0)").alias("total"))
    return sums.select("n_rows", _content_hash())


def differing_parts(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Parts whose content isn't the recorded one: instrument, part, recorded_rows, found_rows."""
    a = recorded.select("instrument", "part", F.col("n_rows").alias("recorded_rows"), F.col("content_hash").alias("_a"))
    b = found.select("instrument", "part", F.col("n_rows").alias("found_rows"), F.col("content_hash").alias("_b"))
    return a.join(b, ["instrument", "part"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def register_dataset(
    bars: DataFrame,
    store: str,
    filename: str,
    instrument: str,
    timeframe: str,
    synthetic: bool = False,
) -> str:
    """Write bars and their record; returns the dataset id."""
    spark = bars.sparkSession
    dataset_id = uuid.uuid4().hex
    key = f"bars/{dataset_id}"
    write_bars(bars.withColumn("instrument", F.lit(instrument)), f"{store}/{key}", timeframe)
    written = spark.read.parquet(f"{store}/{key}")
    columns = [c for c in written.columns if c not in ("instrument", "timeframe")]
    mark = fingerprint(written, columns).first()
    extent = written.agg(F.min("ts"), F.max("ts")).first()
    record = (
        dataset_id, filename, instrument, timeframe, key, mark["content_hash"], mark["n_rows"],
        extent[0], extent[1], columns, "UTC", synthetic, _now(),
    )
    spark.createDataFrame([record], DATASET_SCHEMA).write.mode("append").parquet(f"{store}/datasets")
    return dataset_id


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log; one that nothing was written to yet is empty. Other faults are the caller's."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_datasets(spark: SparkSession, store: str, limit: int = 100) -> DataFrame:
    records = _read(spark, f"{store}/datasets", DATASET_SCHEMA)
    return records.orderBy(F.col("uploaded_at").desc()).limit(limit)


def get_dataset(spark: SparkSession, store: str, dataset_id: str) -> dict | None:
    found = _read(spark, f"{store}/datasets", DATASET_SCHEMA).where(F.col("dataset_id") == dataset_id)
    row = found.first()
    return row.asDict() if row else None


def load_dataset(spark: SparkSession, store: str, dataset_id: str) -> DataFrame:
    """Bars of a record after checking them against it."""
    record = get_dataset(spark, store, dataset_id)
    if record is None:
        raise KeyError(dataset_id)
    bars = spark.read.parquet(f"{store}/{record['storage_key']}")
    missing = [c for c in PRICES if c not in bars.columns]
    if missing:
        raise StoreError(f"dataset {dataset_id} lacks {missing}")
    mark = fingerprint(bars, record["columns"]).first()
    if mark["n_rows"] == 0 or mark["n_rows"] != record["n_rows"]:
        raise StoreError(f"dataset {dataset_id}: {mark['n_rows']} rows, {record['n_rows']} recorded")
    if mark["content_hash"] != record["content_hash"]:
        raise StoreError(f"dataset {dataset_id} does not match its recorded content")
    source = "DEMO_SYNTHETIC" if record["is_synthetic"] else "UPLOADED_CSV"
    return with_provenance(bars.drop("timeframe"), source, record["is_synthetic"])


def append_experiments(records: DataFrame, store: str) -> None:
    """Append records, as many as there are, to the experiment log; columns they lack are null."""
    fields = StructType.fromDDL(EXPERIMENT_SCHEMA).fields
    whole = [(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    records.select(*whole).write.mode("append").parquet(f"{store}/experiments")


def log_experiment(
    spark: SparkSession,
    store: str,
    instrument: str,
    timeframe: str,
    model: str,
    data_mode: str,
    seed: int,
    config: dict,
    metrics: dict,
    features: Sequence[str],
) -> str:
    experiment_id = uuid.uuid4().hex
    record = (
        experiment_id, instrument, timeframe, model, data_mode, seed, None, _now(),
        json.dumps(config, default=str), json.dumps(metrics, default=str), list(features),
    )
    append_experiments(spark.createDataFrame([record], EXPERIMENT_SCHEMA), store)
    return experiment_id


def _experiments(spark: SparkSession, store: str) -> DataFrame:
    logged = _read(spark, f"{store}/experiments", EXPERIMENT_SCHEMA)
    gone = _read(spark, f"{store}/experiments_deleted", "experiment_id string")
    return logged.join(gone, "experiment_id", "left_anti")


def list_experiments(spark: SparkSession, store: str, limit: int = 50) -> DataFrame:
    shown = ["experiment_id", "instrument", "timeframe", "model", "data_mode", "created_at", "metrics"]
    return _experiments(spark, store).orderBy(F.col("created_at").desc()).limit(limit).select(*shown)


def get_experiment(spark: SparkSession, store: str, experiment_id: str) -> dict | None:
    row = _experiments(spark, store).where(F.col("experiment_id") == experiment_id).first()
    if row is None:
        return None
    record = row.asDict()
    return record | {k: json.loads(record[k]) for k in ("config", "metrics")}


def delete_experiment(spark: SparkSession, store: str, experiment_id: str) -> bool:
    """Append a deletion mark; readers leave marked experiments out."""
    if get_experiment(spark, store, experiment_id) is None:
        return False
    mark = spark.createDataFrame([(experiment_id,)], "experiment_id string")
    mark.write.mode("append").parquet(f"{store}/experiments_deleted")
    return True
