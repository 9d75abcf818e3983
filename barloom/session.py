"""Session settings every job of the engine relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go when it ends; else when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Settings a job needs on any session.

    All wall-clock columns are UTC and zone-less text is read as UTC. HotSpot leaves
    methods over 8000 bytes uncompiled, which the wide feature projections would
    exceed as one generated method; below the limit Spark splits them.
    """
    for name, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }.items():
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cpus: str = "*", partitions: int = 8, app: str = "barloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Window-heavy stages cost far more CPU than their bytes suggest.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", ""
    )
    if conf:
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    """One temporary folder per local process, removed when it ends."""
    folder = tempfile.TemporaryDirectory(prefix="barloom-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return folder.name


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/barloom-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, and read it back.

    The branches then scan only their columns, their plans stay short, and the
    planner knows the real size. The files live in the shared folder, `discard` removes them;
    those that the write shuffled go when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of materialized frames that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            if folder.rpartition("/")[2].startswith("barloom-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
