"""Session defaults, lineage cuts and size-checked joins shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that a hinted broadcast may hold; beyond it Spark's own strategy decides.
BROADCAST_LIMIT = 16 * 1024 * 1024


def session(app: str = "siltstone", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or, in
    local mode only, a new temporary folder where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Ends the lineage with a table that survives lost executors; columns are
    pruned and filters pushed down on later reads. Removed when Python exits.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


_PATHS: dict[int, tuple[DataFrame, str]] = {}


def done_with(df: DataFrame) -> None:
    """Removes the table behind what `cut` gave, once nothing reads it any more; other frames are left alone."""
    held = _PATHS.pop(id(df), None)
    if held is not None:
        _remove(df.sparkSession, held[1])


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer: a small table in one row group would keep one core busy.

    Large tables have more partitions than cores and pass as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Hint a broadcast of df if `rows` (a proven bound) fits under BROADCAST_LIMIT."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_LIMIT else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
