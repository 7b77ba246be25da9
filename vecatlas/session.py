"""Session helpers: a local session for tests and benchmarks, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, settings: dict[str, str] | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vecatlas")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session without the setting (a local test) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vecatlas-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    """This application's folder for staged tables."""
    return f"{shared_dir(spark)}/vecatlas/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{_scratch(spark)}/{tag}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables this application has staged, once all results made from them are written."""
    from vecatlas.sources.storage import Storage

    Storage(spark).delete(_scratch(spark))


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Cut the lineage with a written table.

    Unlike a cached frame it survives lost executors, and unlike an RDD checkpoint it is columnar,
    is computed once and tells the optimizer its size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy work on a plain scan with fewer splits than cores.

    Large inputs have more splits than cores and pass unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def small_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """Driver-side rows as a relation whose size the optimizer knows."""
    return spark.createDataFrame(pa.table(columns), schema)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """A table that the optimizer knows to be empty, so joins with it disappear."""
    return spark.createDataFrame([], schema).limit(0)
