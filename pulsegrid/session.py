"""Session settings and scratch folders.

The library works in UTC: every entry point that reads a naive timestamp goes through
:func:`use_utc`. Scratch data (checkpoints, files a query derives and reads back) lives below
``spark.checkpoint.dir`` when the cluster names one, because executors must be able to see it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "pulsegrid", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A small session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Python gets at most so many rows at once. Spark's 10,000 texts are tens of MB, which the JVM holds outside its heap,
    and keeps room for, in every task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. A temporary one only in local mode, where driver and executor are one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="pulsegrid-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives executor loss."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder that a micro-batch is done with, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
