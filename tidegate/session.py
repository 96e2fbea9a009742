"""Session settings and table access shared by every module."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidegate")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder.

    The folder is the one the session names in spark.checkpoint.dir; where that
    is unset and all runs in one process, a temporary one is named there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tidegate_shared", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = spark._tidegate_shared = tempfile.mkdtemp(prefix="tidegate-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt out over all tasks of a shuffle, by these columns if any: for few rows of which each makes many, that their size would leave to one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def cut(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back, which ends their lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
