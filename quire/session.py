"""Session and table access shared by the registered queries."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "8", name: str = "quire") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(shared)


def bucketed(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """A table written to the shared folder in buckets of its keys. A join on them reads it as it lies and moves
    only the other side; the catalogue keeps no entry of it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    path, entry = f"{spark.sparkContext.getCheckpointDir()}/{name}", f"spark_catalog.default.{name}"
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # its files lie outside the warehouse and stay
    return out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One supplied table, kept columnar so that pruning and pushdown reach the scan."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
