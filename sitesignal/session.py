"""Session builder and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with ANSI SQL, UTC and adaptive execution; sized for local runs unless told otherwise."""
    builder = (
        SparkSession.builder.appName("sitesignal")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SITESIGNAL_DRIVER_MEMORY", "12g"))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the star-schema tables; Parquet pushdown and pruning stay with the reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one, on a local
    master only (tests): executors elsewhere could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        folder = f"file://{tempfile.mkdtemp(prefix='sitesignal-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sitesignal/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_own(spark)}/{tag}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Removes what the application has staged. Results that are still lazy read it: write them first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, and a lost executor costs no recompute."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
