"""A session for local work; on a cluster the caller brings a session of their own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "gristmill", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session in UTC with adaptive execution on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("GRISTMILL_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str):
    """One of the Parquet tables of a data folder; a table is a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df):
    """A scan with fewer partitions than there are cores, dealt out to all of them: that is a small input in few files, for which the
    shuffle is cheap and one busy core is not. Any larger scan stays as it is. Not for plans with a shuffle: to count their partitions
    would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
