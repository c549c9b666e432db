"""Event streams: windows with a watermark, first deliveries, and running state. Every function takes a batch or a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def log_stream(spark: SparkSession, folder: str, schema: str = "run string, event string, step bigint, ce double, tokens bigint") -> DataFrame:
    """Lines that are appended to JSON logs of a folder, as files arrive."""
    return spark.readStream.schema(schema).json(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, total) by windows; rows later than ``late`` are dropped by a stream."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """(start, events) by overlapping windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, finish, events) of stretches without a gap."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "events")


def first_deliveries(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each event once; a stream forgets keys that the watermark has passed."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, events, total) after each batch of a stream: state of one row a user, kept between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, events bigint, total double", "events bigint, total double", "update", "NoTimeout")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Rows of ``left`` with the latest ``value`` of ``right`` at or before their time, null if there is none: one union and one window
    over each key, no range join."""
    from pyspark.sql import Window

    names = left.columns
    a = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*names, F.col("_last").alias(value))
