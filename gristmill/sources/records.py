"""Scans and sinks of records: JSON lines, text lines, Parquet, small reports, checksums."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.sources import files

RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "source", "license", "domain", "text", "group_id", "content_type")])


def scan_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType = RAW, keep_raw: bool = True) -> DataFrame:
    """Records of JSON-lines files with an ``ordinal`` (file, name, block, line) that follows the order of the paths as given, within a folder
    the names of its files, and in a file the lines.

    A file is read in blocks by several tasks; block is where its own begins, line counts from there. Blank lines are skipped; a line that is no
    JSON object fails the query, naming the file, the block and the line. With ``keep_raw`` the line stays in ``raw``, so that further
    fields survive.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for n, path in enumerate(paths):
        place = [F.lit(n).cast("int").alias("file"), F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
        parts.append(spark.read.text(path).select("value", *place).where(~F.col("value").rlike(r"(?U)^\s*$")))
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionAll(more)
    checked = lines.withColumn("value", F.when(F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("name"), F.lit(", block "), F.col("block"), F.lit(", line "), F.shiftrightunsigned(F.shiftleft("line", 31), 31)))
    ))
    read = checked.withColumn("r", F.from_json("value", schema)).select("r.*", F.struct("file", "name", "block", "line").alias("ordinal"), F.col("value").alias("raw"))
    return read if keep_raw else read.drop("raw")


def raw_records(documents: DataFrame) -> DataFrame:
    """The documents table as raw records: (id, source, license, domain, text, group_id, content_type, ordinal)."""
    return documents.select(
        F.col("record_id").alias("id"), "source", "license", "domain", "text", "group_id", "content_type", F.col("doc_id").alias("ordinal")
    )


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, with its line end."""
    return spark.read.text(path).select(F.concat("value", F.lit("\n")).alias("text"))


def write_splits(clean: DataFrame, path: str, format: str = "parquet") -> None:
    """Clean records in a folder a split, files being ranges of digests in order, so that no split lies on one task. An existing folder is
    refused."""
    clean.repartitionByRange("split", "content_sha256").sortWithinPartitions("split", "content_sha256").write.mode("errorifexists").partitionBy("split").format(format).save(path)


def write_rejects(tagged: DataFrame, path: str) -> None:
    """(id, reason) of rejected records as JSON lines."""
    tagged.where("reason is not null").select("id", "reason").write.mode("errorifexists").json(path)


def write_report(path: str, value: dict) -> None:
    """A small report, complete or not there at all; numbers must be finite."""
    files.write_whole(path, (json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode("utf-8"))


def write_predictions(scored: DataFrame, path: str) -> None:
    """Predictions of an evaluation (id, task, prediction and what else there is) as JSON lines; an existing folder is refused."""
    scored.write.mode("errorifexists").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows of a training log added to a folder of JSON lines, which ``streaming.events.log_stream`` follows."""
    rows.write.mode("append").json(path)


def inside(root: str, name: str) -> str:
    """Path of an artifact below ``root``; anything that leads outside is refused."""
    base = Path(root).resolve()
    path = (base / name).resolve()
    if base not in path.parents:
        raise ValueError(f"outside of {base}: {name}")
    return str(path)


def content_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, fingerprint): an order-free digest of a table, for inputs too large for one checksum."""
    return df.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).alias("fingerprint"))
