"""Files on any file system that tasks and driver share: local folders, HDFS, object stores; opened in pieces, never as a whole."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at once.
PIECE = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it) of a path or URI, also of one as Spark writes it (``file:/...``)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(path.removeprefix("file:")).replace("//", "/").replace("//", "/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def exists(path: str) -> bool:
    system, at = located(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def listed(folder: str, ending: str) -> list[str]:
    """Names of the files of a folder with an ending; none if there is no folder."""
    system, at = located(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(ending))


def read_json(path: str) -> dict:
    system, at = located(path)
    with system.open_input_stream(at) as f:
        return json.loads(f.read().decode("utf-8"))


def write_whole(path: str, content: bytes) -> None:
    """A file that is complete or not there at all: written beside under a name of its own, then moved."""
    system, at = located(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(content)
    system.move(part, at)


def sha256(path: str) -> str:
    """Checksum of a file of any size."""
    system, at = located(path)
    digest = hashlib.sha256()
    with system.open_input_stream(at) as f:
        while piece := f.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of a file or of all files below a folder, each read in pieces by one task. Names are relative to the folder."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sha256(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "sha256"])

    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # contents are not read for this
    _, at = located(path)
    name = F.regexp_replace(F.element_at(F.split("path", f"\\Q{at.rstrip('/')}/\\E", 2), -1), r"^.*/(?=[^/]+$)" if _is_file(path) else "^$", "")
    return paths.mapInArrow(digest, "path string, sha256 string").select(name.alias("file"), "sha256")


def _is_file(path: str) -> bool:
    system, at = located(path)
    return system.get_file_info(at).type == fs.FileType.File


def folder_digest(spark: SparkSession, path: str) -> str:
    """One checksum of a folder: that of its files' names and checksums in order. Marker files of writers do not count."""
    rows = checksums(spark, path).where(~F.element_at(F.split("file", "/"), -1).rlike("^[._]"))
    lines = rows.select(F.concat_ws(" ", "sha256", "file").alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("all"))
    return lines.select(F.sha2("all", 256)).first()[0]  # a line a file
