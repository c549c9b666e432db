"""Intermediate tables in the folder that all executors share.

A table written there cuts the lineage for good: it outlives the loss of any executor. The folder is the session's
``spark.checkpoint.dir``; only a session of one machine (``local[...]``) may fall back on a temporary folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session. Raises on a cluster that names none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="gristmill-")
        context.setCheckpointDir(_own[context.applicationId])
        atexit.register(_remove_local, _own[context.applicationId])
    return _own[context.applicationId]


def _remove_local(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


class Scratch:
    """Tables of one operator call under the shared folder, written once and read many times."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop_all)

    def keep(self, df: DataFrame, name: str = "t", compression: str | None = None) -> DataFrame:
        """Write ``df`` and return the reader of what was written."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.parquet(path, compression=compression)
        kept = self.spark.read.schema(schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, kept: DataFrame | None) -> None:
        """Delete a kept table that nothing reads any more."""
        path = getattr(kept, "_scratch_path", None)
        if path:
            self._delete(path)

    def drop_all(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
