"""Intermediate tables in the folder that all executors share.

Iterative jobs cut their lineage by writing a Parquet table and reading it
back.  The folder is the one the session names in ``spark.checkpoint.dir``;
only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Least seconds between two sweeps of the driver's garbage.
SWEEP_S = 5.0

_local_root: str | None = None
_swept = 0.0
_bases: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by every executor."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="driftmesh-")
        atexit.register(shutil.rmtree, _local_root, True)
    return f"file://{_local_root}"


class Scratch:
    """Named tables under one fresh folder of :func:`shared_root`."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _bases.append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as read back, free of lineage."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
        # shuffle files of a finished round go once its plans are garbage; a long loop must not wait for the driver to fill up
        global _swept
        if time.monotonic() - _swept > SWEEP_S:
            gc.collect()
            jvm.System.gc()
            _swept = time.monotonic()


def clear(spark: SparkSession) -> None:
    """Deletes every table this process wrote; results that were not written elsewhere can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _bases:
        path = jvm.org.apache.hadoop.fs.Path(_bases.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _clear_local() -> None:
    for base in _bases:
        if base.startswith(("/", "file:/")):
            shutil.rmtree("/" + base.removeprefix("file:").lstrip("/"), True)
