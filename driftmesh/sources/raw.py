"""Raw binary coordinate files as a Spark data source.

``spark.read.format("raw_points")`` with the options ``path`` (one interleaved
file, or one file an axis, comma separated; ``%r`` stands for a rank),
``dim`` (1 to 3; 1 is a plain vector), ``dtype`` (``f32`` or ``f64``,
little-endian), ``n`` (points per file, optional; a file of another size is
refused), ``ranks`` (how many ranks ``%r`` counts, optional) and ``rows``
(points of an input partition).  Every partition reads its own byte range of
every file.  The writer gives each partition's points as one interleaved part
file, or, with ``layout=axes``, as one file an axis, named after the axis and
the type (``part-000000.xx.f32``, ``part-000000.yy.d64``).  Paths are those of
a file system that every executor has mounted; a store without file calls
(``hdfs://``, ``s3://``) is refused.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

DTYPES = {"f32": "<f4", "f64": "<f8"}
#: Endings of files of one axis.
SUFFIXES = {"f32": "f32", "f64": "d64"}
ROWS = 1_000_000


def local(path: str) -> str:
    """A path as file calls take it."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: raw files need a mounted file system")
    return path


class _Range(InputPartition):
    def __init__(self, files: list[str], rank: int, first: int, count: int):
        self.files, self.rank, self.first, self.count = files, rank, first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.dim, self.dtype = int(options.get("dim", 3)), np.dtype(DTYPES[options.get("dtype", "f64")])
        self.paths = [local(p.strip()) for p in options["path"].split(",")]
        if len(self.paths) not in (1, self.dim):
            raise ValueError("give one interleaved file or one file an axis")
        self.n = int(options["n"]) if "n" in options else None
        self.ranks, self.rows = int(options.get("ranks", 1)), int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for rank in range(self.ranks):
            named = [p.replace("%r", str(rank)) for p in self.paths]
            for files in self._parts(named):
                if len(files) not in (1, self.dim):
                    raise ValueError(f"{files}: one file an axis, or one for all")
                width = self.dtype.itemsize * (self.dim if len(files) == 1 else 1)
                sizes = {os.path.getsize(f) for f in files}
                if len(sizes) != 1 or (size := sizes.pop()) % width or (self.n is not None and size != self.n * width):
                    raise ValueError(f"{files}: the size does not fit {self.n if self.n is not None else 'whole'} points")
                for first in range(0, size // width, self.rows):
                    out.append(_Range(files, rank, first, min(self.rows, size // width - first)))
        return out or [_Range([], 0, 0, 0)]

    def _parts(self, named: list[str]) -> list[list[str]]:
        """The files that belong together: those named, or the part files of a folder."""
        if len(named) > 1 or not os.path.isdir(named[0]):
            return [named]
        parts: dict[str, list[str]] = {}
        for f in sorted(os.listdir(named[0])):
            if f.endswith(".bin") or f.rpartition(".")[2] in SUFFIXES.values():
                parts.setdefault(f.split(".")[0], []).append(os.path.join(named[0], f))
        return list(parts.values())

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        if len(part.files) == 1:
            flat = np.fromfile(part.files[0], self.dtype, part.count * self.dim, offset=part.first * self.dim * self.dtype.itemsize)
            axes = list(flat.reshape(-1, self.dim).T)
        else:
            axes = [np.fromfile(f, self.dtype, part.count, offset=part.first * self.dtype.itemsize) for f in part.files]
        cols = [pa.array(np.full(part.count, part.rank, np.int32)), pa.array(np.arange(part.first, part.first + part.count))]
        yield pa.RecordBatch.from_arrays([*cols, *[pa.array(a.astype(np.float64)) for a in axes]], names=["rank_no", "idx", *"xyz"[: self.dim]])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.dim, self.dtype = local(options["path"]), int(options.get("dim", 3)), np.dtype(DTYPES[options.get("dtype", "f64")])
        self.by_axis, self.suffix = options.get("layout") == "axes", SUFFIXES[options.get("dtype", "f64")]
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        stem = os.path.join(self.path, f"part-{context.partitionId():06d}")
        axes = "xyz"[: self.dim]
        finals = [f"{stem}.{a * 2}.{self.suffix}" for a in axes] if self.by_axis else [f"{stem}.bin"]
        attempts = [f"{f}.{context.taskAttemptId()}" for f in finals]
        files = [open(f, "wb") for f in attempts]
        try:
            for batch in batches:
                columns = [batch.column(a).to_numpy(zero_copy_only=False).astype(self.dtype) for a in axes]
                for f, data in zip(files, columns if self.by_axis else [np.stack(columns, 1)]):
                    f.write(data.tobytes())
        finally:
            for f in files:
                f.close()
        for attempt, final in zip(attempts, finals):
            os.replace(attempt, final)
        return WriterCommitMessage()


class RawPoints(DataSource):
    """Points in raw binary files; the folder must be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "raw_points"

    def schema(self) -> str:
        return "rank_no int, idx long, " + ", ".join(f"{a} double" for a in "xyz"[: int(self.options.get("dim", 3))])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``raw_points`` known to the session."""
    spark.dataSource.register(RawPoints)
