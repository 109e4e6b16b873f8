"""Particles that arrive in files: running rank statistics by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.sources.tables import finite


def arrivals(spark: SparkSession, place: str, schema) -> DataFrame:
    """A stream of particle rows from the Parquet files that appear in the folder ``place``, or from one file."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    stream = spark.readStream.schema(schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return stream.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return stream.parquet(place)


def windowed_counts(rows: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Usable rows per run and window of arrival; rows later than ``late`` are not waited for."""
    at = rows.where(F.col("run_id").isNotNull() & finite(F.col("x")) & finite(F.col("y"))).withColumn("at", F.col("arrived_at").cast("timestamp")).withWatermark("at", late)
    return at.groupBy("run_id", F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x")).select("run_id", F.col("w.start").alias("start"), "n", "min_x", "max_x")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Works off what is there; every changed window is appended to the Parquet files under ``out`` with the number of its batch.

    Only windows that changed leave a batch, so the state of windows behind
    the watermark is dropped.
    """
    keep = lambda changed, batch: changed.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)
    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(rows: DataFrame) -> DataFrame:
    """The last state of every run and window of what :func:`run_once` left; a batch that was run again leaves equal rows."""
    values = [c for c in rows.columns if c not in ("run_id", "start", "batch")]
    return rows.groupBy("run_id", "start").agg(F.max(F.struct("batch", *values)).alias("last")).select("run_id", "start", *[f"last.{c}" for c in values])
