"""Other tables as particles: two or three of their columns, scaled to 0..1000, as one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmesh.sources.tables import table

SIDE = 1000


def as_particles(rows: DataFrame, ident: Column, axes: list[Column], link_len: float) -> DataFrame:
    """``run_id, id, x, y, z, dim, link_len``; rows with a null are left out, an axis must have an extent."""
    named = "xyz"[: len(axes)]
    raw = rows.select(ident.cast("long").alias("id"), *[a.cast("double").alias(n) for n, a in zip(named, axes)]).dropna()
    ends = raw.agg(*[f(n).alias(f"{s}_{n}") for n in named for f, s in ((F.min, "lo"), (F.max, "hi"))]).first()
    unit = lambda n: (F.col(n) - F.lit(ends[f"lo_{n}"])) / (F.lit(ends[f"hi_{n}"]) - F.lit(ends[f"lo_{n}"])) * SIDE
    scaled = raw.select("id", *[unit(n).alias(n) for n in named])
    z = "z" if len(axes) == 3 else F.lit(0.0).alias("z")
    return scaled.select(F.lit(0).alias("run_id"), "id", "x", "y", z, F.lit(len(axes)).alias("dim"), F.lit(float(link_len)).alias("link_len"))


def orders2d(spark: SparkSession, sf_dir: str, link_len: float = 4.0) -> DataFrame:
    """Orders by total price and day."""
    return as_particles(table(spark, sf_dir, "orders"), F.col("o_orderkey"), [F.col("o_totalprice"), F.unix_date(F.to_date("o_orderdate"))], link_len)


def events2d(spark: SparkSession, sf_dir: str, link_len: float = 2.0) -> DataFrame:
    """Events by time and value."""
    return as_particles(table(spark, sf_dir, "events"), F.col("event_id"), [F.unix_micros(F.col("ts").cast("timestamp")), F.col("value")], link_len)


def emb3d(spark: SparkSession, sf_dir: str, link_len: float = 25.0) -> DataFrame:
    """Embeddings by their first three values."""
    return as_particles(table(spark, sf_dir, "embeddings"), F.col("vec_id"), [F.get("embedding", F.lit(k)) for k in range(3)], link_len)


def lineitem3d(spark: SparkSession, sf_dir: str, link_len: float = 2.371262) -> DataFrame:
    """Line items by price, day of shipping and part; the id is made of order, line and, where these repeat, the row's place among its like."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    like = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = rows.withColumn("ident", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 4096 + F.row_number().over(like))
    return as_particles(rows, F.col("ident"), [F.col("l_extendedprice"), F.unix_date(F.to_date("l_shipdate")), F.col("l_partkey")], link_len)
