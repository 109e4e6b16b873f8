"""Readers for the engine's Parquet tables and the rules that clean their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INF = float("inf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(c: Column) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    return F.coalesce(F.abs(c) < F.lit(INF), F.lit(False))


def run_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, dim, link_len`` of runs whose parameters make sense, one row a run.

    Rows with a null id, a ``dim`` other than 2 or 3 or a ``link_len`` that is
    not positive and finite are no runs; of several rows the largest counts.
    """
    runs = table(spark, sf_dir, "runs")
    return (
        runs.where(F.col("run_id").isNotNull() & F.col("dim").isin(2, 3) & finite(F.col("link_len")) & (F.col("link_len") > 0))
        .groupBy("run_id")
        .agg(F.max(F.struct("dim", "link_len")).alias("p"))
        .select("run_id", "p.dim", "p.link_len")
    )


def last_arrived(df: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "arrived_at") -> DataFrame:
    """Of the rows with equal ``keys`` the one that arrived last.

    A null time is earlier than any other; of rows with equal times the one
    with the largest values counts, so the result does not depend on order.
    """
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(at, *values)).alias("last"))
        .select(*keys, *[F.col(f"last.{v}").alias(v) for v in values])
    )


def placed_points(points: DataFrame, runs: DataFrame, id_col: str, axes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The usable, last arrived row of every id, its unused third axis set to 0.

    A row is usable if its run exists, its id is not null and all ``dim``
    coordinates are finite.  Result: run_id, ``id_col``, x, y, z, dim, link_len
    and the columns of ``keep``.
    """
    x, y, z = (F.col(a) for a in axes)
    rows = points.select("run_id", id_col, *axes, *keep, "arrived_at").join(runs, "run_id")
    usable = rows.where(F.col(id_col).isNotNull() & finite(x) & finite(y) & ((F.col("dim") == 2) | finite(z))).withColumns(
        {"x": x + 0.0, "y": y + 0.0, "z": F.when(F.col("dim") == 3, z + 0.0).otherwise(F.lit(0.0))}
    )
    return last_arrived(usable, ["run_id", id_col, "dim", "link_len"], ["x", "y", "z", *keep])


def placed_nodes(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """The usable, last arrived row of every tree node: run_id, id, x, y, z, dim, link_len.

    Usable means: the run exists, the id is not null and ``point`` has exactly
    ``dim`` finite values.
    """
    p = F.col("point")
    rows = nodes.select("run_id", "id", "point", "arrived_at").join(runs, "run_id")
    ok = F.col("id").isNotNull() & (F.size(p) == F.col("dim"))
    get = [F.get(p, F.lit(k)) for k in range(3)]
    usable = rows.where(F.coalesce(ok, F.lit(False))).withColumns(
        {"x": get[0], "y": get[1], "z": F.when(F.col("dim") == 3, get[2]).otherwise(F.lit(0.0))}
    )
    usable = usable.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    return last_arrived(usable, ["run_id", "id", "dim", "link_len"], ["x", "y", "z"])
