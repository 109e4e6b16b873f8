"""Distance self-joins: links, clusters, vulnerable pairs, what they make of a reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.components import every_point
from driftmesh.operators.sweep import friends, near_pairs

def reaching(points: DataFrame, reach: str = "link_len") -> DataFrame:
    """Points as the sweep takes them, with one of their columns as reach."""
    return points.select("run_id", "id", "x", "y", "z", F.col(reach).alias("reach"))


def links(points: DataFrame, reach: str = "link_len") -> DataFrame:
    """Friends: ``run_id, i, j, d2`` of pairs at most ``reach`` apart."""
    return near_pairs(reaching(points, reach))


def fof(points: DataFrame, reach: str = "link_len") -> DataFrame:
    """Friends-of-friends cluster of every linked point."""
    return friends(reaching(points, reach))


def clusters(points: DataFrame, reach: str = "link_len") -> DataFrame:
    """Friends-of-friends cluster of every point; a point without friends is its own."""
    return every_point(points, fof(points, reach))


def vulnerable_pairs(points: DataFrame, params: DataFrame) -> DataFrame:
    """Pairs whose link may flip if every coordinate moves by xi; sign 1 where they must stay apart.

    ``params``: run_id, dim, b, xi, one row a run.
    """
    slack = 2 * F.sqrt(F.col("dim").cast("double")) * F.col("xi")
    runs = params.select("run_id", "dim", "b", "xi", F.greatest(F.lit(0.0), F.col("b") - slack).alias("low"), (F.col("b") + slack).alias("high"))
    near = near_pairs(points.select("run_id", "id", "x", "y", "z").join(runs.select("run_id", F.col("high").alias("reach")), "run_id"))
    near = near.join(runs, "run_id").where(F.col("d2") > F.col("low") * F.col("low"))
    return near.select("run_id", "dim", "b", "xi", "i", "j", "d2", (F.col("d2") > F.col("b") * F.col("b")).cast("long").alias("sign"))


def editable_points(pairs: DataFrame) -> DataFrame:
    """Points of at least one vulnerable pair."""
    return pairs.select("run_id", F.explode(F.array("i", "j")).alias("id")).distinct()


def with_distance(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """``pairs`` with r2, their squared distance in ``points``, and the differences of the axes."""
    ends = lambda p: points.select("run_id", F.col("id").alias(p), *[F.col(a).alias(f"{p}_{a}") for a in "xyz"])
    both = pairs.join(ends("i"), ["run_id", "i"]).join(ends("j"), ["run_id", "j"])
    both = both.withColumns({f"d{a}": F.col(f"i_{a}") - F.col(f"j_{a}") for a in "xyz"})
    return both.withColumn("r2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).drop(*[f"{p}_{a}" for p in "ij" for a in "xyz"])


def link_confusion(measured: DataFrame) -> DataFrame:
    """Of pairs with r2: how many that must stay apart or together do so, per run. Positive means apart."""
    far, apart = F.col("r2") > F.col("b") * F.col("b"), F.col("sign") == 1
    return measured.groupBy("run_id").agg(
        F.count_if(apart & far).alias("tp"), F.count_if(~apart & ~far).alias("tn"), F.count_if(apart & ~far).alias("fp"), F.count_if(~apart & far).alias("fn")
    )
