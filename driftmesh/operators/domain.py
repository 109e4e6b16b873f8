"""Domains: boxes of ranks, their neighbours, ghosts, and islands along the axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.dense import dense_stats
from driftmesh.operators.grid import prefix_sum, previous, ranged


def rank_boxes(points: DataFrame) -> DataFrame:
    """Tight box of every rank of every run, free of rank skew."""
    s = dense_stats(points, "run_id", "rank_no", ("x", "y", "z"))
    return s.select(F.col("run_id").cast("int").alias("run_id"), F.col("rank_no").cast("int").alias("rank_no"), "n", *[F.col(f"{m}_{a}").alias(f"{n}_{a}") for a in "xyz" for m, n in (("min", "lo"), ("max", "hi"))])


def padded(boxes: DataFrame, widths: DataFrame) -> DataFrame:
    """Boxes grown by the run's ``width`` to all sides."""
    b = boxes.join(widths.select("run_id", "width"), "run_id")
    return b.select("run_id", "rank_no", *[(F.col(f"lo_{a}") - F.col("width")).alias(f"lo_{a}") for a in "xyz"], *[(F.col(f"hi_{a}") + F.col("width")).alias(f"hi_{a}") for a in "xyz"])


def neighbour_ranks(boxes: DataFrame, widths: DataFrame) -> DataFrame:
    """``run_id, rank_no, neighbour``: ranks whose tight box meets a rank's padded box, but itself.

    An equi-join on run and band of y; a band is as high as the run's highest
    padded box, so a box stands in two or three at most.
    """
    grown = padded(boxes, widths)
    height = grown.groupBy("run_id").agg(F.max(F.col("hi_y") - F.col("lo_y")).alias("height"))

    def banded(rows: DataFrame, lo: str, hi: str) -> DataFrame:
        band = lambda c: F.floor(F.when(F.col("height") > 0, F.col(c) / F.col("height")).otherwise(F.lit(0.0)))
        return rows.join(height, "run_id").withColumn("first", band(lo)).withColumn("band", F.explode(F.sequence("first", band(hi)))).drop("height")

    own = banded(grown, "lo_y", "hi_y").withColumnRenamed("first", "own_first")
    other = boxes.select("run_id", F.col("rank_no").alias("neighbour"), *[F.col(f"{s}_{a}").alias(f"o{s}_{a}") for a in "xyz" for s in ("lo", "hi")])
    meet = F.col("band") == F.greatest("own_first", "first")  # once a pair
    for a in "xyz":
        meet = meet & (F.col(f"olo_{a}") <= F.col(f"hi_{a}")) & (F.col(f"ohi_{a}") >= F.col(f"lo_{a}"))
    met = own.join(banded(other, "olo_y", "ohi_y"), ["run_id", "band"])
    return met.where(meet & (F.col("rank_no") != F.col("neighbour"))).select("run_id", "rank_no", "neighbour")


def ghosts(points: DataFrame, boxes: DataFrame, widths: DataFrame, bands: int = 16) -> DataFrame:
    """``run_id, dest_rank, id``: points inside the padded box of another rank.

    An equi-join on run and band of y; a band is ``bands`` widths high, a box
    stands in every band it reaches.
    """
    height = F.col("width") * bands
    reach = padded(boxes, widths).join(widths.select("run_id", "width"), "run_id")
    reach = reach.withColumn("band", F.explode(F.sequence(F.floor(F.col("lo_y") / height), F.floor(F.col("hi_y") / height)))).withColumnRenamed("rank_no", "dest_rank").drop("width")
    placed = points.join(widths.select("run_id", "width"), "run_id").withColumn("band", F.floor(F.col("y") / height))
    inside = F.lit(True)
    for a in "xyz":
        inside = inside & (F.col(a) >= F.col(f"lo_{a}")) & (F.col(a) <= F.col(f"hi_{a}"))
    met = placed.join(reach, ["run_id", "band"]).where(inside & ~F.col("rank_no").eqNullSafe(F.col("dest_rank")))
    return met.select("run_id", "dest_rank", "id")


def _in_bins(points: DataFrame, widths: DataFrame) -> DataFrame:
    p = points.join(widths.select("run_id", "width"), "run_id")
    return p.withColumns({f"bin_{a}": F.floor(F.col(a) / F.col("width")) for a in "xyz"})


def axis_islands(points: DataFrame, widths: DataFrame) -> DataFrame:
    """Bins of every axis with the island they belong to: a new island begins after a gap wider than ``width``.

    Two points of one bin are at most a width apart, so only the lowest and
    highest value of each occupied bin are ordered.  Result: run_id, axis,
    bin, island (from 0), lo, hi, n of the bin.
    """
    p = _in_bins(points, widths)
    axes = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(f"bin_{a}").alias("bin"), F.col(a).alias("v")) for k, a in enumerate("xyz")]))
    bins = p.select("run_id", "dim", "width", axes.alias("s")).where("s.axis < dim").groupBy("run_id", "width", "s.axis", "s.bin").agg(F.min("s.v").alias("lo"), F.max("s.v").alias("hi"), F.count("*").alias("n"))
    part = ["run_id", "axis"]
    cut = previous(ranged(bins, part, "bin"), part, "bin", "hi", "_hi")
    cut = cut.withColumn("new", F.coalesce((F.col("lo") - F.col("_hi") > F.col("width")).cast("long"), F.lit(0))).drop("_hi", "_piece", "width")
    return prefix_sum(cut, part, "bin", "new", "before").withColumn("island", F.col("before") + F.col("new")).drop("new", "before")


def islands(bins: DataFrame) -> DataFrame:
    """Extent and number of points of every island of an axis."""
    return bins.groupBy("run_id", "axis", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def occupied_boxes(points: DataFrame, bins: DataFrame, widths: DataFrame) -> DataFrame:
    """Products of axis islands that hold points: run_id, ix, iy, iz, n, and the points' bounds."""
    p = _in_bins(points, widths)
    for k, a in enumerate("xyz"):
        of_axis = bins.where(F.col("axis") == k).select("run_id", F.col("bin").alias(f"bin_{a}"), F.col("island").alias(f"i{a}"))
        p = p.join(of_axis, ["run_id", f"bin_{a}"], "left")
    p = p.withColumn("iz", F.coalesce("iz", F.lit(0)))
    return p.groupBy("run_id", "ix", "iy", "iz").agg(F.count("*").alias("n"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
