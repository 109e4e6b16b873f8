"""Run parameters, the sparse cell grid, Morton codes and visiting order.

Every frame is keyed by ``run_id`` so that any number of runs is one job.
``points`` means run_id, id, x, y, z, dim, link_len with one finite row an id
and z = 0 in two dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmesh.scratch import Scratch

AXES = ("x", "y", "z")
#: Error bound as a share of the linking length, where none is given.
XI_SHARE = 0.05


def axis_ranges(points: DataFrame) -> DataFrame:
    """Number of points, and minimum, maximum and range of each axis, one row a run."""
    agg = [F.count("*").alias("n"), *[f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))]]
    return points.groupBy("run_id", "dim", "link_len").agg(*agg).select("*", *[(F.col(f"max_{a}") - F.col(f"min_{a}")).alias(f"range_{a}") for a in AXES])


def error_bound(xi: float, bound: str) -> Column:
    """xi as a share of the linking length (``link``), of the smallest range of a run's axes (``rel``), or as it is (``abs``)."""
    smallest = F.when(F.col("dim") == 3, F.least("range_x", "range_y", "range_z")).otherwise(F.least("range_x", "range_y"))
    return {"link": F.col("b") * xi, "rel": smallest * xi, "abs": F.lit(float(xi))}[bound]


def grid_params(points: DataFrame, xi: float | DataFrame = XI_SHARE, bound: str = "link", d: float | None = None) -> DataFrame:
    """Per run the linking length b, error bound xi, cell side g and cells per axis.

    b is the run's own linking length, or, with ``d``, that of its extent; for
    ``bound`` see :func:`error_bound`, or give a table of run_id, xi.  The side is ``b + 2 * sqrt(dim) * xi``,
    so that points of neighbouring cells at most are within reach after each
    coordinate moved by xi.
    """
    p = axis_ranges(points)
    p = p.withColumn("b", F.col("link_len")) if d is None else linking_length(p, d).withColumnRenamed("b_of_extent", "b")
    p = p.join(xi.select("run_id", "xi"), "run_id") if isinstance(xi, DataFrame) else p.withColumn("xi", error_bound(xi, bound))
    p = p.withColumn("g", F.col("b") + 2 * F.sqrt(F.col("dim").cast("double")) * F.col("xi"))
    return p.select("*", *[F.greatest(F.lit(1), F.ceil(F.col(f"range_{a}") / F.col("g"))).alias(f"cells_{a}") for a in AXES]).drop("link_len")


def saved_params(points: DataFrame, xi: float | DataFrame = XI_SHARE, bound: str = "link", d: float | None = None) -> DataFrame:
    """:func:`grid_params`, worked out once; a row a run, so Spark broadcasts it as long as it is small."""
    return Scratch(points.sparkSession, "params").save(grid_params(points, xi, bound, d), "params")


def linking_length(ranges: DataFrame, d: float = 0.2) -> DataFrame:
    """``b = d * (volume / n) ** (1 / dim)`` of every run's own extent."""
    area = F.col("range_x") * F.col("range_y")
    b = F.when(F.col("dim") == 2, F.sqrt(area / F.col("n"))).otherwise(F.cbrt(area * F.col("range_z") / F.col("n"))) * d
    return ranges.withColumn("b_of_extent", b)


def with_linking_length(points: DataFrame, d: float) -> DataFrame:
    """``points`` whose linking length is that of their run's extent."""
    lengths = linking_length(axis_ranges(points), d).select("run_id", F.col("b_of_extent").alias("link_len"))
    return points.drop("link_len").join(lengths, "run_id")


def coarsened(params: DataFrame, steps: int = 200) -> DataFrame:
    """Cell sides grown until a run has at most a cell for every four points.

    The first growth is the root of the excess; then 1 per cent a step.  A run
    that needs more than ``steps`` steps fails the job.
    """
    most = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    cells = lambda g: F.greatest(F.lit(1), F.ceil(F.col("range_x") / g)) * F.greatest(F.lit(1), F.ceil(F.col("range_y") / g)) * F.greatest(F.lit(1), F.ceil(F.col("range_z") / g))
    first = F.when(cells(F.col("g")) > most, F.col("g") * F.pow(cells(F.col("g")) / most, F.lit(1.0) / F.col("dim"))).otherwise(F.col("g"))
    tried = params.withColumn("first", first).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    side = F.col("first") * F.pow(F.lit(1.01), F.col("step"))
    fits = tried.groupBy("run_id").agg(F.min(F.when(cells(side) <= most, F.struct("step", side.alias("g")))).alias("m"))
    return fits.select("run_id", F.when(F.col("m").isNotNull(), F.col("m.g")).otherwise(F.raise_error(F.lit("a grid needs more steps to be coarse enough")).cast("double")).alias("g"))


def with_cells(points: DataFrame, params: DataFrame) -> DataFrame:
    """``points`` with b, xi, g, the cell's coordinates cx, cy, cz, its id and its lower corner ox, oy, oz.

    The largest coordinate of an axis falls into the last cell.
    """
    keep = ["run_id", "b", "xi", "g", *[f"{n}_{a}" for a in AXES for n in ("min", "cells")]]
    joined = points.join(params.select(keep), "run_id")
    cell = lambda a: F.least(F.greatest(F.floor((F.col(a) - F.col(f"min_{a}")) / F.col("g")), F.lit(0)), F.col(f"cells_{a}") - 1)
    placed = joined.withColumns({f"c{a}": cell(a) for a in AXES})
    placed = placed.withColumn("cell_id", cell_id(F.col("cx"), F.col("cy"), F.col("cz")))
    return placed.withColumns({f"o{a}": F.col(f"min_{a}") + F.col(f"c{a}") * F.col("g") for a in AXES})


def cell_id(cx: Column, cy: Column, cz: Column) -> Column:
    """Raster number of a cell."""
    return cz * F.col("cells_x") * F.col("cells_y") + cy * F.col("cells_x") + cx


def cell_coords(cells: DataFrame) -> DataFrame:
    """Cell coordinates, lower corner and centre from raster numbers; needs the run's parameters."""
    dx, dy = F.col("cells_x"), F.col("cells_y")
    c = cells.withColumn("cx", F.pmod("cell_id", dx)).withColumn("cy", F.pmod(F.floor(F.col("cell_id") / dx), dy)).withColumn("cz", F.floor(F.col("cell_id") / (dx * dy)))
    return c.select("*", *[(F.col(f"min_{a}") + F.col(f"c{a}") * F.col("g")).alias(f"corner_{a}") for a in AXES], *[(F.col(f"min_{a}") + (F.col(f"c{a}") + 0.5) * F.col("g")).alias(f"centre_{a}") for a in AXES])


def ranged(df: DataFrame, part: Sequence[str], order: str) -> DataFrame:
    """``df``, written once, with ``_piece``: consecutive pieces of about equal size in the order of ``part`` and ``order``."""
    cut = df.repartitionByRange(*part, order).withColumn("_piece", F.spark_partition_id())
    return Scratch(df.sparkSession, "ranged").save(cut, "pieces")


def prefix_sum(df: DataFrame, part: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` by ``order`` within ``part``, without a task for a whole part.

    Sums of pieces of the sorted rows are summed first, a row a piece; rows
    are ordered only within their piece.
    """
    return _summed(ranged(df, part, order), part, order, value, out).drop("_piece")


def _summed(cut: DataFrame, part: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    sums = cut.groupBy(*part, "_piece").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*part).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*part, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(sums, [*part, "_piece"]).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_before")


def previous(cut: DataFrame, part: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """The ``value`` of the row before in the order of the pieces of :func:`ranged`; null for the first of a part."""
    last = cut.groupBy(*part, "_piece").agg(F.max_by(value, order).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(*part).orderBy("_piece"))
    within = Window.partitionBy(*part, "_piece").orderBy(order)
    return cut.join(last.select(*part, "_piece", carried.alias("_carried")), [*part, "_piece"]).withColumn(out, F.coalesce(F.lag(value).over(within), "_carried")).drop("_carried")


def cell_gaps(cells: DataFrame) -> DataFrame:
    """``run_id, cell_id, gap``: empty cells in raster order before each occupied one."""
    cut = previous(ranged(cells, ["run_id"], "cell_id"), ["run_id"], "cell_id", "cell_id", "_prev")
    return cut.select("run_id", "cell_id", (F.col("cell_id") - F.coalesce("_prev", F.lit(-1)) - 1).alias("gap"))


def trailing_gaps(cells: DataFrame, params: DataFrame) -> DataFrame:
    """``run_id, gap``: empty cells behind each run's last occupied one."""
    last = cells.groupBy("run_id").agg(F.max("cell_id").alias("last")).join(params.select("run_id", "cells_x", "cells_y", "cells_z"), "run_id")
    return last.select("run_id", (F.col("cells_x") * F.col("cells_y") * F.col("cells_z") - 1 - F.col("last")).alias("gap"))


#: Fixed values of 30-bit Morton codes: factor and mask of each step.
MORTON = ((0x00010001, 0xFF0000FF), (0x101, 0x0F00F00F), (0x11, 0xC30C30C3), (5, 0x49249249))


def spread_bits(v: Column) -> Column:
    """The ten low bits of a number, each moved to three times its place."""
    for factor, mask in MORTON:
        v = (v * factor).bitwiseAND(F.lit(mask))  # the masks have 32 bits
    return v


def morton(cells: DataFrame) -> Column:
    """30-bit Morton code of a point's place within its cell, ten bits an axis."""
    ten = lambda a: F.least(F.lit(1023), F.greatest(F.lit(0), F.floor((F.col(a) - F.col(f"o{a}")) / F.col("g") * 1024)))
    z = F.when(F.col("dim") == 3, ten("z")).otherwise(F.lit(0))
    return F.shiftleft(spread_bits(z), 2).bitwiseOR(F.shiftleft(spread_bits(ten("y")), 1)).bitwiseOR(spread_bits(ten("x")))


def cell_starts(cells: DataFrame) -> DataFrame:
    """``run_id, cell_id, start``: points before each occupied cell in raster order."""
    counts = cells.groupBy("run_id", "cell_id").agg(F.count("*").alias("n"))
    return prefix_sum(counts, ["run_id"], "cell_id", "n", "start").select("run_id", "cell_id", "start")


def visit_order(cells: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``seq`` within the cell by Morton code and id, and ``visit_pos`` within the run by cell and seq."""
    coded = cells.withColumn("morton", morton(cells))
    inside = Window.partitionBy("run_id", "cell_id").orderBy("morton", "id")
    ranked = coded.withColumn("seq", (F.row_number().over(inside) - 1).cast("long"))
    starts = cell_starts(cells) if starts is None else starts
    return ranked.join(starts, ["run_id", "cell_id"]).withColumn("visit_pos", F.col("start") + F.col("seq")).drop("start")
