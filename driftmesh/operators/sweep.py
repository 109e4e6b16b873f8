"""Points near other points, the boxes that hold them, and friends of friends, by one sweep.

One axis ("latitude", y) is cut into bands as high as the reach; consecutive
bands are joined into strips of about ``target`` points.  A band that alone
has more is cut along the other axis ("longitude", x) into tiles of about
``target`` points.  A tile also receives the points just below it and, where
its band is cut, just left of it, so every close pair meets in the later of
its two points' tiles, which owns it.  Each tile is sorted by x and swept
once: the active set is what lies within the reach behind the sweep line, or
the boxes the line has entered and not left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.components import components, contracted
from driftmesh.operators.grid import prefix_sum
from driftmesh.scratch import Scratch

#: Points a tile is filled up to; a column as wide and high as the reach is never cut, so a tile may hold more.
TARGET = 20_000
#: Candidate pairs that are compared at once.
BLOCK_PAIRS = 2_000_000
#: Links a tile gathers before it contracts them.
LINKS = 500_000
#: Bands are this much higher than the reach, so that rounding never parts a pair by two bands.
_HEIGHT = 1.0 + 1e-9
#: Bands beyond this number (far off every other point) are one band.
_FAR = 1e15
#: Stretches of bands over which a box looks for its strips: at most so many a box.
STRETCHES = 256

_POINT = ("id", "x", "y", "z")


def _cell(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), v / (F.col("reach") * _HEIGHT))))


class _Tiles:
    """The tiles of some points (run_id, id, x, y, z, reach; no nulls), and who goes where."""

    def __init__(self, points: DataFrame, target: int):
        self.scratch = Scratch(points.sparkSession, "sweep")
        self.points = self.scratch.save(points.withColumns({"band": _cell(F.col("y")), "col": _cell(F.col("x"))}), "points")
        bands = self.points.groupBy("run_id", "band").agg(F.count("*").alias("n"), F.first("reach").alias("reach"))
        bands = prefix_sum(self.scratch.save(bands, "counts"), ["run_id"], "band", "n", "before")
        bands = bands.withColumn("strip", F.floor(F.col("before") / target))
        # a strip ends with the band that fills it, so only a strip's last band can be crowded: that one gets a strip of its own
        bands = bands.withColumn("crowded", F.col("n") > 2 * target).withColumn("strip", 2 * F.col("strip") + F.col("crowded").cast("long"))
        self.bands = self.scratch.save(bands.select("run_id", "band", "strip", "crowded", "reach"), "bands")
        crowded = self.bands.where("crowded").select("run_id", "band", "strip")
        columns = self.points.select("run_id", "band", "col").join(crowded, ["run_id", "band"]).groupBy("run_id", "band", "strip", "col").agg(F.count("*").alias("n"))
        columns = prefix_sum(columns, ["run_id", "strip", "band"], "col", "n", "before")
        self.columns = self.scratch.save(columns.select("run_id", "band", "strip", "col", F.floor(F.col("before") / target).alias("cut")), "columns")

    def placed(self) -> DataFrame:
        """Every point in the tile that owns it, and as a guest in the tiles above and to the right that it may have neighbours in."""
        keep = ["run_id", *_POINT, "reach"]
        plain = self.bands.where("not crowded").select("run_id", "band", "strip", F.lit(0).cast("long").alias("cut"))
        own = self.points.join(plain, ["run_id", "band"]).select(*keep, "strip", "cut", F.lit(False).alias("guest"))
        own = own.unionByName(self.points.join(self.columns, ["run_id", "band", "col"]).select(*keep, "strip", "cut", F.lit(False).alias("guest")))

        # bands whose upper neighbour is in another strip
        above = self.bands.select("run_id", (F.col("band") - 1).alias("band"), "strip", "crowded").join(self.bands.select("run_id", "band", F.col("strip").alias("lower")), ["run_id", "band"]).where("strip <> lower")
        to_plain = self.points.join(above.where("not crowded").select("run_id", "band", "strip", F.lit(0).cast("long").alias("cut")), ["run_id", "band"])
        near = self.columns.withColumn("col", F.explode(F.array(F.col("col") - 1, F.col("col"), F.col("col") + 1)))
        from_below = near.select("run_id", (F.col("band") - 1).alias("band"), "col", "strip", "cut")
        right = self.columns.select("run_id", "band", (F.col("col") - 1).alias("col"), "strip", "cut").join(self.columns.select("run_id", "band", "col", F.col("cut").alias("left")), ["run_id", "band", "col"]).where("cut <> left").drop("left")
        to_cut = self.points.join(from_below.unionByName(right).distinct(), ["run_id", "band", "col"])
        guests = to_plain.select(*keep, "strip", "cut").unionByName(to_cut.select(*keep, "strip", "cut")).withColumn("guest", F.lit(True))
        return own.unionByName(guests)

    def caught(self, boxes: DataFrame) -> DataFrame:
        """Boxes (run_id, box_id, lo_x, ...) in every tile they reach."""
        strips = self.bands.groupBy("run_id", "strip").agg(F.min("band").alias("b0"), F.max("band").alias("b1"), F.first("reach").alias("reach"))
        ends = strips.groupBy("run_id").agg(F.min("b0").alias("first"), F.max("b1").alias("last"), F.first("reach").alias("reach")).withColumn("stretch", F.floor((F.col("last") - F.col("first")) / STRETCHES) + 1)
        part = lambda band: F.floor((band - F.col("first")) / F.col("stretch"))
        strips = strips.join(ends.select("run_id", "first", "stretch"), "run_id").withColumn("p0", part(F.col("b0"))).withColumn("part", F.explode(F.sequence("p0", part(F.col("b1")))))
        placed = boxes.join(ends, "run_id").withColumn("c0", F.greatest(_cell(F.col("lo_y")), F.col("first"))).withColumn("c1", F.least(_cell(F.col("hi_y")), F.col("last"))).where("c0 <= c1")
        placed = placed.withColumn("q0", part(F.col("c0"))).withColumn("part", F.explode(F.sequence("q0", part(F.col("c1")))))
        met = placed.drop("reach").join(strips.select("run_id", "part", "strip", "p0", "b0", "b1", "reach"), ["run_id", "part"])
        met = met.where((F.col("c0") <= F.col("b1")) & (F.col("c1") >= F.col("b0")) & (F.col("part") == F.greatest("p0", "q0")))  # once a strip and box
        cuts = self.columns.groupBy("run_id", "strip", "cut").agg(F.min("col").alias("x0"), F.max("col").alias("x1"))
        met = met.join(cuts, ["run_id", "strip"], "left").where(F.col("cut").isNull() | ((_cell(F.col("lo_x")) <= F.col("x1")) & (_cell(F.col("hi_x")) >= F.col("x0"))))
        return met.withColumn("cut", F.coalesce("cut", F.lit(0)))


def _tiled(rows: DataFrame) -> DataFrame:
    return rows.repartition("run_id", "strip", "cut").sortWithinPartitions("run_id", "strip", "cut", "x", "kind")


def _point_rows(tiles: _Tiles) -> DataFrame:
    return tiles.placed().select("run_id", "strip", "cut", F.lit(1).alias("kind"), *_POINT, "guest", "reach")


def near_and_inside(points: DataFrame, boxes: DataFrame, target: int = TARGET) -> DataFrame:
    """Pairs of points within their run's linking length, and the boxes that contain each point.

    ``points``: run_id, id, x, y, z, link_len, every id once, z 0 where the
    third axis is not used.  ``boxes``: run_id, box_id, lo_x, hi_x, lo_y,
    hi_y, lo_z, hi_z with infinite bounds on an unused axis.  Result: rel
    (``near``: smaller id left; ``inside``: point left, box right), left_id,
    right_id.  Both bounds and the distance are inclusive.  Points with a null
    in any column and boxes with a null or NaN bound, or an upper bound below
    the lower one, take part in nothing; points at one place are near each
    other; empty tables give an empty result.
    """
    tiles = _Tiles(points.select("run_id", *_POINT, F.col("link_len").alias("reach")).dropna(), target)
    clean = boxes.select("run_id", "box_id", "lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z").dropna().where("lo_x <= hi_x and lo_y <= hi_y and lo_z <= hi_z and not isnan(hi_x) and not isnan(hi_y) and not isnan(hi_z)")
    ends = ("hi_x", "hi_y", "hi_z")
    placed = _point_rows(tiles).select("*", *[F.lit(0.0).alias(c) for c in ends])
    caught = tiles.caught(clean).select("run_id", "strip", "cut", F.lit(0).alias("kind"), F.col("box_id").alias("id"), *[F.col(f"lo_{a}").alias(a) for a in "xyz"], F.lit(True).alias("guest"), "reach", *ends)
    return _tiled(placed.unionByName(caught)).mapInArrow(_near_and_inside, "rel string, left_id long, right_id long")


def near_pairs(points: DataFrame, target: int = TARGET) -> DataFrame:
    """``run_id, i, j, d2``: pairs i < j of points (run_id, id, x, y, z, reach) at most ``reach`` apart; nulls as above."""
    rows = _tiled(_point_rows(_Tiles(points.select("run_id", *_POINT, "reach").dropna(), target)))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, stretches in _swept(batches):
            for m, i, j, d2 in stretches:
                u, v = m["id"][i], m["id"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), key[0], np.int32)), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d2)], names=["run_id", "i", "j", "d2"])

    return rows.mapInArrow(pairs, "run_id int, i long, j long, d2 double")


def friends(points: DataFrame, target: int = TARGET) -> DataFrame:
    """``run_id, id, cluster_id`` of every point that has a friend: friends of friends are one cluster, named by its smallest id.

    ``points``: run_id, id, x, y, z, reach; nulls as above.  Each tile
    contracts its links as it finds them, so no table of links is ever
    written; clusters that several tiles share are joined through the points
    that tiles have in common, which are few.
    """
    rows = _tiled(_point_rows(_Tiles(points.select("run_id", *_POINT, "reach").dropna(), target)))

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, stretches in _swept(batches):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            guests = [np.zeros(0, np.int64)]
            size = 0
            for m, i, j, _ in stretches:
                held.append((m["id"][i], m["id"][j]))
                guests += [np.unique(m["id"][k[m["guest"][k]]]) for k in (i, j)]
                size += len(i)
                if size > LINKS:
                    held = [contracted(*(np.concatenate(c) for c in zip(*held)))]
                    size = len(held[0][0])
            if not size:
                continue
            ids, roots = contracted(*(np.concatenate(c) for c in zip(*held)))
            tops = np.unique(roots)
            ids, roots = np.concatenate([ids, tops]), np.concatenate([roots, tops])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key[0], np.int32)), pa.array(ids), pa.array(roots), pa.array(np.isin(ids, np.concatenate(guests)))], names=["run_id", "id", "root", "guest"])

    scratch = Scratch(points.sparkSession, "friends")
    found = scratch.save(rows.mapInArrow(stars, "run_id int, id long, root long, guest boolean"), "stars")
    seam = scratch.save(found.where("guest").select("run_id", "id").distinct(), "seam")
    shared = found.join(seam, ["run_id", "id"], "left_semi").select("run_id", F.col("id").alias("i"), F.col("root").alias("j"))
    labels = components(shared).withColumnRenamed("cluster_id", "label")
    name = F.coalesce("label", "old").alias("cluster_id")
    inner = found.join(seam, ["run_id", "id"], "left_anti").withColumnRenamed("root", "old")
    inner = inner.join(labels.withColumnRenamed("id", "old"), ["run_id", "old"], "left").select("run_id", "id", name)
    # a shared point that is the smallest of all its tiles' clusters has no link to itself and keeps its own id
    outer = seam.withColumn("old", F.col("id")).join(labels, ["run_id", "id"], "left").select("run_id", "id", name)
    return inner.unionByName(outer)


Stretch = tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Stretches of rows of one tile."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        keys = np.stack([col["run_id"], col["strip"], col["cut"]], 1)
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            yield tuple(keys[a].tolist()), {n: c[a:b] for n, c in col.items()}


def _swept(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[Stretch]]]:
    """Every tile with its points at hand and close pairs among them, as :func:`_pairs_of` gives them; tiles follow each other."""
    parts = _keyed(batches)
    ahead = next(parts, None)
    while ahead is not None:
        key = ahead[0]

        def one(key=key) -> Iterator[Stretch]:
            nonlocal ahead
            active = None
            while ahead is not None and ahead[0] == key:
                merged, old, active = _moved_on(active, ahead[1])
                for pairs in _pairs_of(merged, old, float(ahead[1]["reach"][0])):
                    yield merged, *pairs
                ahead = next(parts, None)

        tile = one()
        yield key, tile
        for _ in tile:  # what the caller left over
            pass


def _moved_on(active: dict | None, part: dict) -> tuple[dict, int, dict]:
    """The active points with a new stretch, how many of them are old, and those still active behind it."""
    now = {n: part[n] for n in (*_POINT, "guest")}
    old = 0 if active is None else len(active["id"])
    merged = now if active is None else {n: np.concatenate([active[n], now[n]]) for n in now}
    keep = merged["x"] >= part["x"][-1] - part["reach"][0] * _HEIGHT
    return merged, old, {n: c[keep] for n, c in merged.items()}


def _near_and_inside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep the tiles of one task; only the active sets stay in memory."""
    tile, active, boxes = None, None, None
    for key, part in _keyed(batches):
        if key != tile:
            tile, active, boxes = key, None, None
        is_box = part["kind"] == 0
        p = {n: c[~is_box] for n, c in part.items()}
        new = {n: part[n][is_box] for n in (*_POINT, "hi_x", "hi_y", "hi_z")}
        boxes = new if boxes is None else {n: np.concatenate([boxes[n], new[n]]) for n in new}
        if not len(p["id"]):
            continue
        yield from _inside(p, boxes)
        stay = boxes["hi_x"] >= p["x"][-1]
        boxes = {n: c[stay] for n, c in boxes.items()}
        merged, old, active = _moved_on(active, p)
        for i, j, _ in _pairs_of(merged, old, float(p["reach"][0])):
            u, v = merged["id"][i], merged["id"][j]
            yield _rows("near", np.minimum(u, v), np.maximum(u, v))


def _rows(rel: str, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([rel]).take(pa.array(np.zeros(len(left), np.int32))), pa.array(left), pa.array(right)], names=["rel", "left_id", "right_id"])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for every number in [lo, hi) of each row."""
    n = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose sizes add up to about BLOCK_PAIRS."""
    group = np.cumsum(sizes) // BLOCK_PAIRS
    cuts = np.flatnonzero(np.diff(group)) + 1
    return zip([0, *cuts], [*cuts, len(sizes)])


def _inside(p: dict, boxes: dict) -> Iterator[pa.RecordBatch]:
    """Own points of a stretch in the active boxes: a run of x for each box, then the other axes."""
    mine = np.flatnonzero(~p["guest"])
    if not len(boxes["id"]) or not len(mine):
        return
    x, y, z = (p[a][mine] for a in "xyz")
    lo, hi = np.searchsorted(x, boxes["x"], "left"), np.searchsorted(x, boxes["hi_x"], "right")
    for a, b in _blocks(np.maximum(hi - lo, 0)):
        box, k = _ranges(lo[a:b], hi[a:b])
        box += a
        ok = (y[k] >= boxes["y"][box]) & (y[k] <= boxes["hi_y"][box]) & (z[k] >= boxes["z"][box]) & (z[k] <= boxes["hi_z"][box])
        if ok.any():
            yield _rows("inside", p["id"][mine][k[ok]], boxes["id"][box[ok]])


def _pairs_of(m: dict, old: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j and squared distance of pairs of which the later point, in order of x, is new; a pair of two guests belongs to another tile."""
    x, y, z = m["x"], m["y"], m["z"]
    later = np.arange(old, len(x))
    first = np.searchsorted(x, x[old:] - reach * _HEIGHT, "left")
    for a, b in _blocks(later - first):
        i, j = _ranges(first[a:b], later[a:b])
        i = later[a:b][i]
        dx, dy, dz = x[i] - x[j], y[i] - y[j], z[i] - z[j]
        d2 = dx * dx + dy * dy + dz * dz
        ok = (d2 <= reach * reach) & ~(m["guest"][i] & m["guest"][j])
        if ok.any():
            yield i[ok], j[ok], d2[ok]
