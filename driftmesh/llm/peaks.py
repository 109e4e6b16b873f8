"""Clusters of mutually close records by density peaks.

Records are cut into blocks of at most ``BLOCK`` records of one grid cell, cell
side = radius, and consecutive blocks into groups.  A directory (a key and a
bounding box a block or group) says which blocks a group may have neighbours
in; each of these is sent to the group once, whatever the number of its blocks
that need it, and compared with them in small numpy distance matrices.  A
block that lies within the radius of a group altogether is only counted.  A
crowded cell is many blocks, spread over many tasks.

The first pass counts the records within the radius of each record, its
density.  The second finds for each record the nearest denser one and its
distance, delta.  Peaks are the records with a delta beyond the radius and a
density of at least ``min_size``; everyone else follows the pointers to denser
records, by pointer doubling, up to a peak.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.scratch import Scratch

#: Most records of a block; a pair of full blocks is a matrix of 65,536 distances.
BLOCK = 256
#: Sub-cells per axis by which a cell's records are ordered before they are cut into blocks.
SUB = 8
MAX_ROUNDS = 60
#: Records and blocks after which a group ends.
GROUP, GROUP_BLOCKS = 4096, 512
_BOX = ("x0", "x1", "y0", "y1", "z0", "z1")
_BLOCK_SCHEMA = "g int, b long, grp long, cx long, cy long, cz long, n int, r double, " + ", ".join(f"{c} double" for c in _BOX) + ", least long, most long, ids binary, xyz binary, dens binary"
_NAMES = [c.split()[0] for c in _BLOCK_SCHEMA.split(", ")]


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition sorted by g, cell and place in the cell."""
    from pyspark import TaskContext

    names = ["g", "cx", "cy", "cz", "id", "x", "y", "z", "dens", "r"]
    rest, group, own, last = None, TaskContext.get().partitionId() << 32, [0, 0], None

    def blocks(m: dict, upto: int, starts: np.ndarray) -> pa.RecordBatch:
        nonlocal group, last
        rows = []
        for a, b in zip(starts, [*starts[1:], upto]):
            for c in range(a, b, BLOCK):
                s = slice(c, min(b, c + BLOCK))
                order = np.argsort(m["id"][s])
                xyz = np.stack([m[k][s][order] for k in "xyz"])
                ids, dens = m["id"][s][order], m["dens"][s][order]
                if last is not None and (last != m["g"][a] or own[0] >= GROUP or own[1] >= GROUP_BLOCKS):
                    group, own[:] = group + 1, [0, 0]
                last = m["g"][a]
                own[0], own[1] = own[0] + len(ids), own[1] + 1
                box = np.stack([xyz.min(1), xyz.max(1)], 1).ravel()
                rows.append((m["g"][a], ids[0], group, m["cx"][a], m["cy"][a], m["cz"][a], len(ids), m["r"][a], *box, dens.min(), dens.max(), ids.tobytes(), xyz.tobytes(), dens.tobytes()))
        types = [pa.int32(), *[pa.int64()] * 5, pa.int32(), *[pa.float64()] * 7, *[pa.int64()] * 2, *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        m = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if rest is not None:
            m = {n: np.concatenate([rest[n], m[n]]) for n in names}
        key = np.stack([m[n] for n in ("g", "cx", "cy", "cz")])
        starts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1]
        upto = starts[-1]
        upto += (len(m["g"]) - upto) // BLOCK * BLOCK  # whole blocks of a crowded cell need not wait for its end
        if upto > 0:
            yield blocks(m, upto, starts[starts < upto])
        rest = {n: v[upto:] for n, v in m.items()}
    if rest is not None and len(rest["g"]):
        key = np.stack([rest[n] for n in ("g", "cx", "cy", "cz")])
        yield blocks(rest, len(rest["g"]), np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1])


#: Cells of a side of the tiles by which blocks are ordered, so that a group lies together.
TILE = 8


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes`` (g, id, x, y, z, r, dens)."""
    far = 1e15
    cell = lambda c: F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), F.col(c) / (F.col("r") * (1 + 1e-9)))))
    sub = lambda c: F.pmod(F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), F.col(c) / F.col("r") * SUB))), F.lit(SUB))
    placed = nodes.select("*", *[cell(c).alias(f"c{c}") for c in "xyz"], (sub("x") * SUB * SUB + sub("y") * SUB + sub("z")).alias("sub"))
    placed = placed.withColumns({f"t{c}": F.floor(F.col(f"c{c}") / TILE) for c in "xyz"})
    order = ["g", "tx", "ty", "tz", "cx", "cy", "cz", "sub", "id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, _BLOCK_SCHEMA)


def _met(blocks: DataFrame, denser: bool = False) -> DataFrame:
    """``g, grp, b, n, inside``: blocks in which a group may have records within the radius; ``inside``: all of them are.

    ``denser``: only blocks that may hold a record denser than one of the group.
    """
    square = lambda d: d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    extent = lambda p: [(F.min if c.endswith("0") else F.max)(c).alias(f"{p}{c}") for c in _BOX]
    tiled = blocks.select("g", "grp", "b", "n", "r", *_BOX, "least", "most", "cx", "cy", "cz", *[F.floor(F.col(f"c{c}") / TILE).alias(f"t{c}") for c in "xyz"])
    # what a group has in a tile, in every tile that it may reach from there
    parts = tiled.groupBy("g", "grp", "tx", "ty", "tz").agg(*extent("p"), *[f(f"c{c}").alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))])
    for c in "xyz":
        parts = parts.withColumn(f"t{c}", F.explode(F.sequence(F.floor((F.col(f"l{c}") - 1) / TILE), F.floor((F.col(f"h{c}") + 1) / TILE))))
    parts = parts.select("g", "grp", "tx", "ty", "tz", *[f"p{c}" for c in _BOX])
    met = parts.join(tiled.drop("grp", "least", "cx", "cy", "cz"), ["g", "tx", "ty", "tz"])
    gap = [F.greatest(F.lit(0.0), F.col(f"{a}0") - F.col(f"p{a}1"), F.col(f"p{a}0") - F.col(f"{a}1")) for a in "xyz"]
    met = met.where(square(gap) <= F.col("r") * F.col("r")).select("g", "grp", "b", "n", "r", *_BOX, "most").distinct()
    groups = tiled.groupBy("g", "grp").agg(*extent("g"), F.min("least").alias("gleast"))
    met = met.join(groups, ["g", "grp"])
    reach = [F.greatest(F.col(f"{a}1") - F.col(f"g{a}0"), F.col(f"g{a}1") - F.col(f"{a}0")) for a in "xyz"]
    if denser:
        met = met.where("most >= gleast")
    return met.select("g", "grp", "b", "n", (square(reach) <= F.col("r") * F.col("r")).alias("inside"))


def _delivered(blocks: DataFrame, met: DataFrame) -> DataFrame:
    """The blocks of every group (kind 0), then those it needs (kind 1), group by group."""
    content = blocks.select("g", "b", "r", *_BOX, "ids", "xyz", "dens")
    own = blocks.select(F.lit(0).alias("kind"), "grp", *content.columns)
    needed = met.select("g", "grp", "b").join(content, ["g", "b"]).select(F.lit(1).alias("kind"), "grp", *content.columns)
    return own.unionByName(needed).repartition("g", "grp").sortWithinPartitions("g", "grp", "kind")


def _groups(batches: Iterable[pa.RecordBatch], start, meet, end) -> Iterator[pa.RecordBatch]:
    """Runs over delivered rows: ``start`` makes a state of a group's records, ``meet`` compares some of them with a block, ``end`` gives rows."""
    key, own, state = None, [], None

    def whole() -> dict:
        boxes = np.array([[r[c] for c in _BOX] for r in own])
        parts = [np.frombuffer(r["xyz"]).reshape(3, -1) for r in own]
        m = {"g": own[0]["g"], "grp": own[0]["grp"], "r": own[0]["r"], "boxes": boxes, "ends": np.cumsum([0, *[p.shape[1] for p in parts]]), "xyz": np.concatenate(parts, 1)}
        m["ids"], m["dens"] = (np.concatenate([np.frombuffer(r[c], np.int64) for r in own]) for c in ("ids", "dens"))
        return m | start(m)

    for batch in batches:
        for row in batch.to_pylist():
            if (row["g"], row["grp"]) != key:
                if own:
                    yield end(state or whole())
                key, own, state = (row["g"], row["grp"]), [], None
            if row["kind"] == 0:
                own.append(row)
                continue
            state = state or whole()
            box = [row[c] for c in _BOX]
            gap = np.stack([np.maximum(0.0, np.maximum(box[2 * k] - state["boxes"][:, 2 * k + 1], state["boxes"][:, 2 * k] - box[2 * k + 1])) for k in range(3)])
            near = np.flatnonzero((gap * gap).sum(0) <= state["r"] ** 2)
            if not len(near):
                continue
            at = np.concatenate([np.arange(state["ends"][k], state["ends"][k + 1]) for k in near])
            ids, xyz, dens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["xyz"]).reshape(3, -1), np.frombuffer(row["dens"], np.int64)
            for a in range(0, len(at), GROUP):
                some = at[a : a + GROUP]
                d = state["xyz"][0][some][:, None] - xyz[0]
                d2 = d * d
                for axis in (1, 2):
                    d = state["xyz"][axis][some][:, None] - xyz[axis]
                    d2 += d * d
                meet(state, some, ids, dens, d2)
    if own:
        yield end(state or whole())


def _counts(same: bool):
    """Per record: how many delivered records are within the radius; ``same``: only those with its own value of dens."""

    def meet(m: dict, at: np.ndarray, ids: np.ndarray, dens: np.ndarray, d2: np.ndarray) -> None:
        near = d2 <= m["r"] ** 2
        if same:
            near &= m["dens"][at][:, None] == dens
        m["n"][at] += near.sum(1)

    def end(m: dict) -> pa.RecordBatch:
        size = len(m["ids"])
        cols = [np.full(size, m["g"], np.int32), np.full(size, m["grp"], np.int64), m["ids"], m["n"]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "grp", "id", "n"])

    return lambda batches: _groups(batches, lambda m: {"n": np.zeros(len(m["ids"]), np.int64)}, meet, end)


def _climb(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per record: the nearest denser one within the radius, if any, and its squared distance."""

    def meet(m: dict, at: np.ndarray, ids: np.ndarray, dens: np.ndarray, d2: np.ndarray) -> None:
        mine, names = m["dens"][at][:, None], m["ids"][at][:, None]
        d2[~((dens > mine) | ((dens == mine) & (ids < names))) | (d2 > m["r"] ** 2)] = np.inf
        best = d2.argmin(1)  # ids ascend, so the first of equal distances has the smallest id
        dist, up = d2[np.arange(len(at)), best], ids[best]
        better = (dist < m["d2"][at]) | ((dist == m["d2"][at]) & np.isfinite(dist) & (up < m["up"][at]))
        m["d2"][at[better]], m["up"][at[better]] = dist[better], up[better]

    def end(m: dict) -> pa.RecordBatch:
        none = ~np.isfinite(m["d2"])
        cols = [pa.array(np.full(len(m["ids"]), m["g"], np.int32)), pa.array(m["ids"]), pa.array(np.sqrt(m["d2"]), mask=none), pa.array(m["up"], mask=none)]
        return pa.RecordBatch.from_arrays(cols, names=["g", "id", "delta", "up"])

    return _groups(batches, lambda m: {"d2": np.full(len(m["ids"]), np.inf), "up": np.zeros(len(m["ids"]), np.int64)}, meet, end)


def mutual_counts(nodes: DataFrame, label: str) -> DataFrame:
    """``g, id, n``: for each of ``nodes`` (g, id, x, y, z, r and ``label``) the records with its label within its radius, itself included."""
    blocks = Scratch(nodes.sparkSession, "mutual").save(_blocks(nodes.select("g", "id", "x", "y", "z", "r", F.col(label).alias("dens"))), "blocks")
    return _delivered(blocks, _met(blocks)).mapInArrow(_counts(True), "g int, grp long, id long, n long").drop("grp")


def density_peaks(nodes: DataFrame, min_size: int = 12) -> DataFrame:
    """Every record with its density and its cluster, or none.

    ``nodes``: g int, id long, x, y, z double, r double (the radius, one value
    per g), one row per (g, id); rows with a null or NaN are no records, other
    columns are ignored.  Result: g,
    id, density (records within r, itself included), delta (the distance of
    the nearest denser record; null where it is beyond r) and up (that
    record), peak (where the pointers lead), cluster (the peak's id, or null
    where the peak has a density below ``min_size``: noise).  Of equally dense
    records the one with the smaller id counts as denser, of equally near ones
    the smaller id is followed.  Records at one place are neighbours at
    distance 0.  An empty table gives an empty result.
    """
    scratch = Scratch(nodes.sparkSession, "peaks")
    nodes = scratch.save(nodes.select(F.col("g").cast("int").alias("g"), "id", "x", "y", "z", "r").dropna(), "nodes")  # NaN counts as null
    blocks = scratch.save(_blocks(nodes.withColumn("dens", F.lit(0).cast("long"))), "blocks")
    met = scratch.save(_met(blocks), "met")
    counted = _delivered(blocks, met.where("not inside")).mapInArrow(_counts(False), "g int, grp long, id long, n long")
    inside = scratch.save(met.where("inside").groupBy("g", "grp").agg(F.sum("n").alias("more")), "inside")
    density = counted.join(inside, ["g", "grp"], "left").select("g", "id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("density"))
    density = scratch.save(density, "density")

    blocks = scratch.save(_blocks(nodes.join(density.select("g", "id", F.col("density").alias("dens")), ["g", "id"])), "denser")
    up = _delivered(blocks, _met(blocks, True)).mapInArrow(_climb, "g int, id long, delta double, up long")
    tree = scratch.save(density.join(up, ["g", "id"]).withColumn("peak", F.coalesce("up", "id")), "tree")
    scratch.drop("blocks", "met", "inside", "denser")

    # Pointer doubling; what has arrived at a peak is set aside, so no join meets a crowded key but the first.
    peaks = tree.where("up is null").select("g", F.col("id").alias("peak"), F.lit(True).alias("top"))
    open_ = tree.where("up is not null").select("g", "id", "peak").join(peaks, ["g", "peak"], "left")
    open_ = scratch.save(open_.select("g", "id", "peak", F.coalesce("top", F.lit(False)).alias("top")), "step0")
    done = open_.where("top").select("g", "id", "peak")
    moving = open_.where("not top").select("g", "id", "peak")
    for k in range(MAX_ROUNDS):
        if not moving.limit(1).count():
            break
        ahead = open_.select("g", F.col("id").alias("peak"), F.col("peak").alias("next"), "top")
        # every moving record's pointer is a record that is itself on its way or has arrived
        open_ = scratch.save(moving.join(ahead, ["g", "peak"]).select("g", "id", F.col("next").alias("peak"), "top").unionByName(done.select("g", "id", "peak", F.lit(True).alias("top"))), f"step{k + 1}")
        scratch.drop(f"step{k}")
        done, moving = open_.where("top").select("g", "id", "peak"), open_.where("not top").select("g", "id", "peak")
    else:
        if moving.limit(1).count():
            raise RuntimeError("the pointers did not arrive")
    ends = done.unionByName(tree.where("up is null").select("g", "id", "peak"))
    out = tree.drop("peak").join(ends, ["g", "id"])
    strong = tree.where("up is null").select("g", F.col("id").alias("peak"), (F.col("density") >= min_size).alias("strong"))
    strong = scratch.save(strong, "strong")  # a table of its own, so that a crowded cluster is split in the join
    out = out.join(strong, ["g", "peak"]).withColumn("cluster", F.when(F.col("strong"), F.col("peak")))
    return out.select("g", "id", "density", "delta", "up", "peak", "cluster")
