"""Error-bounded quantisation of coordinates, its inverse, and the entropy stage."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmesh.operators.grid import cell_starts, morton, visit_order

#: Neutral quantisation code; codes are the open interval (0, 2 * MIDDLE).
MIDDLE = 32768
#: Points a packed block holds.
BLOCK_POINTS = 8192
#: Distinct symbols of a code table; more cannot occur with 16-bit codes and their two markers.
MAX_SYMBOLS = 65_537


def axes_of(dim: int) -> str:
    return "xyz"[:dim]


def quantised(visits: DataFrame) -> DataFrame:
    """Code, outlier flag and reconstruction of every axis, along the visiting order of each cell.

    The predictor is the previous reconstruction, at first the cell's corner.
    While no code overflows this has a closed form: with ``k`` the rounded
    number of steps of 2 xi from the corner, a code is the difference of
    consecutive ``k`` and the reconstruction is ``corner + 2 xi k``.  Codes
    can overflow only if a cell is wider than about 65,530 xi; those are for
    :func:`followed`.
    """
    order = Window.partitionBy("run_id", "cell_id").orderBy("seq")
    out = visits
    for a in "xyz":
        used = F.lit(True) if a != "z" else F.col("dim") == 3
        steps = F.round((F.col(a) - F.col(f"o{a}")) / (2 * F.col("xi"))).cast("long")
        out = out.withColumn(f"k{a}", steps)
        code = F.col(f"k{a}") - F.coalesce(F.lag(f"k{a}").over(order), F.lit(0)) + MIDDLE
        out = out.withColumn(f"code_{a}", F.when(used, code)).withColumn(f"recon_{a}", F.when(used, F.col(f"o{a}") + 2 * F.col("xi") * F.col(f"k{a}")).otherwise(F.lit(0.0)))
        out = out.withColumn(f"outlier_{a}", F.when(used, ((F.col(f"code_{a}") <= 0) | (F.col(f"code_{a}") >= 2 * MIDDLE)).cast("long")))
    return out.drop("kx", "ky", "kz")


def wide(g: Column, xi: Column) -> Column:
    """True where a cell is so wide that a code may leave its range."""
    return (g + xi) / (2 * xi) + 0.5 >= MIDDLE


def coded(cells: DataFrame) -> DataFrame:
    """Codes, outliers and reconstruction of all points along each cell's visiting order.

    ``cells``: points with their cells and, if runs differ in their order, a
    column ``mode`` (``kd`` or ``morton``, by default the latter).  Result:
    run_id, id, x, y, z, dim, b, xi, cell_id, seq, visit_pos, ox, oy, oz (where
    the first prediction starts: the cell's corner, or its centre in mode
    ``kd``) and per axis code, outlier and recon.  Where no code can overflow
    the closed form is used; wide cells, and cells in mode ``kd``, follow the
    recurrence, cell by cell, with exact values (outliers, code null) where a
    code overflows.
    """
    mode = F.col("mode") if "mode" in cells.columns else F.lit("morton")
    placed = cells.withColumn("mode", F.coalesce(mode, F.lit("morton"))).withColumn("slow", (F.col("mode") == "kd") | wide(F.col("g"), F.col("xi")))
    starts = cell_starts(cells)
    keep = ["run_id", "id", "x", "y", "z", "dim", "b", "xi", "cell_id", "seq", "visit_pos", "ox", "oy", "oz", *[f"{c}_{a}" for a in "xyz" for c in ("code", "outlier", "recon")]]
    plain = quantised(visit_order(placed.where("not slow"), starts)).select(keep)
    slow = followed(placed.where("slow")).join(starts, ["run_id", "cell_id"]).withColumn("visit_pos", F.col("start") + F.col("seq"))
    return plain.unionByName(slow.select(keep))


def _steps(v: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(v) + 0.5), v)


def chained(values: np.ndarray, start: float, xi: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, outlier flags and reconstruction of one axis along a cell.

    Between two outliers the chain has a closed form from the value it starts
    at, so it is worked out in stretches that end at the next outlier.
    """
    n = len(values)
    codes, out, recon = np.zeros(n, np.int64), np.zeros(n, bool), np.empty(n)
    at, base, before, size = 0, start, 0.0, n
    while at < n:
        stop = min(n, at + size)
        k = _steps((values[at:stop] - base) / (2 * xi))
        step = np.diff(k, prepend=before)
        over = np.flatnonzero(~(np.abs(step) < MIDDLE))
        upto = at + (int(over[0]) if len(over) else stop - at)
        codes[at:upto] = step[: upto - at] + MIDDLE
        recon[at:upto] = base + 2 * xi * k[: upto - at]
        if len(over):
            out[upto], recon[upto], base, before, size = True, values[upto], values[upto], 0.0, 64
            at = upto + 1
        else:
            before, at, size = k[-1], upto, 2 * size
    return codes, out, recon


#: Points of a cell beyond which the next point is looked for through a grid.
GRID_FROM = 512


def walked(points: np.ndarray, start: np.ndarray, xi: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, codes, outlier flags and reconstruction of a cell in which each next point is the unvisited one nearest to the last reconstruction.

    Of equally near points the first one counts.
    """
    n, dim = points.shape
    order, codes, out, recon = np.empty(n, np.int64), np.zeros((n, dim), np.int64), np.zeros((n, dim), bool), np.empty((n, dim))
    near = _Nearest(points)
    last = start.astype(float)
    for t in range(n):
        k = near.take(last)
        steps = _steps((points[k] - last) / (2 * xi))
        fits = np.abs(steps) < MIDDLE
        last = np.where(fits, last + np.where(fits, steps, 0) * 2 * xi, points[k])
        order[t], codes[t], out[t], recon[t] = k, np.where(fits, steps + MIDDLE, 0), ~fits, last
    return order, codes, out, recon


class _Nearest:
    """The unvisited point nearest to a place, over a grid with a few points a cell if there are many."""

    def __init__(self, points: np.ndarray):
        self.points, self.left = points, np.ones(len(points), bool)
        self.cells: dict[tuple, list[int]] | None = None
        if len(points) > GRID_FROM:
            dim = points.shape[1]
            self.low, extent = points.min(0), points.max(0) - points.min(0)
            self.many = max(1, int((len(points) / 4) ** (1 / dim)))
            self.side = np.where(extent > 0, extent / self.many, 1.0)
            self.cells = {}
            for k, c in enumerate(map(tuple, np.minimum(((points - self.low) / self.side).astype(int), self.many - 1).tolist())):
                self.cells.setdefault(c, []).append(k)

    def take(self, place: np.ndarray) -> int:
        k = self._plain(place) if self.cells is None else self._by_rings(place)
        self.left[k] = False
        return k

    def _plain(self, place: np.ndarray) -> int:
        return int(np.where(self.left, ((self.points - place) ** 2).sum(1), np.inf).argmin())

    def _by_rings(self, place: np.ndarray) -> int:
        mid = np.clip(((place - self.low) / self.side).astype(int), 0, self.many - 1)
        best, ring = (np.inf, -1), 0
        while ring <= self.many:
            for c in self._ring(mid, ring):
                own = self.cells.get(c)
                if not own:
                    continue
                own[:] = [k for k in own if self.left[k]]
                for k in own:
                    gap = self.points[k] - place
                    best = min(best, (float((gap * gap).sum()), k))
            # what lies beyond the ring is at least this far off
            beyond = min((place[a] - self.low[a] - (mid[a] - ring) * self.side[a] if mid[a] > ring else np.inf, self.low[a] + (mid[a] + ring + 1) * self.side[a] - place[a] if mid[a] + ring + 1 < self.many else np.inf)[s] for a in range(len(mid)) for s in (0, 1))
            if beyond == np.inf or (beyond > 0 and best[0] < beyond * beyond * (1 - 1e-12)):
                break
            ring += 1
        return best[1]

    def _ring(self, mid: np.ndarray, ring: int) -> Iterator[tuple]:
        spans = [range(max(0, m - ring), min(self.many, m + ring + 1)) for m in mid.tolist()]
        for c in product(*spans):
            if max(abs(v - m) for v, m in zip(c, mid.tolist())) == ring:
                yield c


def followed(cells: DataFrame) -> DataFrame:
    """The recurrence of :func:`coded` for cells of any width and mode; cells stream by in order."""
    keep = ["run_id", "id", "x", "y", "z", "dim", "b", "xi", "cell_id"]
    columns = [*keep, "ox", "oy", "oz", "g", "mode"]
    schema = "run_id int, id long, x double, y double, z double, dim int, b double, xi double, cell_id long, ox double, oy double, oz double, seq long, " + ", ".join(f"code_{a} long, outlier_{a} long, recon_{a} double" for a in "xyz")

    def block(m: dict[str, np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
        """Whole cells, beginning at ``cuts``."""
        n = len(m["id"])
        points, kd = np.stack([m[a] for a in "xyz"], 1), m["mode"] == "kd"
        flat = m["dim"] == 2
        start = np.stack([m[f"o{a}"] for a in "xyz"], 1) + np.where(kd, 0.5 * m["g"], 0.0)[:, None]
        start[flat, 2] = 0.0
        xi = m["xi"]
        # a first point is coded alike everywhere; only cells with more points need the chain
        steps = _steps((points - start) / (2 * xi[:, None]))
        out = ~(np.abs(steps) < MIDDLE)
        codes = np.where(out, 0, steps).astype(np.int64) + MIDDLE
        recon = np.where(out, points, start + np.where(out, 0, steps) * 2 * xi[:, None])
        order, seq = np.arange(n), np.zeros(n, np.int64)
        ends = np.append(cuts[1:], n)
        for a, b in zip(cuts[ends - cuts > 1].tolist(), ends[ends - cuts > 1].tolist()):
            dim = int(m["dim"][a])
            if kd[a]:
                way, codes[a:b, :dim], out[a:b, :dim], recon[a:b, :dim] = walked(points[a:b, :dim], start[a, :dim], xi[a])
                order[a:b] = a + way
            else:
                for k in range(dim):
                    codes[a:b, k], out[a:b, k], recon[a:b, k] = chained(points[a:b, k], start[a, k], xi[a])
            seq[a:b] = np.arange(b - a)
        cols = [pa.array(m[c][order]) for c in keep] + [pa.array(np.ascontiguousarray(start[:, k])) for k in range(3)] + [pa.array(seq)]
        for k in range(3):
            unused = flat if k == 2 else np.zeros(n, bool)
            cols += [pa.array(codes[:, k], mask=unused | out[:, k]), pa.array(out[:, k].astype(np.int64), mask=unused), pa.array(np.where(unused, 0.0, recon[:, k]))]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            m = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            m = m if rest is None else {c: np.concatenate([rest[c], m[c]]) for c in columns}
            cuts = np.flatnonzero((m["cell_id"][1:] != m["cell_id"][:-1]) | (m["run_id"][1:] != m["run_id"][:-1])) + 1
            if len(cuts):
                yield block({c: v[: cuts[-1]] for c, v in m.items()}, np.append(0, cuts[:-1]))
                m = {c: v[cuts[-1] :] for c, v in m.items()}
            rest = m
        if rest is not None and len(rest["id"]):
            yield block(rest, np.array([0]))

    ordered = cells.withColumn("_order", F.when(F.col("mode") == "kd", F.lit(0)).otherwise(morton(cells)))
    streams = ordered.select(*columns, "_order").repartition("run_id", "cell_id").sortWithinPartitions("run_id", "cell_id", "_order", "id")
    return streams.drop("_order").mapInArrow(run, schema)


def decoded(codes: DataFrame) -> DataFrame:
    """Reconstruction from codes and exact values (run_id, cell_id, seq, id, dim, xi, ox.., code_x.., and exact_x.. where there are outliers).

    Codes are summed along each cell, anew from every exact value.
    """
    along = Window.partitionBy("run_id", "cell_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = codes
    for a in "xyz":
        used = F.lit(True) if a != "z" else F.col("dim") == 3
        exact = F.col(f"exact_{a}") if f"exact_{a}" in codes.columns else F.lit(None).cast("double")
        out = out.withColumn("_exact", exact).withColumn("_sum", F.sum(F.when(F.col("_exact").isNull(), F.col(f"code_{a}") - MIDDLE).otherwise(F.lit(0))).over(along))
        since = F.col("_sum") - F.coalesce(F.last(F.when(F.col("_exact").isNotNull(), F.col("_sum")), True).over(along), F.lit(0))
        base = F.coalesce(F.last("_exact", True).over(along), F.col(f"o{a}"))
        out = out.withColumn(f"recon_{a}", F.when(used, base + 2 * F.col("xi") * since).otherwise(F.lit(0.0))).drop("_exact", "_sum")
    return out


def code_rows(quantised_points: DataFrame) -> DataFrame:
    """One row a code: run_id, pos (place in the run's stream, axes of a point together), code."""
    arr = F.array(*[F.struct(F.lit(k).alias("axis"), F.col(f"code_{a}").alias("code")) for k, a in enumerate("xyz")])
    rows = quantised_points.select("run_id", "dim", "visit_pos", F.explode(arr).alias("c")).where("c.code is not null")
    return rows.select("run_id", (F.col("visit_pos") * F.col("dim") + F.col("c.axis")).alias("pos"), "c.code")


def symbol_counts(codes: DataFrame) -> DataFrame:
    """How often each code occurs."""
    return codes.groupBy(F.col("code").alias("symbol")).agg(F.count("*").alias("freq"))


def huffman_table(freqs: Sequence[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length): the two lightest trees are joined, ties by age, leaves by ascending symbol; first is 0."""
    symbols = sorted(freqs)
    if len(symbols) == 1:
        return {symbols[0][0]: (0, 1)}
    heap = [(f, k) for k, (_, f) in enumerate(symbols)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    number = len(symbols)
    while len(heap) > 1:
        (fa, a), (fb, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[number] = (a, b)
        heapq.heappush(heap, (fa + fb, number))
        number += 1
    table, open_ = {}, [(number - 1, 0, 0)] if symbols else []
    while open_:
        node, code, length = open_.pop()
        if node < len(symbols):
            table[symbols[node][0]] = (code, length)
        else:
            a, b = children[node]
            open_ += [(a, code << 1, length + 1), (b, code << 1 | 1, length + 1)]
    return table


def code_table(counts: DataFrame) -> dict[int, tuple[int, int]]:
    """Huffman table of the counted symbols; only this table, of at most MAX_SYMBOLS rows, meets the driver."""
    rows = counts.limit(MAX_SYMBOLS + 1).collect()
    if len(rows) > MAX_SYMBOLS:
        raise ValueError("more symbols than 16-bit codes have")
    return huffman_table([(r.symbol, r.freq) for r in rows])


Table = dict[int, tuple[int, int]]


def packed(symbols: np.ndarray, table: Table) -> tuple[bytes, int]:
    """Coded symbols, most significant bit first, and the number of bits."""
    known = np.array(sorted(table), np.int64)
    at = np.searchsorted(known, symbols)
    code, length = (np.array([table[s][k] for s in known.tolist()], np.int64)[at] for k in (0, 1))
    stop = np.cumsum(length)
    place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - length, length)
    bits = (np.repeat(code, length) >> (np.repeat(length, length) - 1 - place)) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes(), len(bits)


def unpacked(raw: bytes, n: int, table: Table) -> np.ndarray:
    """The ``n`` symbols of :func:`packed`: the symbol that would begin at every bit is looked up at once, then one step a symbol."""
    if not n:
        return np.zeros(0, np.int64)
    longest = max(length for _, length in table.values())
    aligned = sorted((code << (longest - length), symbol, length) for symbol, (code, length) in table.items())
    first = np.array([a for a, _, _ in aligned], np.uint64)
    byte = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint64)
    word = np.zeros(len(raw), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | byte[k : k + len(raw)]
    window = (np.repeat(word, 8) << np.tile(np.arange(8, dtype=np.uint64), len(raw))) >> np.uint64(64 - longest)
    which = np.searchsorted(first, window, "right") - 1
    length = np.array([size for *_, size in aligned])[which].tolist()
    places, at = [], 0
    for _ in range(n):
        if at >= len(length):
            raise ValueError("the bits end early")
        places.append(at)
        at += length[at]
    if at > len(length):
        raise ValueError("the bits end early")
    return np.array([s for _, s, _ in aligned], np.int64)[which[places]]


def pack_codes(codes: DataFrame, table: Table) -> DataFrame:
    """``run_id, block, n, n_bits, blob``: byte-aligned blocks of coded symbols, compressed."""
    shared = codes.sparkSession.sparkContext.broadcast(table)

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        raw, bits = packed(block.sort_values("pos")["code"].to_numpy(), shared.value)
        return pd.DataFrame({"run_id": block["run_id"].iloc[:1].to_numpy(), "block": block["block"].iloc[:1].to_numpy(), "n": [len(block)], "n_bits": [bits], "blob": [zstandard.compress(raw, 3)]})

    cut = codes.withColumn("block", F.floor(F.col("pos") / BLOCK_POINTS))
    return cut.groupBy("run_id", "block").applyInPandas(pack, "run_id int, block long, n long, n_bits long, blob binary")


def unpack_codes(blocks: DataFrame, table: Table) -> DataFrame:
    """The rows of :func:`pack_codes` as run_id, pos, code again."""
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def unpack(frames):
        for frame in frames:
            for run, block, n, blob in zip(frame["run_id"], frame["block"], frame["n"], frame["blob"]):
                codes = unpacked(zstandard.decompress(blob), n, shared.value)
                yield pd.DataFrame({"run_id": np.int32(run), "pos": np.arange(n) + block * BLOCK_POINTS, "code": codes})

    return blocks.select("run_id", "block", "n", "blob").mapInPandas(unpack, "run_id int, pos long, code long")


def packed_bits(flags: DataFrame, part: Sequence[str], pos: str, flag: str) -> DataFrame:
    """``part, byte_no, byte``: flags of 0 or 1 packed eight to a byte, the first in the highest bit."""
    weight = F.element_at(F.array(*[F.lit(128 >> k) for k in range(8)]), (F.col(pos) % 8 + 1).cast("int"))
    shifted = F.when(F.col(flag) != 0, weight).otherwise(F.lit(0))
    return flags.groupBy(*part, F.floor(F.col(pos) / 8).alias("byte_no")).agg(F.sum(shifted).alias("byte"))


def unpacked_bits(packed: DataFrame, part: Sequence[str]) -> DataFrame:
    """``part, pos, flag`` of every bit of :func:`packed_bits`, the padding of the last byte included."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(7)))
    wide = packed.withColumn("bit", bit)
    return wide.select(*part, (F.col("byte_no") * 8 + F.col("bit")).alias("pos"), F.expr("shiftright(byte, 7 - bit) & 1").cast("long").alias("flag"))
