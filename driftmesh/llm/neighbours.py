"""The k nearest vectors of every vector: NN-descent, and greedy search in its graph.

Vectors may have any number of values, all the same.  A coarse first graph
links each node with nodes beside it on one curve through the projections of
the vectors on a few random directions.  NN-descent works on it in parts: a
task holds groups of up to ``BUCKET`` nodes whole, and of a larger group a
piece of the curve.  In each round the members of a node's list and the nodes
that list it are offered to each other, and whoever is offered something nearer
takes it.  Only pairs with a link that is new since the last round are looked
at, so offers fade as the graph settles.  Two more curves give new starts; a
group that is cut goes with its lists into other pieces along each of them, so
that nodes on either side of a cut meet.

If that has not settled a cut group (many dimensions), the rounds go on as
joins: a node asks every neighbour for its list, the members of a list are
offered to each other and to the askers, the askers to the members, to the
list's owner and to a few other askers, and takes what is nearer in a second
join.  Asking goes by bucket, so a node sends its vector once to every bucket
that holds neighbours of it and not once a neighbour.  A node with many links
costs k offers for each of them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmesh.scratch import Scratch

#: Neighbours on either side along the curve that the first graph is chosen from.
WINDOW = 4
#: Links a node holds during the descent beyond the k asked for, or a quarter of the dimensions if that is more; with k
#: alone the descent gets stuck.
SPARE = 5
#: Bits of a direction in a curve's code, and directions.
BITS, DIRECTIONS = 20, 3
#: Seeds of the curves' directions: the first gives the first graph, the others new starts once the descent has settled.
SEEDS = (11, 12, 13)
#: A coarser level of the curve is used once it has at most this share of the nodes of the last one.
THINNED = 0.6
#: Rows of a sorted partition that are worked on at once, and distances computed at once.
CHUNK, DISTANCES = 20_000, 200_000
#: Nodes and values of vectors that a task descends in at once, and nodes of a bucket of the joins.
BUCKET, VALUES, JOINED = 50_000, 2_000_000, 2048
#: Other askers of the same list that each asker is offered on either side.
BESIDE = 4
#: The descent ends when a round changes at most this share of all links, and fails after so many rounds.
SETTLED, MAX_ROUNDS = 0.02, 60
#: The same of the rounds inside a task that follow the last curve.
SETTLED_LAST = 0.002
#: Keys of a semi-join that are broadcast (about 40 bytes each); more are joined by a shuffle.
MAX_KEYS = 500_000
#: Queries of one pass of the exact search: bounds what is broadcast.
QUERIES = 100_000

#: Rows between the joins.  A blob holds 8-byte words: of a list (kind 0) the vector and, member by member, id, distance,
#: bucket, whether the link is new, and vector; of what is sent to a bucket (kind 1) see :func:`_asked` and :class:`_Found`.
_LIST = "g int, id long, bucket long, changed int, blob binary"
_ROW = f"kind int, {_LIST}"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
#: Rows between the parts.  The blob holds the vector, the ids and the distances of the members; code is the place along the next curve.
_SLIM = "g int, id long, bucket long, changed int, code long, blob binary"


def _fixed(values: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    n = values.shape[1] if values.ndim > 1 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * n), pa.array(np.ascontiguousarray(values).ravel()))


def _blobs(words: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """Words as a column of blobs: a row of a matrix each, or so many words each."""
    sizes = np.full(len(words), words.shape[1]) if sizes is None else sizes
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * 8
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(words).tobytes())]).cast(pa.binary())


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a column of blobs, and where each blob begins and ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), np.int64), (offsets - offsets[0]) // 8


def _f(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words).view(float)


def _w(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, float).view(np.int64)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def _lists(batch: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
    """List rows as arrays and matrices."""
    m = {c: batch.column(c).to_numpy() for c in ("g", "id", "bucket")}
    words = _words(batch.column("blob"))[0].reshape(batch.num_rows, -1)
    dim = (words.shape[1] - 4 * k) // (k + 1)
    links = words[:, dim:].reshape(-1, k, 4 + dim)
    return m | {"v": _f(words[:, :dim]), "ids": links[:, :, 0], "d2": _f(links[:, :, 1]), "at": links[:, :, 2], "fresh": links[:, :, 3] > 0, "vecs": _f(links[:, :, 4:])}


def _list_rows(m: dict[str, np.ndarray], kind: int | None = None) -> pa.RecordBatch:
    n, k = m["ids"].shape
    links = np.concatenate([m["ids"][:, :, None], _w(m["d2"])[:, :, None], m["at"][:, :, None], m["fresh"].astype(np.int64)[:, :, None], _w(m["vecs"])], 2)
    blob = _blobs(np.concatenate([_w(m["v"]), links.reshape(n, -1)], 1))
    cols = [pa.array(m[c]) for c in ("g", "id", "bucket")] + [pa.array(m["fresh"].sum(1).astype(np.int32)), blob]
    if kind is None:
        return pa.RecordBatch.from_arrays(cols, names=_NAMES[1:])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *cols], names=_NAMES)


def _sent(g: np.ndarray, ids: np.ndarray, to: np.ndarray, blob: pa.Array) -> pa.RecordBatch:
    """Rows of kind 1."""
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(g), pa.array(ids), pa.array(to), pa.array(np.zeros(n, np.int32)), blob], names=_NAMES)


def _best(ids: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k nearest different ids of each row, by distance and id; places without an id have an infinite d2."""
    order = np.lexsort((ids, d2), axis=1)
    sorted_ids = np.take_along_axis(ids, order, 1)
    sorted_d2 = np.take_along_axis(d2, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & np.isfinite(sorted_d2[:, 1:])  # one id has one distance
    return np.take_along_axis(order, np.argsort(again, axis=1, kind="stable")[:, :k], 1)


def _kept(m: dict[str, np.ndarray], more: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """List rows with ``more`` members offered, the k nearest kept."""
    both = {c: np.concatenate([m[c], more[c]], 1) for c in ("ids", "d2", "vecs", "at", "fresh")}
    twice = (both["ids"][:, :, None] == m["ids"][:, None, :]) & np.isfinite(m["d2"])[:, None, :]
    twice[:, : m["ids"].shape[1]] = False
    both["d2"][twice.any(2)] = np.inf
    pick = _best(both["ids"], both["d2"], k)
    out = {c: np.take_along_axis(both[c], pick if both[c].ndim == 2 else pick[:, :, None], 1) for c in both}
    return m | out


def _spread(v: np.ndarray) -> np.ndarray:
    """Every bit of a number of up to 21 bits moved to three times its place."""
    out = np.zeros(len(v), np.uint64)
    for k in range(BITS + 1):
        out |= ((v.astype(np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(DIRECTIONS * k)
    return out


def _projected(v: np.ndarray, seed: int) -> np.ndarray:
    """The vectors along a few random directions; finite even for the largest values."""
    way = np.random.default_rng(seed).normal(size=(max(v.shape[1], DIRECTIONS), DIRECTIONS))
    way, _ = np.linalg.qr(way)
    scale = np.abs(v).max(1, keepdims=True, initial=1e-300)
    return ((v / scale) @ way[: v.shape[1]]) * scale


def _codes(u: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Places along a curve through projections, scaled to their extents."""
    wide = hi > lo
    unit = np.divide(u / 2 - lo / 2, hi / 2 - lo / 2, out=np.zeros(u.shape), where=np.broadcast_to(wide, u.shape))
    total = np.zeros(len(u), np.uint64)
    for k in range(DIRECTIONS):
        total |= _spread((np.clip(unit[:, k], 0.0, 1.0) * 2**BITS).astype(np.int64)) << np.uint64(k)
    return total.astype(np.int64)


def _coded(nodes: DataFrame, seed: int) -> DataFrame:
    """``nodes`` (g, id, v, ...) with ``code``, the place along a curve through the projections of v, scaled to each g's extent."""
    keep = ", ".join(f"{n} {t}" for n, t in nodes.dtypes)
    names, own = [f"_u{k}" for k in range(DIRECTIONS)], nodes.columns

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _projected(_matrix(batch.column("v"), batch.num_rows), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(u[:, k])) for k in range(DIRECTIONS)]], names=[*batch.schema.names, *names])

    flat = Scratch(nodes.sparkSession, "projections").save(nodes.mapInArrow(project, f"{keep}, " + ", ".join(f"{n} double" for n in names)), "flat")
    extent = flat.groupBy("g").agg(*[f(c).alias(f"{c}_{s}") for c in names for f, s in ((F.min, "lo"), (F.max, "hi"))])

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, lo, hi = (np.stack([batch.column(f"{c}{s}").to_numpy(zero_copy_only=False) for c in names], 1) for s in ("", "_lo", "_hi"))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in own], pa.array(_codes(u, lo, hi))], names=[*own, "code"])

    return flat.join(extent, "g").mapInArrow(code, f"{keep}, code long")


def _along_curve(nodes: DataFrame, seed: int) -> DataFrame:
    return _coded(nodes, seed).repartitionByRange("g", "code", "id").sortWithinPartitions("g", "code", "id")


def _stretches(batches: Iterable[pa.RecordBatch], overlap: int) -> Iterator[tuple[dict[str, np.ndarray], int, int]]:
    """Consecutive rows of a sorted partition with ``overlap`` earlier ones, the number of those, and the place of the first row."""
    held: list[dict[str, np.ndarray]] = []
    rows, place, tail = 0, 0, None

    def merged():
        parts = ([tail] if tail else []) + held
        return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({n: _matrix(batch.column(n), batch.num_rows) if n == "v" else batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names})
        rows += batch.num_rows
        if rows >= CHUNK:
            m, old = merged(), 0 if tail is None else len(tail["g"])
            yield m, old, place - old
            place += rows
            tail, held, rows = {n: v[-overlap:] for n, v in m.items()}, [], 0
    if rows:
        old = 0 if tail is None else len(tail["g"])
        yield merged(), old, place - old


def _levels(g: np.ndarray, code: np.ndarray) -> Iterator[np.ndarray]:
    """All nodes of a stretch, then the first of every cell, for ever larger cells.

    A clump takes up one place on a coarse level, so nodes of thin regions
    find each other past it.
    """
    used = np.arange(len(code))
    yield used
    for bits in range(DIRECTIONS, DIRECTIONS * (BITS + 1), DIRECTIONS):
        cell = code >> bits
        first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (g[1:] != g[:-1])])
        if len(first) < 4:
            return
        if len(first) <= THINNED * len(used):
            used = first
            yield used


def _empty(n: int, k: int) -> dict[str, np.ndarray]:
    """Lists without members: their ids, places among the nodes at hand (-1: elsewhere), distances, and whether the link is new."""
    return {"ids": np.zeros((n, k), np.int64), "at": np.full((n, k), -1, np.int32), "d2": np.full((n, k), np.inf), "fresh": np.zeros((n, k), bool)}


def _first_bits(d2: np.ndarray, bits: int) -> np.ndarray:
    """So many leading bits of distances, which are ordered as the distances are."""
    return np.ascontiguousarray(d2).view(np.int64) >> (63 - bits)


def _among(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where the rows of a table hold the values."""
    found = np.zeros(len(rows), bool)
    for c in range(table.shape[1]):
        found |= table[:, c][rows] == values
    return found


def _turns(keys: np.ndarray) -> np.ndarray:
    """The place of each of the sorted keys among its equals."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
    return np.arange(len(keys)) - np.repeat(start, np.diff(np.r_[start, len(keys)]))


class _Nodes:
    """The nodes at hand, fewer than 2 ** 20, and their places by id."""

    def __init__(self, g: np.ndarray, ids: np.ndarray, v: np.ndarray):
        self.g, self.ids, self.axes = g, ids, [np.ascontiguousarray(v[:, c]) for c in range(v.shape[1])]
        self.by_id = np.argsort(ids, kind="stable")
        self.rank = np.empty(len(ids), np.int64)
        self.rank[self.by_id] = np.arange(len(ids))
        self.bits = max(1, len(ids).bit_length())

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d2 = np.zeros(len(x))
        for c in self.axes:
            gap = c[x] - c[y]
            d2 += gap * gap
        return d2


def _take(nodes: _Nodes, lists: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, d2: np.ndarray) -> int:
    """Lists (in place) after x were offered y, all within their reach; the k nearest are kept, by distance and id.  The number of new links."""
    if not len(x):
        return 0
    k, bits = lists["d2"].shape[1], nodes.bits
    # one number an offer sorts much faster than several keys: x, the distance's first bits, the place of y by id
    keys = np.sort((x.astype(np.int64) << (63 - bits)) | (_first_bits(d2, 63 - 2 * bits) << bits) | nodes.rank[y])
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    x, y = keys >> (63 - bits), nodes.by_id[keys & ((1 << bits) - 1)]
    use = ~_among(lists["at"], x, y)
    x, y = x[use], y[use]
    if not len(x):
        return 0
    turn = _turns(x)
    rows, row = x[turn == 0], np.cumsum(turn == 0) - 1
    use = turn < k
    row, turn, x, y = row[use], turn[use], x[use], y[use]
    more = _empty(len(rows), int(turn.max()) + 1)
    for c, values in (("ids", nodes.ids[y]), ("at", y), ("d2", nodes.distances(x, y)), ("fresh", True)):
        more[c][row, turn] = values
    both = {c: np.concatenate([lists[c][rows], more[c]], 1) for c in lists}
    pick = np.argsort(both["d2"], axis=1)
    d2 = np.take_along_axis(both["d2"], pick, 1)
    ties = np.flatnonzero(((d2[:, 1:] == d2[:, :-1]) & np.isfinite(d2[:, 1:])).any(1))
    if len(ties):
        pick[ties] = np.lexsort((both["ids"][ties], both["d2"][ties]), axis=1)
    pick = pick[:, :k]
    for c in both:
        lists[c][rows] = np.take_along_axis(both[c], pick, 1)
    return int(((pick >= k) & np.isfinite(d2[:, :k])).sum())


def _beside(nodes: _Nodes, code: np.ndarray, lists: dict[str, np.ndarray]) -> int:
    """Lists (in place) after each node was offered those beside it along a curve, on every level; the number of new links."""
    order = np.lexsort((nodes.ids, code, nodes.g))
    changed = 0
    for used in _levels(nodes.g[order], code[order]):
        at = order[used]
        pairs = [(at[:-step], at[step:]) for step in range(1, min(WINDOW, len(at) - 1) + 1)]
        if not pairs:
            break
        x, y = (np.concatenate(p) for p in zip(*pairs))
        same = nodes.g[x] == nodes.g[y]
        changed += _offer_both(nodes, lists, x[same], y[same])
    return changed


def _offer_both(nodes: _Nodes, lists: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> int:
    d2, far = nodes.distances(x, y), np.ascontiguousarray(lists["d2"][:, -1])
    ok = np.isfinite(d2)
    a, b = np.flatnonzero(ok & (d2 <= far[x])), np.flatnonzero(ok & (d2 <= far[y]))
    return _take(nodes, lists, np.r_[x[a], y[b]], np.r_[y[a], x[b]], np.r_[d2[a], d2[b]])


def _round(nodes: _Nodes, lists: dict[str, np.ndarray]) -> int:
    """A round of NN-descent among the nodes at hand (lists in place): members and askers of every list meet; the number of new links."""
    n, k = lists["at"].shape
    at, fresh = lists["at"].copy(), lists["fresh"].copy()
    lists["fresh"][:] = False
    # askers that are no members, the nearest first; more than a row holds go into further rows of the same list
    r, c = np.nonzero(at >= 0)
    p, new = at[r, c].astype(np.int64), fresh[r, c]
    mutual = np.zeros(len(p), bool)
    for j in range(k):
        same = at[:, j][p] == r
        mutual |= same
        same &= new
        fresh[p[same], j] = True
    r, c, p, new = r[~mutual], c[~mutual], p[~mutual], new[~mutual]
    low = k.bit_length()
    keys = (((p << (63 - 2 * nodes.bits - low) | _first_bits(lists["d2"][r, c], 63 - 2 * nodes.bits - low)) << nodes.bits) | r) << low | c
    keys.sort()
    p, r, c = keys >> (63 - nodes.bits), (keys >> low) & ((1 << nodes.bits) - 1), keys & ((1 << low) - 1)
    d2, new = lists["d2"][r, c], fresh[r, c]
    turn, most = _turns(p), max(1, k // 2)
    further = (turn >= most) & (turn % most == 0)
    row, owner = np.where(turn < most, p, n - 1 + np.cumsum(further)), np.r_[np.arange(n), p[further]]
    met = np.concatenate([at[owner], np.full((len(owner), most), -1, np.int32)], 1)
    is_new = np.concatenate([fresh[owner], np.zeros((len(owner), most), bool)], 1)
    met[row, k + turn % most], is_new[row, k + turn % most] = r, new
    is_new &= met >= 0
    # an asker that is new to a list is offered to its owner, too
    use = new & (d2 <= lists["d2"][:, -1][p])
    changed = _take(nodes, lists, p[use], r[use], d2[use])
    active = np.flatnonzero(is_new.any(1) & ((met >= 0).sum(1) > 1))
    i, j = np.triu_indices(met.shape[1], 1)
    step = max(1, DISTANCES // len(i))
    for a in range(0, len(active), step):
        rows = active[a : a + step]
        m, f = met[rows], is_new[rows]
        there = m >= 0
        ok = (np.take(f, i, 1) | np.take(f, j, 1)) & np.take(there, i, 1) & np.take(there, j, 1)
        ok[:, j < k] &= (rows < n)[:, None]  # members meet once
        pair = np.flatnonzero(ok)
        row = pair // len(i) * m.shape[1]
        pair %= len(i)
        changed += _offer_both(nodes, lists, m.ravel()[row + i[pair]].astype(np.int64), m.ravel()[row + j[pair]].astype(np.int64))
    return changed


def _descent(nodes: _Nodes, code: np.ndarray, lists: dict[str, np.ndarray], rounds: int, settled: float) -> None:
    """What a curve has to offer to the nodes at hand, then rounds until the lists (in place) have settled."""
    _beside(nodes, code, lists)
    for _ in range(rounds):
        if _round(nodes, lists) <= settled * lists["d2"].size:
            return
    if rounds == MAX_ROUNDS:
        raise RuntimeError("the descent did not settle")


def _slim(batch: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
    """Rows between the parts as arrays and matrices."""
    m = {c: batch.column(c).to_numpy() for c in ("g", "id", "bucket") if c in batch.schema.names}
    words = _words(batch.column("blob"))[0].reshape(batch.num_rows, -1)
    dim = words.shape[1] - 2 * k
    return m | {"v": _f(words[:, :dim]), "ids": words[:, dim : dim + k], "d2": _f(words[:, dim + k :])}


def _slim_rows(m: dict[str, np.ndarray]) -> pa.RecordBatch:
    blob = _blobs(np.concatenate([_w(m["v"]), m["ids"], _w(m["d2"])], 1))
    cols = [pa.array(m[c]) for c in ("g", "id", "bucket")] + [pa.array(m["changed"].astype(np.int32)), pa.array(m["code"]), blob]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _SLIM.split(", ")])


def _placed(m: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The lists that rows of one g brought along."""
    order = np.argsort(m["id"])
    found = order[np.clip(np.searchsorted(m["id"][order], m["ids"]), 0, len(order) - 1)]
    here = (m["id"][found] == m["ids"]) & np.isfinite(m["d2"])
    return _empty(len(order), k) | {"ids": m["ids"].copy(), "d2": m["d2"].copy(), "at": np.where(here, found, -1).astype(np.int32)}


def _whole(k: int, rounds: int):
    """Lists of groups that are in one task, from rows in the order of g; a few groups are worked on at once."""

    def lists_of(m: dict[str, np.ndarray]) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, m["g"][1:] != m["g"][:-1]])
        size = np.diff(np.r_[start, len(m["g"])])
        for seed in SEEDS if rounds == MAX_ROUNDS else SEEDS[:1]:
            u = _projected(m["v"], seed)
            lo, hi = (np.repeat(f.reduceat(u, start), size, axis=0) for f in (np.minimum, np.maximum))
            code = _codes(u, lo, hi)
            if seed == SEEDS[0]:  # neighbours lie close together in memory
                order = np.lexsort((code, m["g"]))
                m, code = {c: x[order] for c, x in m.items()}, code[order]
                nodes, lists = _Nodes(m["g"], m["id"], m["v"]), _empty(len(order), k)
            _descent(nodes, code, lists, rounds, SETTLED_LAST if seed == SEEDS[-1] else SETTLED)
        zero = np.zeros(len(m["g"]), np.int64)
        return _slim_rows(m | lists | {"bucket": zero, "changed": zero, "code": zero})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = {"g": batch.column("g").to_numpy(), "id": batch.column("id").to_numpy(), "v": _matrix(batch.column("v"), batch.num_rows)}
            held.append(m)
            rows += batch.num_rows
            if rows >= CHUNK:
                m = _joined(held)
                cut = int(np.searchsorted(m["g"], m["g"][-1]))  # the last group may go on
                if cut:
                    yield lists_of({c: x[:cut] for c, x in m.items()})
                held, rows = [{c: x[cut:] for c, x in m.items()}], rows - cut
        if rows:
            yield lists_of(_joined(held))

    return run


def _piece(k: int, rounds: int, part: int, extents: dict[int, np.ndarray] | None):
    """Lists of pieces of cut groups, from rows in the order of g and code, and their places along the next curve."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def lists_of(m: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for s in range(-(-len(m["id"]) // (2 * part))):  # one piece, but for a range that came out far too large
                q = {c: x[2 * part * s : 2 * part * (s + 1)] for c, x in m.items()}
                old = q.get("ids")
                lists = _empty(len(q["id"]), k) if old is None else _placed(q, k)
                _descent(_Nodes(q["g"], q["id"], q["v"]), q["code"], lists, rounds, SETTLED if extents else SETTLED_LAST)
                q |= {c: lists[c] for c in ("ids", "d2")}
                gone = np.zeros(len(q["id"]), int) if old is None else k - (old[:, :, None] == q["ids"][:, None, :]).any(1).sum(1)
                code = np.zeros(len(q["id"]), np.int64)
                if extents:
                    seed, lo, hi = extents[int(q["g"][0])]
                    code = _codes(_projected(q["v"], seed), lo, hi)
                yield _slim_rows(q | {"bucket": number + np.arange(len(code)) // JOINED, "changed": gone, "code": code})
                number += -(-len(code) // JOINED)

        held = []
        for batch in batches:
            g = batch.column("g").to_numpy()
            cuts = (np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(g)]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                m = _slim(rows, k) if "blob" in batch.schema.names else {"g": g[a:b], "id": rows.column("id").to_numpy(), "v": _matrix(rows.column("v"), b - a)}
                if held and held[0]["g"][0] != m["g"][0]:
                    yield from lists_of(_joined(held))
                    held = []
                held.append(m | {"code": rows.column("code").to_numpy()})
        if held:
            yield from lists_of(_joined(held))

    return run


def _offer(ids: np.ndarray, d2: np.ndarray, at: np.ndarray, v: np.ndarray) -> pa.Array:
    """Blobs of offers: id, distance, bucket and vector of who is offered."""
    return _blobs(np.concatenate([ids[:, None], _w(d2)[:, None], at[:, None], _w(v)], 1))


def _asked(k: int):
    """Every list, and its node (kind 1) in each bucket with neighbours of it: reach, bucket, vector, and id and newness of each such link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _lists(batch, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), *batch.columns], names=_NAMES)
            row, col = np.nonzero(np.isfinite(m["d2"]))
            if not len(row):
                continue
            order = np.lexsort((m["at"][row, col], row))
            row, col = row[order], col[order]
            to = m["at"][row, col]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (to[1:] != to[:-1])])
            links, who = np.diff(np.r_[first, len(row)]), row[first]
            head = 2 + m["v"].shape[1]
            sizes = head + 2 * links
            start = np.cumsum(sizes) - sizes
            words = np.empty(int(sizes.sum()), np.int64)
            words[start[:, None] + np.arange(head)] = np.concatenate([_w(m["d2"][who, -1:]), m["bucket"][who, None], _w(m["v"][who])], 1)
            place = np.repeat(start + head - 2 * first, links) + 2 * np.arange(len(row))
            words[place], words[place + 1] = m["ids"][row, col], m["fresh"][row, col]
            yield _sent(m["g"][who], m["id"][who], to[first], _blobs(words, sizes))

    return run


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Bucket, kind and rows of consecutive stretches of sorted rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "kind"))
        cuts = (np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
            yield int(bucket[a]), int(kind[a]), batch.slice(a, b - a)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


class _Found:
    """Offers of one bucket: who is offered whom, each with the bucket it lives in."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, to: np.ndarray, x: np.ndarray, y: np.ndarray, d2: np.ndarray, v: np.ndarray, at: np.ndarray) -> None:
        if len(x):
            self.parts.append((to, x, y, d2, v, at))
            self.size += len(x)

    def rows(self, g: int) -> Iterator[pa.RecordBatch]:
        """The k nearest different offers of each."""
        if not self.parts:
            return
        to, x, y, d2, v, at = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((y, d2, x))
        order = order[np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]]
        start = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
        turn = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        use = order[turn < self.k]
        yield _sent(np.full(len(use), g, np.int32), x[use], to[use], _offer(y[use], d2[use], at[use], v[use]))


def _offers(k: int):
    """What the lists of each bucket have to offer: to the askers their members and to their owners the askers, and to their members each other."""

    def among_members(own: dict[str, np.ndarray], asked: np.ndarray, found: _Found) -> Iterator[pa.RecordBatch]:
        n, size = own["ids"].shape
        step = max(1, DISTANCES // (size * size))
        for a in range(0, n, step):
            s = slice(a, min(n, a + step))
            gap = own["vecs"][s][:, :, None] - own["vecs"][s][:, None]
            d2 = np.einsum("abcd,abcd->abc", gap, gap)
            # a member that doesn't ask for this list has only nearer neighbours than its owner
            ok = (d2 <= own["d2"][s][:, :, None]) & ~asked[s][:, :, None] & (own["fresh"][s][:, :, None] | own["fresh"][s][:, None])
            there = np.isfinite(own["d2"][s])
            ok &= there[:, :, None] & there[:, None] & (own["ids"][s][:, :, None] != own["ids"][s][:, None])
            r, i, j = np.nonzero(ok)
            ids, at, vecs = own["ids"][s], own["at"][s], own["vecs"][s]
            found.add(at[r, i], ids[r, i], ids[r, j], d2[r, i, j], vecs[r, j], at[r, j])
            if found.size > DISTANCES:
                yield from found.rows(int(own["g"][0]))

    def to_askers(own: dict[str, np.ndarray], order: np.ndarray, asked: np.ndarray, batch: pa.RecordBatch, found: _Found) -> Iterator[pa.RecordBatch]:
        words, ends = _words(batch.column("blob"))
        dim = own["v"].shape[1]
        head = ends[:-1, None] + np.arange(2 + dim)
        reach, home, v, ids = _f(words[head[:, 0]]), words[head[:, 1]], _f(words[head[:, 2:]]), batch.column("id").to_numpy()
        count = (np.diff(ends) - 2 - dim) // 2
        who = np.repeat(np.arange(batch.num_rows), count)
        place = np.repeat(ends[:-1] + 2 + dim - 2 * (np.cumsum(count) - count), count) + 2 * np.arange(len(who))
        p = order[np.searchsorted(own["id"][order], words[place])]
        new = words[place + 1] > 0
        step = max(1, DISTANCES // own["ids"].shape[1])
        for a in range(0, len(p), step):
            w, q, fresh = who[a : a + step], p[a : a + step], new[a : a + step]
            there = np.isfinite(own["d2"][q])
            same = (own["ids"][q] == ids[w][:, None]) & there
            r, c = np.nonzero(same)
            asked[q[r], c] = True
            gap = own["vecs"][q] - v[w][:, None]
            d2 = np.einsum("abc,abc->ab", gap, gap)
            r, c = np.nonzero(there & ~same & (fresh[:, None] | own["fresh"][q]) & (d2 <= reach[w][:, None]))
            found.add(home[w[r]], ids[w[r]], own["ids"][q[r], c], d2[r, c], own["vecs"][q[r], c], own["at"][q[r], c])
            r, c = np.nonzero(there & ~same & (fresh[:, None] | own["fresh"][q]) & (d2 <= own["d2"][q]))
            found.add(own["at"][q[r], c], own["ids"][q[r], c], ids[w[r]], d2[r, c], v[w[r]], home[w[r]])
            gap = own["v"][q] - v[w]
            d2 = np.einsum("ab,ab->a", gap, gap)
            r = np.flatnonzero(fresh & ~same.any(1) & (d2 <= own["d2"][q, -1]))
            found.add(own["bucket"][q[r]], own["id"][q[r]], ids[w[r]], d2[r], v[w[r]], home[w[r]])
            by = np.lexsort((d2, q))  # askers of one list meet those that are about as far from its owner
            for lag in range(1, BESIDE + 1):
                i, j = by[:-lag], by[lag:]
                use = (q[i] == q[j]) & (fresh[i] | fresh[j])
                i, j = w[i[use]], w[j[use]]
                gap = v[i] - v[j]
                d2 = np.einsum("ab,ab->a", gap, gap)
                for x, y in ((i, j), (j, i)):
                    r = np.flatnonzero(d2 <= reach[x])
                    found.add(home[x[r]], ids[x[r]], ids[y[r]], d2[r], v[y[r]], home[y[r]])
            if found.size > DISTANCES:
                yield from found.rows(int(own["g"][0]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, own, found = None, [], None, _Found(k)

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal own
            if parts:
                own = own or _joined(parts)
                yield from among_members(own, asked if asked is not None else np.zeros(own["ids"].shape, bool), found)
                yield from found.rows(int(own["g"][0]))

        asked = order = None
        for key, kind, batch in _by_bucket(batches):
            if key != bucket:
                yield from done()
                bucket, parts, own, asked = key, [], None, None
            if kind == 0:
                parts.append(_lists(batch, k))
                continue
            if own is None:
                own = _joined(parts)
                order = np.argsort(own["id"])
                asked = np.zeros(own["ids"].shape, bool)
            yield from to_askers(own, order, asked, batch, found)
        yield from done()

    return run


def _taken(k: int):
    """Lists with the offers they were made; links that were not there before are fresh."""

    def taken(own: dict[str, np.ndarray], offers: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        x = np.concatenate([b.column("id").to_numpy() for b in offers])
        words = np.concatenate([_words(b.column("blob"))[0] for b in offers]).reshape(len(x), -1)
        y, d2, at, v = words[:, 0], _f(words[:, 1]), words[:, 2], _f(words[:, 3:])
        order = np.argsort(own["id"])
        row = order[np.searchsorted(own["id"][order], x)]
        use = np.lexsort((y, d2, row))
        use = use[np.r_[True, (row[use][1:] != row[use][:-1]) | (y[use][1:] != y[use][:-1])]]
        start = np.flatnonzero(np.r_[True, row[use][1:] != row[use][:-1]])
        turn = np.arange(len(use)) - np.repeat(start, np.diff(np.r_[start, len(use)]))
        use, turn = use[turn < k], turn[turn < k]
        n = len(own["id"])
        more = {"ids": np.zeros((n, k), np.int64), "d2": np.full((n, k), np.inf), "vecs": np.zeros((n, k, v.shape[1])), "at": np.zeros((n, k), np.int64), "fresh": np.ones((n, k), bool)}
        for c, values in (("ids", y), ("d2", d2), ("vecs", v), ("at", at)):
            more[c][row[use], turn] = values[use]
        return _kept(own, more, k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, own, offers = None, [], None, []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal own
            if parts:
                own = own or _joined(parts) | {"fresh": np.zeros(_joined(parts)["ids"].shape, bool)}
                yield _list_rows(taken(own, offers) if offers else own)

        for key, kind, batch in _by_bucket(batches):
            if key != bucket:
                yield from done()
                bucket, parts, own, offers = key, [], None, []
            if kind == 0:
                parts.append(_lists(batch, k))
                continue
            offers.append(batch)
            if sum(b.num_rows for b in offers) > DISTANCES:
                own = taken(own or _joined(parts) | {"fresh": np.zeros(_joined(parts)["ids"].shape, bool)}, offers)
                offers = []
        yield from done()

    return run


class Graph:
    """The lists of NN-descent, ``k`` members each (k asked for and some to spare), by distance and id, and the nodes (g, id, v)."""

    def __init__(self, lists: DataFrame, k: int, nodes: DataFrame):
        self.lists, self.k, self.nodes = lists, k, nodes

    def links(self, most: int) -> DataFrame:
        """The first members of every list as rows: g, a, b, d2."""
        k = self.k

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    m = _slim(batch, k)
                    r, c = np.nonzero(np.isfinite(m["d2"][:, :most]))
                    yield pa.RecordBatch.from_arrays([pa.array(m["g"][r]), pa.array(m["id"][r]), pa.array(m["ids"][r, c]), pa.array(m["d2"][r, c])], names=["g", "a", "b", "d2"])

        return self.lists.mapInArrow(run, "g int, a long, b long, d2 double")


def _extents(nodes: DataFrame) -> list[dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    """Of every curve its seed and each g's least and largest projections; for cut groups, which are few."""
    names = [f"u{k}" for k in range(len(SEEDS) * DIRECTIONS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g, v = batch.column("g").to_numpy(), _matrix(batch.column("v"), batch.num_rows)
            u = np.concatenate([_projected(v, seed) for seed in SEEDS], 1)
            order = np.argsort(g, kind="stable")
            start = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1]])
            lo, hi = (f.reduceat(u[order], start) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(g[order][start])] + [pa.array(np.ascontiguousarray(x)) for e in (lo, hi) for x in e.T], names=["g"] + [f"{c}_{s}" for s in ("lo", "hi") for c in names])

    flat = nodes.mapInArrow(run, "g int, " + ", ".join(f"{c}_{s} double" for s in ("lo", "hi") for c in names))
    rows = flat.groupBy("g").agg(*[f(f"{c}_{s}") for s, f in (("lo", F.min), ("hi", F.max)) for c in names]).collect()
    at = lambda row, s, e: np.array(row[1 + e * len(names) + s * DIRECTIONS :][:DIRECTIONS])
    return [{row[0]: (seed, at(row, s, 0), at(row, s, 1)) for row in rows} for s, seed in enumerate(SEEDS)]


def _with_vectors(lists: DataFrame, k: int) -> DataFrame:
    """Lists for the joins, every member with its vector and bucket, every link new."""

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _slim(batch, k)
                r, c = np.nonzero(np.isfinite(m["d2"]))
                yield pa.RecordBatch.from_arrays([pa.array(m["g"][r]), pa.array(m["id"][r]), pa.array(m["ids"][r, c]), pa.array(c.astype(np.int32)), pa.array(m["d2"][r, c])], names=["g", "a", "id", "place", "d2"])

    def owners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("g", "id", "bucket")] + [_fixed(_slim(batch, k)["v"])], names=["g", "id", "bucket", "v"])

    def filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v, met = _matrix(batch.column("v"), n), batch.column("m")
            count = np.diff(met.offsets.to_numpy())
            r, part = np.repeat(np.arange(n), count), met.flatten()
            c, b, d2, at = (part.field(f).to_numpy(zero_copy_only=False) for f in ("place", "b", "d2", "at"))
            m = {"g": batch.column("g").to_numpy(), "id": batch.column("id").to_numpy(), "bucket": batch.column("bucket").to_numpy(), "v": v}
            m |= {"ids": np.zeros((n, k), np.int64), "d2": np.full((n, k), np.inf), "vecs": np.zeros((n, k, v.shape[1])), "at": np.zeros((n, k), np.int64), "fresh": np.ones((n, k), bool)}
            m["ids"][r, c], m["d2"][r, c], m["at"][r, c], m["vecs"][r, c] = b, d2, at, _matrix(part.field("w"), len(r))
            yield _list_rows(m)

    nodes = lists.mapInArrow(owners, "g int, id long, bucket long, v array<double>")
    met = lists.mapInArrow(members, "g int, a long, id long, place int, d2 double").join(nodes.select("g", "id", F.col("bucket").alias("at"), F.col("v").alias("w")), ["g", "id"])
    met = met.groupBy("g", F.col("a").alias("id")).agg(F.collect_list(F.struct("place", F.col("id").alias("b"), "d2", "at", "w")).alias("m"))
    return nodes.join(met, ["g", "id"]).select("g", "id", "bucket", "v", "m").mapInArrow(filled, _LIST)


def _without_vectors(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _lists(batch, k)
                zero = np.zeros(batch.num_rows, np.int64)
                yield _slim_rows(m | {"changed": zero, "code": zero})

    return run


def _cut_lists(nodes: DataFrame, k: int, part: int, size: int, rounds: int) -> DataFrame:
    """Lists of groups too large for a task."""
    scratch = Scratch(nodes.sparkSession, "cut")
    extents = _extents(nodes)

    def first_code(batches: Iterable[pa.RecordBatch], extents=extents[0]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g, v = batch.column("g").to_numpy(), _matrix(batch.column("v"), batch.num_rows)
                lo, hi = (np.stack([extents[x][e] for x in g.tolist()]) for e in (1, 2))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_codes(_projected(v, extents[int(g[0])][0]), lo, hi))], names=[*batch.schema.names, "code"])

    lists, done = scratch.save(nodes.mapInArrow(first_code, "g int, id long, v array<double>, code long"), "places"), False
    for s in range(len(SEEDS) if rounds == MAX_ROUNDS else 1):
        pieces = lists.repartitionByRange(-(-size // part), "g", "code", "id").sortWithinPartitions("g", "code", "id")
        lists = scratch.save(pieces.mapInArrow(_piece(k, rounds, part, extents[s + 1] if s + 1 < len(SEEDS) else None), _SLIM), f"pieces{s}")
        scratch.drop(f"pieces{s - 1}" if s else "places")
        done = s > 0 and (lists.agg(F.sum("changed")).first()[0] or 0) <= SETTLED * size * k
    if done or rounds < MAX_ROUNDS:
        return lists
    lists = scratch.save(_with_vectors(lists, k), "lists0")
    for r in range(rounds):
        asks = lists.mapInArrow(_asked(k), _ROW).repartition("bucket").sortWithinPartitions("bucket", "kind")
        both = lists.select(F.lit(0).alias("kind"), "*").unionByName(asks.mapInArrow(_offers(k), _ROW)).repartition("bucket").sortWithinPartitions("bucket", "kind")
        lists = scratch.save(both.mapInArrow(_taken(k), _LIST), f"lists{r + 1}")
        scratch.drop(f"lists{r}")
        if (lists.agg(F.sum("changed")).first()[0] or 0) <= SETTLED * size * k:
            return lists.mapInArrow(_without_vectors(k), _SLIM)
    raise RuntimeError("the descent did not settle")


def neighbour_lists(nodes: DataFrame, k: int = 5, rounds: int = MAX_ROUNDS) -> Graph:
    """The graph of NN-descent over ``nodes``, as for :func:`neighbour_graph`.

    With ``rounds`` below MAX_ROUNDS the descent ends after that many from the
    first graph; else it ends when it has settled, and fails if it never does.
    """
    scratch = Scratch(nodes.sparkSession, "neighbours")
    nodes = nodes.select(F.col("g").cast("int").alias("g"), "id", "v").where("g is not null and id is not null and v is not null and size(v) > 0")
    nodes = scratch.save(nodes.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))), "nodes")
    first = nodes.select(F.size("v")).first()
    dim = first[0] if first else 1
    k += max(SPARE, dim // 4)
    part = min(BUCKET, max(1, VALUES // dim))
    sizes = scratch.save(nodes.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    inside, cut = sizes.agg(F.sum(F.when(F.col("n") <= part, F.col("n"))), F.sum(F.when(F.col("n") > part, F.col("n")))).first()
    found = []
    large = F.broadcast(sizes.where(F.col("n") > part).select("g"))  # at most a row for so many nodes
    if cut:
        found.append(_cut_lists(nodes.join(large, "g", "left_semi"), k, part, cut, rounds))
    if inside or not cut:
        tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-(inside or 0) // part))
        whole = nodes.join(large, "g", "left_anti").repartition(tasks, "g").sortWithinPartitions("g")
        found.append(scratch.save(whole.mapInArrow(_whole(k, rounds), _SLIM), "whole"))
    return Graph(found[0] if len(found) == 1 else found[0].unionByName(found[1]), k, nodes)


def neighbour_graph(nodes: DataFrame, k: int = 5, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``g, a, b, d2``: the (nearly always exact) k nearest nodes b of every node a of the same g.

    ``nodes``: g int, id long, v array<double> of one length (other lengths
    fail the job), one row per (g, id); rows with a null or a value that isn't
    finite are no nodes, other columns are ignored.  Distances are Euclidean, the
    node itself is left out, equal distances are ranked by the smaller id,
    nodes at one place are each other's neighbours at distance 0.  A g of
    fewer than k + 1 nodes links all of them; an empty table gives an empty
    result.
    """
    return neighbour_lists(nodes, k, rounds).links(k)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every query with the nodes just before and after it along the curve."""
    for m, _, _ in _stretches(batches, 4 * WINDOW):
        q = np.flatnonzero(m["is_query"].astype(bool))
        nodes = np.flatnonzero(~m["is_query"].astype(bool))
        if not len(q) or not len(nodes):
            continue
        other = np.clip(np.searchsorted(nodes, q)[:, None] + np.arange(-2, 2), 0, len(nodes) - 1)
        src, dst = np.repeat(q, other.shape[1]), nodes[other.ravel()]
        use = m["g"][src] == m["g"][dst]
        src, dst = src[use], dst[use]
        gap = m["v"][src] - m["v"][dst]
        yield pa.RecordBatch.from_arrays([pa.array(m["g"][src]), pa.array(m["id"][src]), _fixed(m["v"][src]), pa.array(m["id"][dst]), pa.array((gap * gap).sum(1)), pa.array(np.ones(len(src), bool))], names=["g", "a", "v", "b", "d2", "fresh"])


def _opened(k: int):
    """The members of the lists asked for, each with its asker's vector and reach."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _slim(batch, k)
            v = _matrix(batch.column("v"), batch.num_rows)
            r, c = np.nonzero(np.isfinite(m["d2"]))
            yield pa.RecordBatch.from_arrays([pa.array(m["g"][r]), pa.array(batch.column("a").to_numpy()[r]), _fixed(v[r]), pa.array(batch.column("reach").to_numpy()[r]), pa.array(m["ids"][r, c])], names=["g", "a", "v", "reach", "id"])

    return run


def _reached(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of askers (v) and nodes (w) the pairs within the asker's reach."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _matrix(batch.column("v"), batch.num_rows)
        gap = _matrix(batch.column("w"), batch.num_rows) - v
        d2 = np.einsum("ab,ab->a", gap, gap)
        r = np.flatnonzero(d2 <= batch.column("reach").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(r)), batch.column("a").take(pa.array(r)), _fixed(v[r]), batch.column("id").take(pa.array(r)), pa.array(d2[r]), pa.array(np.ones(len(r), bool))], names=["g", "a", "v", "b", "d2", "fresh"])


def graph_search(queries: DataFrame, graph: Graph, k: int = 5, beam: int = 16) -> DataFrame:
    """``g, a, b, d2, place``: about the k nodes b nearest to each query a, by greedy search in ``graph``.

    ``queries``: g, id, v; ``graph``: that of :func:`neighbour_lists`.  A
    query enters the graph at the nodes beside it along two curves and holds
    its ``beam`` best nodes; each round opens the lists of those not yet
    opened, which alone are fetched, until no query has any left.  A node with
    the query's own id is not a result.
    """
    lists = graph.lists
    scratch = Scratch(lists.sparkSession, "search")
    link = "g int, a long, v array<double>, b long, d2 double, fresh boolean"
    both = graph.nodes.withColumn("is_query", F.lit(False)).unionByName(queries.select(F.col("g").cast("int").alias("g"), "id", "v", F.lit(True).alias("is_query")))
    found = [_along_curve(both, seed).mapInArrow(_entries, link) for seed in SEEDS[:2]]

    def best(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("g", "a", "b").agg(F.first("v").alias("v"), F.min("d2").alias("d2"), F.min("fresh").alias("fresh"))
        return once.withColumn("place", F.row_number().over(Window.partitionBy("g", "a").orderBy("d2", "b"))).where(F.col("place") <= beam)

    held = scratch.save(best(found[0].unionByName(found[1])), "held0")
    for r in range(MAX_ROUNDS):
        reach = F.when(F.count("*").over(Window.partitionBy("g", "a")) < beam, F.lit(float("inf"))).otherwise(F.max("d2").over(Window.partitionBy("g", "a")))
        ask = scratch.save(held.withColumn("reach", reach).where("fresh").select("g", "a", "v", "b", "reach"), f"ask{r}")
        pivots = scratch.save(ask.select("g", F.col("b").alias("id")).distinct(), f"pivots{r}")
        needed = lists.join(F.broadcast(pivots) if pivots.count() <= MAX_KEYS else pivots, ["g", "id"], "left_semi").select("g", "id", "blob")
        met = scratch.save(ask.withColumnRenamed("b", "id").join(needed, ["g", "id"]).mapInArrow(_opened(graph.k), "g int, a long, v array<double>, reach double, id long"), f"met{r}")
        keys = scratch.save(met.select("g", "id").distinct(), f"keys{r}")
        there = graph.nodes.withColumnRenamed("v", "w").join(F.broadcast(keys) if keys.count() <= MAX_KEYS else keys, ["g", "id"], "left_semi")
        met = met.join(there, ["g", "id"]).mapInArrow(_reached, link)
        held = scratch.save(best(held.drop("place").withColumn("fresh", F.lit(False)).unionByName(met)), f"held{r + 1}")
        scratch.drop(f"held{r}", f"ask{r}", f"pivots{r}", f"met{r}", f"keys{r}")
        if not held.where("fresh").limit(1).count():
            break
    else:
        raise RuntimeError("the search did not end")
    place = Window.partitionBy("g", "a").orderBy("d2", "b")
    return held.where("a <> b").withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("g", "a", "b", "d2", "place")


def exact_neighbours(queries: DataFrame, nodes: DataFrame, k: int = 5, most: int = QUERIES) -> DataFrame:
    """``g, a, b, d2``: the k nodes b nearest to each query a, by comparing a stated set of queries with all nodes, in blocks.

    ``queries`` and ``nodes``: g, id, v.  The queries are taken in passes of
    about ``most``; a task keeps each query's k best of its own nodes.
    """
    spark = nodes.sparkSession
    queries = queries.select(F.col("g").cast("int").alias("g"), "id", "v")
    passes = max(1, -(-queries.count() // most))
    out = None
    for p in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("g", "id"), F.lit(passes)) == p).orderBy("g", "id").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.g for r in rows]), np.array([r.id for r in rows]), np.array([r.v for r in rows])))

        def compare(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qg, qid, qv = shared.value
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

            def shrunk():
                q, b, d2 = (np.concatenate(c) for c in zip(*held))
                order = np.lexsort((b, d2, q))
                start = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]]) if len(q) else np.zeros(0, int)
                turn = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
                return [(q[order][turn < k], b[order][turn < k], d2[order][turn < k])]

            for batch in batches:
                if not batch.num_rows:
                    continue
                g, ids, v = batch.column("g").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("v"), batch.num_rows)
                for run in np.unique(g):
                    own, asking = np.flatnonzero(g == run), np.flatnonzero(qg == run)
                    step = max(1, DISTANCES // max(1, len(own)))
                    for a in range(0, len(asking), step):
                        who = asking[a : a + step]
                        d2 = sum((qv[who, c][:, None] - v[own, c]) ** 2 for c in range(v.shape[1]))
                        d2[qid[who][:, None] == ids[own]] = np.inf
                        near = np.argpartition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, :k]
                        worst = np.take_along_axis(d2, near, 1).max(1)
                        r, c = np.nonzero((d2 <= worst[:, None]) & np.isfinite(d2))  # all that tie with the k-th
                        held.append((who[r], ids[own][c], d2[r, c]))
                if sum(len(x[0]) for x in held) > 4 * DISTANCES:
                    held = shrunk()
            ((q, b, d2),) = shrunk()
            yield pa.RecordBatch.from_arrays([pa.array(qg[q].astype(np.int32)), pa.array(qid[q]), pa.array(b), pa.array(d2)], names=["g", "a", "b", "d2"])

        found = nodes.select(F.col("g").cast("int").alias("g"), "id", "v").mapInArrow(compare, "g int, a long, b long, d2 double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "g int, a long, b long, d2 double")
    place = Window.partitionBy("g", "a").orderBy("d2", "b")
    return out.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place")
