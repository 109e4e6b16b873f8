"""Per-key statistics when a handful of keys holds most rows.

The rows are never shuffled by key.  Every task takes its equal share of the
input, encodes the keys it meets through a dictionary of blocks of ``SLOTS``
consecutive numbers and scatters its rows into dense accumulator arrays; only
those blocks are shuffled, as many rows as a task has blocks, and added up.
A key that holds a third of all rows costs the reduction one slot per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive numbers that share one accumulator block.
SLOTS = 256
#: Blocks a task holds before it hands on what it has (about 60 MB with three values).
MAX_BLOCKS = 4096


class _Blocks:
    """Dense arrays of one task, block after block."""

    def __init__(self, n_values: int):
        self.index: dict[tuple[int, int], int] = {}
        self.count = np.zeros(0, np.int64)
        self.low = np.zeros((n_values, 0))
        self.high = np.zeros((n_values, 0))

    def places(self, group: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Dictionary-encode (group, block) pairs; room for new ones is made."""
        groups, g = np.unique(group, return_inverse=True)
        blocks, b = np.unique(block, return_inverse=True)
        pairs, at = np.unique(g * len(blocks) + b, return_inverse=True)
        codes = np.array([self.index.setdefault((int(groups[p // len(blocks)]), int(blocks[p % len(blocks)])), len(self.index)) for p in pairs], np.int64)
        need = len(self.index) * SLOTS
        if need > len(self.count):
            more = max(need, 2 * len(self.count)) - len(self.count)
            self.count = np.pad(self.count, (0, more))
            self.low = np.pad(self.low, ((0, 0), (0, more)), constant_values=np.inf)
            self.high = np.pad(self.high, ((0, 0), (0, more)), constant_values=-np.inf)
        return codes[at]

    def add(self, group: np.ndarray, number: np.ndarray, values: list[np.ndarray]) -> None:
        flat = self.places(group, number // SLOTS) * SLOTS + number % SLOTS
        used, at = np.unique(flat, return_inverse=True)
        self.count[used] += np.bincount(at, minlength=len(used))
        for k, v in enumerate(values):
            np.fmin.at(self.low[k], flat, v)
            np.fmax.at(self.high[k], flat, v)

    def batch(self, names: Sequence[str]) -> pa.RecordBatch:
        cut = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a[: len(self.index) * SLOTS]), SLOTS).cast(pa.list_(pa.from_numpy_dtype(a.dtype)))
        keys = list(self.index)
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), cut(self.count)]
        for k in range(len(self.low)):
            columns += [cut(self.low[k]), cut(self.high[k])]
        return pa.RecordBatch.from_arrays(columns, names=list(names))


def dense_stats(rows: DataFrame, group: str, number: str, values: Sequence[str] = ()) -> DataFrame:
    """Count, minimum and maximum per (``group``, ``number``), free of key skew.

    ``group`` and ``number`` are integer columns; rows with a null in either
    belong to no key.  A null value counts as a row but has no part in the
    minimum and maximum, which are null where a key has no value at all; NaN
    is taken as null.  Result: ``group``, ``number``, n and, for each value v,
    min_v and max_v.  An empty table gives an empty result; other columns are
    ignored.
    """
    names = ["grp", "block", "n", *[f"{side}{k}" for k in range(len(values)) for side in ("lo", "hi")]]
    schema = "grp long, block long, n array<long>" + "".join(f", {c} array<double>" for c in names[3:])

    def scatter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(len(values))
        for batch in batches:
            if not batch.num_rows:
                continue
            group, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            vals = [batch.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(values))]
            blocks.add(group, number, vals)
            if len(blocks.index) > MAX_BLOCKS:
                yield blocks.batch(names)
                blocks = _Blocks(len(values))
        if blocks.index:
            yield blocks.batch(names)

    clean = rows.where(rows[group].isNotNull() & rows[number].isNotNull()).select(
        rows[group].cast("long").alias("g"), rows[number].cast("long").alias("k"), *[rows[v].cast("double").alias(f"v{i}") for i, v in enumerate(values)]
    )
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal blocks of all tasks, which follow each other, added slot by slot."""
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = {c: batch.column(c).to_numpy() for c in names[:2]} | {c: batch.column(c).flatten().to_numpy().reshape(-1, SLOTS) for c in names[2:]}
            m = m if rest is None else {c: np.concatenate([rest[c], m[c]]) for c in names}
            first = np.flatnonzero(np.r_[True, (m["grp"][1:] != m["grp"][:-1]) | (m["block"][1:] != m["block"][:-1])])
            sums = {c: m[c][first] for c in names[:2]} | {c: (np.add if c == "n" else np.minimum if c.startswith("lo") else np.maximum).reduceat(m[c], first, axis=0) for c in names[2:]}
            yield slots({c: v[:-1] for c, v in sums.items()})
            rest = {c: v[-1:] for c, v in sums.items()}
        if rest is not None:
            yield slots(rest)

    def slots(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        row, slot = np.nonzero(sums["n"])
        cols = [sums["grp"][row], sums["block"][row] * SLOTS + slot, *[sums[c][row, slot] for c in names[2:]]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["grp", "number", *names[2:]])

    parts = clean.mapInArrow(scatter, schema).repartition("grp", "block").sortWithinPartitions("grp", "block")
    total = parts.mapInArrow(add, "grp long, number long, n long" + "".join(f", {c} double" for c in names[3:]))
    none = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    return total.select(
        F.col("grp").alias(group),
        F.col("number").alias(number),
        "n",
        *[none(f"{side}{k}").alias(f"{name}_{v}") for k, v in enumerate(values) for side, name in (("lo", "min"), ("hi", "max"))],
    )
