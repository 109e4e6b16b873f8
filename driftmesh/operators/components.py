"""Connected components of links: smallest label of the neighbourhood, then one pointer jump a round."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.scratch import Scratch

MAX_ROUNDS = 200
#: Links a task contracts at once.
CHUNK = 300_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links u - v as links from each number to the smallest one they connect it with, itself left out."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots hook to smaller roots
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, chunk by chunk, as links from each point to the smallest one its chunk connects it with."""

    def chunk(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, i, j = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(3))
        order = np.argsort(run, kind="stable")
        runs, first = np.unique(run[order], return_index=True)
        for r, a, b in zip(runs, first, [*first[1:], len(run)]):
            ids, roots = contracted(i[order[a:b]], j[order[a:b]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r, np.int32)), pa.array(ids), pa.array(roots)], names=["run_id", "i", "j"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield from chunk(held)
            held = []
    if held:
        yield from chunk(held)


def components(links: DataFrame) -> DataFrame:
    """``run_id, id, cluster_id`` of every linked point; the cluster's id is its smallest point id.

    ``links``: run_id, i, j.  Every task first contracts the links it has, so
    that crowded clusters are a star a task.  Each round a point takes the smallest label
    among its own and its neighbours', and then the label that the point of
    that number has; labels only fall and the jump halves long chains.  Nulls
    and self-links join nothing.
    """
    scratch = Scratch(links.sparkSession, "components")
    clean = links.where("run_id is not null and i is not null and j is not null and i <> j").select(F.col("run_id").cast("int"), F.col("i").cast("long"), F.col("j").cast("long"))
    pairs = clean.mapInArrow(_stars, "run_id int, i long, j long").select("run_id", F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")), F.struct(F.col("j").alias("u"), F.col("i").alias("v")))).alias("e"))
    edges = scratch.save(pairs.select("run_id", "e.u", "e.v").distinct(), "edges")
    labels = scratch.save(edges.groupBy("run_id", F.col("u").alias("id")).agg(F.min("v").alias("m")).select("run_id", "id", F.least("id", "m").alias("label")), "labels0")
    for k in range(MAX_ROUNDS):
        heard = edges.join(labels.select("run_id", F.col("id").alias("v"), F.col("label").alias("heard")), ["run_id", "v"]).groupBy("run_id", F.col("u").alias("id")).agg(F.min("heard").alias("heard"))
        lower = labels.join(heard, ["run_id", "id"]).select("run_id", "id", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select("run_id", F.col("id").alias("label"), F.col("label").alias("next"))
        new = lower.join(jump, ["run_id", "label"], "left").select("run_id", "id", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        labels = scratch.save(new, f"labels{k + 1}")
        scratch.drop(f"labels{k}")
        if not labels.where("label <> old").limit(1).count():
            break
    else:
        raise RuntimeError("the labels did not settle")
    return labels.select("run_id", "id", F.col("label").alias("cluster_id"))


def every_point(points: DataFrame, linked: DataFrame) -> DataFrame:
    """``run_id, id, cluster_id`` of every point; one that ``linked`` doesn't have is its own cluster."""
    return points.select("run_id", "id").join(linked, ["run_id", "id"], "left").select("run_id", "id", F.coalesce("cluster_id", "id").alias("cluster_id"))
