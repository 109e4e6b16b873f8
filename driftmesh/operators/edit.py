"""Repairing a reconstruction so that its links are those of the original."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.components import components
from driftmesh.operators.pairs import editable_points
from driftmesh.scratch import Scratch

#: Levels of a quantised edit.
LEVELS = 65_535
#: Pairs a task edits at once, and pairs (about 45 bytes each in a task) beyond which a component is spread over many tasks.
BUCKET_PAIRS, MOST_PAIRS = 100_000, 10_000_000
#: Pairs whose distance is looked at at once, and steps between two looks for resting points.
NEAR_BLOCK, RESTING = 100_000, 8
#: Constants of the Adam update.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def exact_edit(recon: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The reconstruction with the exact values of every point of a vulnerable pair."""
    mark = editable_points(pairs).withColumn("exact", F.lit(True))
    true = points.select("run_id", "id", *[F.col(a).alias(f"t{a}") for a in "xyz"])
    both = recon.select("run_id", "id", "x", "y", "z").join(true, ["run_id", "id"]).join(mark, ["run_id", "id"], "left")
    return both.select("run_id", "id", *[F.when(F.col("exact"), F.col(f"t{a}")).otherwise(F.col(a)).alias(a) for a in "xyz"], F.coalesce("exact", F.lit(False)).cast("long").alias("edited"))


def tolerance(xi: float, dim: int) -> float:
    """Largest change of a distance by quantising the edits."""
    return 2 * xi / LEVELS * 2 * np.sqrt(dim)


def _descend(pos, org, i, j, apart, b, tol, xi, run, whole, lr, steps, keep_losses=True):
    """``steps`` projected Adam updates of all points at once: the places, and each run's loss before each step.

    ``b``, ``tol`` and ``xi`` are those of the runs, ``run`` is that of each point.  A run that is ``whole`` stops at its
    first loss below the squared tolerance.  A pair farther from its bound than its points may still move adds neither
    loss nor pull, so only the pairs near theirs are looked at until some point has moved too far; a point that no pair
    pulls and that its momentum moves no more rests until a pair pulls it again.
    """
    pos, n, runs = pos.copy(), len(pos), len(b)
    one = runs == 1
    of = (lambda x, p: x[0]) if one else (lambda x, p: x[run[p]])
    m, v, seen, slot = np.zeros_like(pos), np.zeros_like(pos), np.zeros(n, np.int64), np.full(n, -1)
    live = np.zeros(0, np.int64)
    losses, going = np.zeros((runs, steps if keep_losses else 0)), np.ones(runs, bool)
    stride, reach, spread = lr * np.sqrt(pos.shape[1]), 0.0, np.sqrt(float(np.median(xi)) / 2)

    def near() -> np.ndarray:
        found = []
        for a in range(0, len(i), NEAR_BLOCK):
            s = slice(a, a + NEAR_BLOCK)
            gap = pos[i[s]] - pos[j[s]]
            d = np.sqrt((gap * gap).sum(1))
            over = np.where(apart[s], d - of(b, i[s]), of(b, i[s]) - d)
            found.append(a + np.flatnonzero(over < of(tol, i[s]) + 2 * reach * (1 + 1e-9) + 1e-12 * d))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    stale = True
    for t in range(1, steps + 1):
        if stale:
            reach = spread * np.sqrt(stride)
            held = near()
            hi, hj, hapart, place, stale = i[held], j[held], apart[held], pos.copy(), False
            hb, htol = of(b, hi), of(tol, hi)
        diff = pos[hi] - pos[hj]
        d = np.sqrt((diff * diff).sum(1))
        over = np.where(hapart, np.minimum(d - hb - htol, 0.0), np.maximum(d - hb + htol, 0.0))
        loss = np.array([(over * over).sum()]) if one else np.bincount(run[hi], over * over, runs)
        if keep_losses:
            losses[:, t - 1] = loss
        ended = whole & going & (loss < tol * tol)
        if ended.any():
            going &= ~ended
            if not going.any():
                break
            left, hleft, still = going[run[i]], going[run[hi]], going[run[live]]
            i, j, apart = i[left], j[left], apart[left]
            hi, hj, hapart, hb, htol, diff, d = hi[hleft], hj[hleft], hapart[hleft], hb[hleft], htol[hleft], diff[hleft], d[hleft]
            slot[live[~still]] = -1
            live = live[still]
            slot[live] = np.arange(len(live))
        pulled = np.flatnonzero((d >= htol) & (hapart == (d <= hb)))
        pi, pj = hi[pulled], hj[pulled]
        new = np.unique(np.concatenate([pi[slot[pi] < 0], pj[slot[pj] < 0]]))
        if len(new):  # what their momentum has faded to since
            rest = (t - 1 - seen[new])[:, None]
            m[new] *= BETA1**rest
            v[new] *= BETA2**rest
            slot[new] = len(live) + np.arange(len(new))
            live = np.concatenate([live, new])
        pull = (2 * (d[pulled] - (hb if one else hb[pulled])) / np.where(d[pulled] > 0, d[pulled], 1))[:, None] * diff[pulled]
        grad = np.stack([np.bincount(slot[pi], pull[:, k], len(live)) - np.bincount(slot[pj], pull[:, k], len(live)) for k in range(pos.shape[1])], 1)
        m[live] = mom = BETA1 * m[live] + (1 - BETA1) * grad
        v[live] = var = BETA2 * v[live] + (1 - BETA2) * grad * grad
        rate = lr * np.sqrt(1 - BETA2**t) / (1 - BETA1**t)
        bound = of(xi, live) if one else of(xi, live)[:, None]
        old = pos[live]
        pos[live] = now = np.clip(old - rate * mom / (np.sqrt(var) + EPSILON), org[live] - bound, org[live] + bound)
        moved = np.abs(now - old).max(1, initial=0.0)
        if not len(pulled) and not moved.any():
            if keep_losses:
                losses[:, t:] = losses[:, t - 1 : t]
            break
        far = now - place[live]
        if (far * far).sum(1).max(initial=0.0) > reach * reach:
            stale, stride = True, max(float(moved.max()), 1e-9 * lr)
        if t % RESTING == 0:
            rests = moved == 0
            rests[slot[pi]] = rests[slot[pj]] = False
            if rests.any():
                seen[live[rests]], slot[live[rests]] = t, -1
                live = live[~rests]
                slot[live] = np.arange(len(live))
    return pos, losses


def edit_of(q: Column, xi: Column) -> Column:
    """The move that a quantised edit stands for."""
    return q * (4 * xi / LEVELS) - 2 * xi


def gradient_edit(recon: DataFrame, points: DataFrame, pairs: DataFrame, lr: float = 0.01, max_iter: int = 1000) -> DataFrame:
    """The reconstruction with its vulnerable points moved, within xi of their true places, until the links are right."""
    edits = gradient_edits(recon, points, pairs, lr, max_iter)
    params = pairs.groupBy("run_id").agg(F.first("xi").alias("xi"), F.first("dim").alias("dim"))
    out = recon.select("run_id", "id", "x", "y", "z").join(params, "run_id", "left").join(edits, ["run_id", "id"], "left")
    return out.select("run_id", "id", *[(F.col(a) + F.coalesce(edit_of(F.col(f"q{a}"), F.col("xi")), F.lit(0.0))).alias(a) for a in "xyz"], F.col("qx").isNotNull().cast("long").alias("edited"))


def gradient_edits(recon: DataFrame, points: DataFrame, pairs: DataFrame, lr: float = 0.01, max_iter: int = 1000) -> DataFrame:
    """``run_id, id, qx, qy, qz``: quantised moves of all points of vulnerable pairs; qz is null in two dimensions.

    Loss and updates are separable over the components of the vulnerable
    pairs; only the step at which a run stops, the first whose loss is below
    the squared tolerance, belongs to the whole run.  Components are packed
    into buckets: small runs share one and stop in it; of a run in several,
    Spark sums the losses by step, and should it stop before the last step,
    a second pass repeats exactly its steps.  Components of more than
    MOST_PAIRS pairs take the same steps as joins, one a step.
    """
    scratch = Scratch(recon.sparkSession, "edit")
    comp = components(pairs.select("run_id", "i", "j"))
    params = scratch.save(pairs.groupBy("run_id").agg(F.first("dim").alias("dim"), F.first("b").alias("b"), F.first("xi").alias("xi"), F.count("*").alias("pairs")), "params")
    of_i = comp.withColumnRenamed("id", "i")
    held = pairs.select("run_id", "i", "j", (F.col("sign") == 1).alias("apart")).join(of_i, ["run_id", "i"])
    sizes = pairs.groupBy("run_id", "i").agg(F.count("*").alias("size")).join(of_i, ["run_id", "i"]).groupBy("run_id", "cluster_id").agg(F.sum("size").alias("size"))
    big = scratch.save(sizes.where(F.col("size") > MOST_PAIRS), "large")
    n_big = big.count()
    true = points.select("run_id", "id", *[F.col(a).alias(f"t{a}") for a in "xyz"])
    place = scratch.save(recon.select("run_id", "id", "x", "y", "z").join(comp, ["run_id", "id"]).join(true, ["run_id", "id"]), "places")

    whole = (F.col("pairs") <= BUCKET_PAIRS) & F.col("has_big").isNull()
    params = params.join(big.select("run_id").distinct().withColumn("has_big", F.lit(True)), "run_id", "left").withColumn("whole", whole)
    many, shared = params.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("pairs"), F.when(F.col("whole"), F.col("pairs")))]).first()
    share = F.pmod(F.xxhash64("run_id"), F.lit(max(1, -(-shared // BUCKET_PAIRS))))
    own = F.pmod(F.xxhash64("run_id", "cluster_id"), F.ceil(F.col("pairs") / BUCKET_PAIRS))
    group = [F.when(F.col("whole"), F.lit(None)).otherwise(F.col("run_id")).cast("long").alias("of"), F.when(F.col("whole"), share).otherwise(own).cast("long").alias("bucket")]
    parts = int(min(10_000, max(1, -(-many // BUCKET_PAIRS))))
    small = held.join(F.broadcast(big), ["run_id", "cluster_id"], "left_anti") if n_big else held
    place_small = place.join(F.broadcast(big), ["run_id", "cluster_id"], "left_anti") if n_big else place

    def descended(runs: DataFrame, final: bool) -> DataFrame:
        """Edits after each run's ``steps``, and, unless ``final``, the losses of runs in several buckets."""
        a = small.join(runs.select("run_id", "pairs", "whole"), "run_id").select(*group, "run_id", "i", "j", "apart").repartition(parts, "of", "bucket")
        p = place_small.join(runs, "run_id").select(*group, "run_id", "id", *_PLACE, "dim", "b", "xi", "steps", "whole").repartition(parts, "of", "bucket")
        return a.groupBy("of", "bucket").cogroup(p.groupBy("of", "bucket")).applyInArrow(_bucket(lr, final), _MOVED)

    moved = scratch.save(descended(params.withColumn("steps", F.lit(max_iter)), False), "moved")
    noted = moved.where("losses is not null").select("run_id", F.posexplode("losses").alias("step", "loss")).groupBy("run_id", "step").agg(F.sum("loss").alias("loss"))
    by_step = scratch.save(noted.join(params.select("run_id", "xi", "dim"), "run_id"), "losses")
    stop = by_step.groupBy("run_id").agg(F.coalesce(F.min(F.when(F.col("loss") < _tolerance2(), F.col("step"))), F.lit(max_iter)).alias("steps"))
    joined = None
    if n_big:
        wide = held.join(F.broadcast(big), ["run_id", "cluster_id"]).withColumn("sign", F.col("apart").cast("long")).join(params.select("run_id", "dim", "b", "xi"), "run_id")
        for p in "ij":
            wide = wide.join(place.select("run_id", F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in _PLACE]), ["run_id", p])
        joined, other = _by_joins(scratch.save(wide, "wide"), by_step, scratch, lr, max_iter)
        stop = stop.join(other, "run_id", "left_anti").unionByName(other)
    early = scratch.save(stop.where(F.col("steps") < max_iter), "early")
    edits = moved.where("id is not null").drop("losses")
    if early.limit(1).count():
        again = scratch.save(descended(params.join(early, "run_id"), True), "again")
        edits = edits.join(early.select("run_id"), "run_id", "left_anti").unionByName(again.drop("losses"))
    return edits if joined is None else edits.unionByName(joined)


def _bucket(lr: float, final: bool):
    """A bucket's edits and, unless ``final``, the losses of its runs that aren't whole."""

    def run(pairs: pa.Table, points: pa.Table) -> pa.Table:
        c = {n: points.column(n).to_numpy() for n in points.column_names if n not in ("of", "bucket")}
        order = np.lexsort((c["id"], c["run_id"]))
        c = {n: x[order] for n, x in c.items()}
        runs, first, run = np.unique(c["run_id"], return_index=True, return_inverse=True)
        dim, b, xi, whole = (c[n][first] for n in ("dim", "b", "xi", "whole"))
        used = np.stack([np.ones(len(run), bool)] * 2 + [dim[run] == 3], 1)
        pos, org = (np.where(used, np.stack([c[n] for n in names], 1), 0.0) for names in (_PLACE[:3], _PLACE[3:]))
        if not (dim == 3).any():
            pos, org = np.ascontiguousarray(pos[:, :2]), np.ascontiguousarray(org[:, :2])
        end = [*first[1:], len(run)]
        asked = pairs.column("run_id").to_numpy()
        i, j, known = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        for r in range(len(runs)):
            own = np.flatnonzero(asked == runs[r])
            ids, there = c["id"][first[r] : end[r]], True
            for name, out in (("i", i), ("j", j)):
                want = pairs.column(name).to_numpy()[own]
                at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
                there = there & (ids[at] == want)
                out[own] = first[r] + at
            known[own] = there
        apart = pairs.column("apart").to_numpy()
        del pairs, points, asked
        if not known.all():  # the reconstruction lacks particles
            i, j, apart = i[known], j[known], apart[known]
        paired = np.zeros(len(run), bool)
        paired[i] = paired[j] = True
        tol = np.array([tolerance(x, d) for x, d in zip(xi, dim)])
        new, losses = _descend(pos, org, i, j, apart, b, tol, xi, run, whole, lr, int(c["steps"].max(initial=0)), not final)
        q = np.clip(np.floor((new - pos + 2 * xi[run][:, None]) * (LEVELS / (4 * xi[run][:, None]))), 0, LEVELS).astype(np.int64)
        c, q, used = {n: c[n][paired] for n in ("run_id", "id")}, q[paired], used[paired]
        qz = pa.array(q[:, 2], mask=~used[:, 2]) if q.shape[1] == 3 else pa.nulls(len(q), pa.int64())
        out = [pa.array(c["run_id"].astype(np.int32)), pa.array(c["id"]), pa.array(q[:, 0]), pa.array(q[:, 1]), qz, pa.nulls(len(q), pa.list_(pa.float64()))]
        parts = [pa.Table.from_arrays(out, schema=_MOVED_ARROW)]
        told = np.flatnonzero(~whole) if not final else np.zeros(0, int)
        if len(told):
            none = pa.nulls(len(told), pa.int64())
            parts.append(pa.Table.from_arrays([pa.array(runs[told].astype(np.int32)), none, none, none, none, pa.array([losses[r] for r in told], pa.list_(pa.float64()))], schema=_MOVED_ARROW))
        return pa.concat_tables(parts)

    return run


_MOVED = "run_id int, id long, qx long, qy long, qz long, losses array<double>"
_MOVED_ARROW = pa.schema([("run_id", pa.int32()), *[(c, pa.int64()) for c in ("id", "qx", "qy", "qz")], ("losses", pa.list_(pa.float64()))])
_PLACE = ("x", "y", "z", "tx", "ty", "tz")


def _tolerance2() -> Column:
    tol = 2 * F.col("xi") / LEVELS * 2 * F.sqrt(F.col("dim").cast("double"))
    return tol * tol


def _by_joins(held: DataFrame, losses: DataFrame, scratch: Scratch, lr: float, max_iter: int) -> tuple[DataFrame, DataFrame]:
    """The edits of components too large for a task, and the steps of their runs: each step joins the pairs with the places.

    ``losses``: those of the runs' other components, by step.
    """
    pairs = scratch.save(held.select("run_id", "dim", "b", "xi", "i", "j", (F.col("sign") == 1).alias("apart")), "big")
    ends = [held.select("run_id", "dim", "xi", F.col(p).alias("id"), *[F.col(f"{p}_{c}").alias(c) for c in _PLACE]) for p in "ij"]
    state = ends[0].unionByName(ends[1]).distinct().select("*", *[F.col(a).alias(f"s{a}") for a in "xyz"], *[F.lit(0.0).alias(f"{m}{a}") for m in "mv" for a in "xyz"], F.lit(None).cast("int").alias("steps"))
    state = scratch.save(state, "state0")
    tol = F.sqrt(_tolerance2())
    for t in range(max_iter):
        side = lambda p, s=state: s.select("run_id", F.col("id").alias(p), *[F.col(a).alias(f"{p}{a}") for a in "xyz"])
        met = pairs.join(side("i"), ["run_id", "i"]).join(side("j"), ["run_id", "j"]).withColumns({f"d{a}": F.col(f"i{a}") - F.col(f"j{a}") for a in "xyz"})
        met = scratch.save(met.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))), f"met{t}")
        over = F.when(F.col("apart"), F.least(F.col("d") - F.col("b") - tol, F.lit(0.0))).otherwise(F.greatest(F.col("d") - F.col("b") + tol, F.lit(0.0)))
        loss = met.groupBy("run_id", "xi", "dim").agg(F.sum(over * over).alias("own"))
        loss = loss.join(losses.where(F.col("step") == t).select("run_id", "loss"), "run_id", "left").select("run_id", (F.col("own") + F.coalesce("loss", F.lit(0.0)) < _tolerance2()).alias("now"))
        active = met.where((F.col("d") >= tol) & (F.col("apart") == (F.col("d") <= F.col("b"))))
        way = F.explode(F.array(F.struct(F.col("i").alias("id"), F.lit(1.0).alias("w")), F.struct(F.col("j").alias("id"), F.lit(-1.0).alias("w"))))
        pull = active.select("run_id", way.alias("e"), *[(2 * (F.col("d") - F.col("b")) / F.col("d") * F.col(f"d{a}")).alias(f"p{a}") for a in "xyz"])
        grad = pull.groupBy("run_id", "e.id").agg(*[F.sum(F.col("e.w") * F.col(f"p{a}")).alias(f"g{a}") for a in "xyz"])
        new = state.join(loss, "run_id", "left").join(grad, ["run_id", "id"], "left").withColumn("steps", F.coalesce("steps", F.when(F.col("now"), F.lit(t))))
        rate = lr * float(np.sqrt(1 - BETA2 ** (t + 1)) / (1 - BETA1 ** (t + 1)))
        runs = F.col("steps").isNull()
        for a in "xyz":
            g = F.coalesce(f"g{a}", F.lit(0.0))
            new = new.withColumns({f"m{a}": BETA1 * F.col(f"m{a}") + (1 - BETA1) * g, f"v{a}": BETA2 * F.col(f"v{a}") + (1 - BETA2) * g * g})
            step = F.col(a) - rate * F.col(f"m{a}") / (F.sqrt(f"v{a}") + EPSILON)
            new = new.withColumn(a, F.when(runs, F.least(F.greatest(step, F.col(f"t{a}") - F.col("xi")), F.col(f"t{a}") + F.col("xi"))).otherwise(F.col(a)))
        state = scratch.save(new.select(*state.columns), f"state{t + 1}")
        scratch.drop(f"state{t}", f"met{t}")
        if not state.where("steps is null").limit(1).count():
            break
    q = lambda a: F.least(F.greatest(F.floor((F.col(a) - F.col(f"s{a}") + 2 * F.col("xi")) * (LEVELS / (4 * F.col("xi")))), F.lit(0)), F.lit(LEVELS)).cast("long")
    edits = state.select("run_id", "id", q("x").alias("qx"), q("y").alias("qy"), F.when(F.col("dim") == 3, q("z")).alias("qz"))
    return edits, state.groupBy("run_id").agg(F.coalesce(F.first("steps"), F.lit(max_iter)).alias("steps"))
