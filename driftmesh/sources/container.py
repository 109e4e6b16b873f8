"""The compressed form of particle runs: a folder of Parquet tables.

``params`` (a row a run), ``tables`` (the Huffman codes of the four coded
streams), ``blocks`` (the streams of ``BLOCK`` points each, partitioned by
run) and ``order`` (which particle stands where, so that decoding gives every
particle its own coordinates back).

Streams of a block: ``flag`` (bits of outliers), ``code`` (quantisation codes),
``mask`` (bits of edited particles) and ``edit`` (their quantised edits) are
Huffman-coded and compressed; ``exact`` (outliers) and ``value`` (exact
coordinates of edited particles) are doubles as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.operators import codec, edit, grid, pairs
from driftmesh.scratch import Scratch

#: Points of a block; a multiple of eight, so that packed bits of blocks don't share a byte.
BLOCK = 4096
#: Coded streams, the type of their symbols, and bytes of a symbol in a code table besides code and length.
STREAMS = {"flag": (np.uint8, 1), "code": (np.int32, 4), "edit": (np.uint16, 2), "mask": (np.uint8, 1)}
_RAW = "run_id int, block long, n int, dim int, flag binary, code binary, edit binary, mask binary, exact binary, value binary"
_AXES = "xyz"


def _gathered(rows: pd.DataFrame) -> pd.DataFrame:
    """The streams of a block as plain bytes."""
    rows = rows.sort_values("visit_pos")
    dim = int(rows["dim"].iloc[0])
    axes, n = _AXES[:dim], len(rows)
    streams = {s: b"" for s in ("flag", "code", "edit", "mask", "exact", "value")}
    if "outlier_x" in rows:
        out = rows[[f"outlier_{a}" for a in axes]].to_numpy().astype(bool)
        codes = rows[[f"code_{a}" for a in axes]].to_numpy(dtype=float, na_value=0.0)
        streams["flag"] = np.packbits(out.ravel()).tobytes()
        streams["code"] = codes.ravel()[~out.ravel()].astype(np.int32).tobytes()
        streams["exact"] = rows[list(axes)].to_numpy().ravel()[out.ravel()].tobytes()
    if "edited" in rows:
        mask = rows["edited"].to_numpy(dtype=float, na_value=0.0) > 0
        streams["mask"] = np.packbits(mask).tobytes()
        if "qx" in rows:
            streams["edit"] = rows.loc[mask, [f"q{a}" for a in axes]].to_numpy(dtype=float).ravel().astype(np.uint16).tobytes()
        else:
            streams["value"] = rows.loc[mask, list(axes)].to_numpy().ravel().tobytes()
    first = rows.iloc[0]
    return pd.DataFrame([{"run_id": first["run_id"], "block": int(first["visit_pos"]) // BLOCK, "n": n, "dim": dim, **streams}])


def _counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for stream, (kind, _) in STREAMS.items():
            symbols, n = np.unique(np.frombuffer(b"".join(batch[stream]), kind), return_counts=True)
            yield pd.DataFrame({"stream": stream, "symbol": symbols.astype(np.int64), "freq": n})


def _written(rows: DataFrame, order: DataFrame, params: DataFrame, path: str) -> None:
    """Packs ``rows`` (a row a particle: run_id, visit_pos, dim, x, y, z, and codes or edits or both) and writes the container."""
    spark = rows.sparkSession
    cut = rows.groupBy("run_id", F.floor(F.col("visit_pos") / BLOCK).alias("block")).applyInPandas(_gathered, _RAW)
    raw = Scratch(spark, "container").save(cut, "raw")
    counts = raw.mapInPandas(_counted, "stream string, symbol long, freq long").groupBy("stream", "symbol").agg(F.sum("freq").alias("freq"))
    most = codec.MAX_SYMBOLS * len(STREAMS)
    freqs = counts.limit(most + 1).collect()  # at most 16-bit symbols
    tables = {s: codec.huffman_table([(r.symbol, r.freq) for r in freqs if r.stream == s]) for s in STREAMS if any(r.stream == s for r in freqs)}
    shared = spark.sparkContext.broadcast(tables)

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stream, (kind, _) in STREAMS.items():
                symbols = [np.frombuffer(b, kind) for b in batch[stream]]
                done = [codec.packed(s.astype(np.int64), shared.value[stream]) if len(s) else (b"", 0) for s in symbols]
                batch[f"n_{stream}"], batch[f"bits_{stream}"] = [len(s) for s in symbols], [bits for _, bits in done]
                batch[stream] = [zstandard.compress(b, 3) if b else b"" for b, _ in done]
            yield batch

    schema = _RAW + "".join(f", n_{s} long, bits_{s} long" for s in STREAMS)
    params.write.parquet(f"{path}/params")
    flat = [(stream, s, c, n) for stream, table in tables.items() for s, (c, n) in table.items()]
    spark.createDataFrame(flat, "stream string, symbol long, code long, length int").write.parquet(f"{path}/tables")
    raw.mapInPandas(encode, schema).write.partitionBy("run_id").option("compression", "uncompressed").parquet(f"{path}/blocks")
    order.select("run_id", "visit_pos", "id", "cell_id", "seq").write.parquet(f"{path}/order")


def _edited(rows: DataFrame, how: str, recon: DataFrame, points: DataFrame, params: DataFrame, lr: float, steps: int) -> DataFrame:
    """``rows`` with the edits that keep the links: quantised (``gradient``) or a mark for exact values (``exact``)."""
    if how == "none":
        return rows
    vulnerable = Scratch(rows.sparkSession, "vulnerable").save(pairs.vulnerable_pairs(points, params).drop("d2"), "pairs")
    marks = edit.gradient_edits(recon, points, vulnerable, lr, steps) if how == "gradient" else pairs.editable_points(vulnerable)
    return rows.join(marks.withColumn("edited", F.lit(1)), ["run_id", "id"], "left")


def compress(points: DataFrame, path: str, xi: float | DataFrame = grid.XI_SHARE, bound: str = "link", d: float | None = None, modes: DataFrame | None = None, how: str = "none", lr: float = 0.01, steps: int = 1000) -> None:
    """Compresses ``points`` (run_id, id, x, y, z, dim, link_len) into ``path``, each coordinate within xi.

    ``xi``, ``bound`` and ``d`` as in :func:`grid.grid_params`; ``modes``:
    run_id, mode (``kd`` or ``morton``, the default).  ``how`` the links are
    kept: ``none``, ``gradient`` (quantised edits, at most xi off the true
    place) or ``exact``.
    """
    params = grid.grid_params(points, xi, bound, d)
    mode = F.coalesce("mode", F.lit("morton")).alias("mode")
    params = params.withColumn("mode", F.lit("morton")) if modes is None else params.join(modes.select("run_id", "mode"), "run_id", "left").select(*params.columns, mode)
    scratch = Scratch(points.sparkSession, "compress")
    params = scratch.save(params, "params")
    rows = scratch.save(codec.coded(grid.with_cells(points, params).join(params.select("run_id", "mode"), "run_id")), "codes")
    recon = rows.select("run_id", "id", *[F.col(f"recon_{a}").alias(a) for a in _AXES])
    _written(_edited(rows, how, recon, points, params, lr, steps), rows, params.withColumn("how", F.lit(how)), path)


def compress_edits(points: DataFrame, base: DataFrame, path: str, xi: float | DataFrame | None = None, bound: str = "link", d: float | None = None, how: str = "gradient", lr: float = 0.01, steps: int = 1000) -> None:
    """A container of the edits alone that make ``base`` (run_id, id, x, y, z), a reconstruction from anywhere, keep the links.

    Without ``xi`` each run's is the largest error of its base.
    """
    if how not in ("gradient", "exact"):
        raise ValueError("give gradient or exact")
    if xi is None:
        other = base.select("run_id", "id", *[F.col(a).alias(f"b{a}") for a in _AXES])
        xi = points.join(other, ["run_id", "id"]).groupBy("run_id").agg(F.max(F.greatest(*[F.abs(F.col(a) - F.col(f"b{a}")) for a in _AXES])).alias("xi"))
    scratch = Scratch(points.sparkSession, "edits")
    params = scratch.save(grid.grid_params(points, xi, bound, d).withColumn("mode", F.lit("morton")), "params")
    rows = scratch.save(grid.visit_order(grid.with_cells(points, params)).select("run_id", "id", *_AXES, "dim", "cell_id", "seq", "visit_pos"), "order")
    _written(_edited(rows, how, base, points, params, lr, steps), rows, params.withColumn("how", F.lit(how)), path)


def _unpacked(blocks: DataFrame, tables: dict[str, codec.Table]) -> DataFrame:
    """A row a particle: run_id, visit_pos, codes, exact values of outliers, and edits."""
    shared = blocks.sparkSession.sparkContext.broadcast(tables)
    columns = [f"{c}_{a}" for c in ("code", "exact", "q", "value") for a in _AXES]
    schema = "run_id int, visit_pos long, edited boolean, " + ", ".join(f"{c} {'long' if c[:2] in ('co', 'q_') else 'double'}" for c in columns)

    def spread(mask: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.full(mask.shape, np.nan)
        out[mask] = values
        return out

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                n, dim = int(r["n"]), int(r["dim"])
                got = {s: codec.unpacked(zstandard.decompress(r[s]), int(r[f"n_{s}"]), shared.value[s]) if r[s] else np.zeros(0, np.int64) for s in STREAMS}
                bits = lambda s, many: np.unpackbits(got[s].astype(np.uint8))[:many].astype(bool) if len(got[s]) else np.zeros(many, bool)  # noqa: B023, E731
                out = bits("flag", n * dim)
                mask = bits("mask", n)
                wide = np.repeat(mask, dim)
                parts = {"code": spread(~out if len(got["code"]) or out.any() else np.zeros(n * dim, bool), got["code"]), "exact": spread(out, np.frombuffer(r["exact"]))}
                parts["q"] = spread(wide if len(got["edit"]) else np.zeros(n * dim, bool), got["edit"])
                parts["value"] = spread(wide if r["value"] else np.zeros(n * dim, bool), np.frombuffer(r["value"]))
                rows = {"run_id": np.full(n, r["run_id"], np.int32), "visit_pos": int(r["block"]) * BLOCK + np.arange(n), "edited": mask}
                for c, flat in parts.items():
                    for k, a in enumerate(_AXES):
                        v = flat.reshape(n, dim)[:, k] if k < dim else np.full(n, np.nan)
                        rows[f"{c}_{a}"] = pd.array(np.where(np.isnan(v), 0, v).astype(np.int64), "Int64") if c in ("code", "q") else pd.array(v, "Float64")
                        rows[f"{c}_{a}"][np.isnan(v)] = pd.NA
                yield pd.DataFrame(rows)

    needed = ["run_id", "block", "n", "dim", *STREAMS, "exact", "value", *[f"n_{s}" for s in STREAMS]]
    return blocks.select(*needed).mapInPandas(decode, schema)


def decompress(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    """``run_id, id, x, y, z, edited`` of a container; one of edits alone is applied to ``base``."""
    tables: dict[str, codec.Table] = {}
    for r in spark.read.parquet(f"{path}/tables").limit(codec.MAX_SYMBOLS * len(STREAMS)).collect():
        tables.setdefault(r.stream, {})[r.symbol] = (r.code, r.length)
    params = spark.read.parquet(f"{path}/params")
    got = _unpacked(spark.read.parquet(f"{path}/blocks"), tables)
    order = spark.read.parquet(f"{path}/order").join(params, "run_id")
    start = lambda a: F.when(F.col("mode") == "kd", F.col(f"centre_{a}")).otherwise(F.col(f"corner_{a}")).alias(f"o{a}")
    rows = grid.cell_coords(order).select("run_id", "visit_pos", "id", "cell_id", "seq", "dim", "xi", *[start(a) for a in _AXES]).join(got, ["run_id", "visit_pos"])
    if base is None:
        rows = codec.decoded(rows)
    else:
        rows = rows.join(base.select("run_id", "id", *[F.col(a).alias(f"recon_{a}") for a in _AXES]), ["run_id", "id"])
    used = lambda a: F.lit(True) if a != "z" else F.col("dim") == 3
    moved = lambda a: F.coalesce(f"value_{a}", F.col(f"recon_{a}") + F.coalesce(edit.edit_of(F.col(f"q_{a}"), F.col("xi")), F.lit(0.0)))
    return rows.select("run_id", "id", *[F.when(used(a), moved(a)).otherwise(F.lit(0.0)).alias(a) for a in _AXES], "edited")


def size_report(spark: SparkSession, path: str) -> DataFrame:
    """One row: particles, values, outliers, edited particles, raw_bytes (doubles), payload_bytes (streams, code tables, exact values), ratio, bits_per_value."""
    blocks = spark.read.parquet(f"{path}/blocks")
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    sums = blocks.agg(F.sum("n").alias("particles"), F.sum(F.col("n") * F.col("dim")).alias("values"), (size("exact") / 8).cast("long").alias("outliers"), F.sum(F.col("n_edit")).alias("edits"), (size("value") / 8).cast("long").alias("exact_edits"), sum((size(c) for c in (*STREAMS, "exact", "value")), F.lit(0)).alias("streams"))
    widths = F.create_map(*[F.lit(v) for s, (_, w) in STREAMS.items() for v in (s, w + 8)])
    tables = spark.read.parquet(f"{path}/tables").agg(F.coalesce(F.sum(widths[F.col("stream")]), F.lit(0)).alias("tables"))
    both = sums.crossJoin(tables)  # two single rows
    both = both.withColumn("raw_bytes", F.col("values") * 8).withColumn("payload_bytes", F.col("streams") + F.col("tables"))
    return both.select("particles", "values", "outliers", "edits", "exact_edits", "raw_bytes", "payload_bytes", (F.col("raw_bytes") / F.col("payload_bytes")).alias("ratio"), (F.col("payload_bytes") * 8 / F.col("values")).alias("bits_per_value"))
