"""spark-submit entry: compress, edit, decompress, clusters, score.

    spark-submit driftmesh/cli.py compress --points IN --out DIR [--xi 0.05] [--bound link|rel|abs] [--d 0.2] [--order morton|kd] [--edit none|exact|gradient]
    spark-submit driftmesh/cli.py edit --points IN --recon IN --out DIR [--xi 0.05] [--bound link|rel|abs] [--edit exact|gradient]
    spark-submit driftmesh/cli.py decompress --container DIR --out DIR [--recon IN]
    spark-submit driftmesh/cli.py clusters --points IN --out DIR
    spark-submit driftmesh/cli.py score --points IN --recon IN --out DIR [--edit none|exact|gradient]

Points are Parquet: run_id, id, x, y, z, dim, link_len; a reconstruction needs
run_id, id, x, y, z.  With ``--raw 2|3`` points and reconstructions are raw
coordinate files, and what is decompressed is written as one file an axis.
``edit`` writes the edits that a foreign reconstruction needs, by default
within its own largest error; ``decompress --recon`` applies them.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.functions import metrics
from driftmesh.operators import edit, grid, pairs
from driftmesh.sources import container, raw


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="driftmesh", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("what", choices=("compress", "edit", "decompress", "clusters", "score"))
    p.add_argument("--points")
    p.add_argument("--recon")
    p.add_argument("--container")
    p.add_argument("--out", required=True)
    p.add_argument("--xi", type=float, help=f"error bound (default {grid.XI_SHARE}; for edit the largest error of the reconstruction)")
    p.add_argument("--bound", choices=("link", "rel", "abs"), default="link", help="xi is a share of the linking length, a share of the smallest range, or absolute")
    p.add_argument("--d", type=float, help="linking length as a share of the mean distance, instead of the column link_len")
    p.add_argument("--order", choices=("morton", "kd"), default="morton")
    p.add_argument("--edit", choices=("none", "exact", "gradient"))
    p.add_argument("--lr", type=float, default=0.01)
    p.add_argument("--iter", type=int, default=1000)
    p.add_argument("--raw", type=int, choices=(2, 3), help="read and write raw files of so many axes")
    p.add_argument("--dtype", choices=tuple(raw.DTYPES), default="f64")
    a = p.parse_args(argv)
    need = {"compress": ["points"], "edit": ["points", "recon"], "decompress": ["container"], "clusters": ["points"], "score": ["points", "recon"]}[a.what]
    if missing := [n for n in need if not getattr(a, n)]:
        p.error(f"{a.what} needs --{' and --'.join(missing)}")
    if a.xi is not None and not a.xi > 0:
        p.error("the error bound must be positive")
    if a.raw and a.d is None and a.what != "decompress":
        p.error("raw files have no linking length: give --d")
    if a.what == "edit" and a.edit == "none":
        p.error("edit needs exact or gradient")
    return a


def score(points: DataFrame, recon: DataFrame, how: str = "none", xi: float = grid.XI_SHARE, lr: float = 0.01, steps: int = 1000) -> DataFrame:
    """Adjusted Rand index and errors of a reconstruction, after repairing it if asked; the reconstruction may come from anywhere."""
    vulnerable = pairs.vulnerable_pairs(points, grid.saved_params(points, xi))
    if how == "exact":
        recon = edit.exact_edit(recon, points, vulnerable)
    elif how == "gradient":
        recon = edit.gradient_edit(recon, points, vulnerable, lr, steps)
    other = recon.select("run_id", "id", "x", "y", "z").join(points.select("run_id", "id", "dim", "link_len"), ["run_id", "id"])
    ari = metrics.adjusted_rand(metrics.pair_confusion(metrics.contingency(pairs.clusters(points), pairs.clusters(other)))).select("run_id", "tp", "fp", "fn", "tn", "ari")
    return ari.join(metrics.error_stats(points, recon, grid.axis_ranges(points)), "run_id")


def read(spark: SparkSession, path: str, a: argparse.Namespace) -> DataFrame:
    """Points of a Parquet table, or of raw files as one run."""
    if not a.raw:
        return spark.read.parquet(path)
    raw.register(spark)
    rows = spark.read.format("raw_points").options(path=path, dim=str(a.raw), dtype=a.dtype).load()
    points = rows.select(F.lit(0).alias("run_id"), F.col("idx").alias("id"), "x", "y", (F.col("z") if a.raw == 3 else F.lit(0.0)).alias("z"), F.lit(a.raw).alias("dim"), F.lit(None).cast("double").alias("link_len"))
    return grid.with_linking_length(points, a.d) if a.d is not None else points


def main(argv: list[str] | None = None) -> None:
    a = parse(argv)
    began = time.time()
    spark = SparkSession.builder.appName("driftmesh").getOrCreate()
    load = lambda path: read(spark, path, a)
    d = None if a.raw else a.d  # raw points got their linking length as they were read
    if a.what == "compress":
        points = load(a.points)
        modes = points.select("run_id").distinct().withColumn("mode", F.lit(a.order))
        container.compress(points, a.out, a.xi or grid.XI_SHARE, a.bound, d, modes, a.edit or "gradient", a.lr, a.iter)
    elif a.what == "edit":
        container.compress_edits(load(a.points), load(a.recon), a.out, a.xi, a.bound, d, a.edit or "gradient", a.lr, a.iter)
    elif a.what == "decompress":
        back = container.decompress(spark, a.container, load(a.recon) if a.recon else None)
        if a.raw:
            raw.register(spark)
            back.write.format("raw_points").mode("append").options(path=a.out, dim=str(a.raw), dtype=a.dtype, layout="axes").save()
        else:
            back.write.parquet(a.out)
    elif a.what == "clusters":
        pairs.clusters(load(a.points)).write.parquet(a.out)
    else:
        score(load(a.points), load(a.recon), a.edit or "none", a.xi or grid.XI_SHARE, a.lr, a.iter).write.parquet(a.out)
    if a.what in ("compress", "edit"):
        container.size_report(spark, a.out).show(truncate=False)
    print(f"{a.what}: {time.time() - began:.1f} s")


if __name__ == "__main__":
    main()
