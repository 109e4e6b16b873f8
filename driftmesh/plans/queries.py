"""Registry of the core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmesh.functions import metrics
from driftmesh.operators import codec, domain, edit, grid, pairs
from driftmesh.operators.dense import dense_stats
from driftmesh.operators.sweep import near_and_inside
from driftmesh.plans.sql import GHOSTS, PARTICLES, core_sql
from driftmesh.scratch import Scratch
from driftmesh.sources import adapters, container, raw
from driftmesh.sources.tables import last_arrived, placed_points, run_params, table

from driftmesh.streaming import arrivals

AXES = ("x", "y", "z")


def rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box and number of the usable particles of every run and rank."""
    runs = run_params(spark, sf_dir)
    placed = placed_points(table(spark, sf_dir, "particles"), runs, "particle_id", AXES, keep=("rank_no",))
    stats = dense_stats(placed, "run_id", "rank_no", AXES)
    return stats.select(F.col("run_id").cast("int").alias("run_id"), F.col("rank_no").cast("int").alias("rank_no"), "n", *[f"{m}_{a}" for a in AXES for m in ("min", "max")])


def ghost_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of different ghosts that each rank of each run sent."""
    ghosts = table(spark, sf_dir, "ghost_points").where("ghost_id is not null").select("run_id", "source_rank", "ghost_id").distinct()
    counts = dense_stats(ghosts, "run_id", "source_rank")
    return counts.select(F.col("run_id").cast("int").alias("run_id"), F.col("source_rank").cast("int").alias("rank_no"), F.col("n").alias("n_ghosts"))


def announced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the last announced sizes of the buffers of each source rank."""
    posted = table(spark, sf_dir, "ghost_buffers").where("ghost_count is not null and run_id is not null and source_rank is not null")
    last = last_arrived(posted, ["run_id", "dest_rank", "source_rank"], ["ghost_count"], at="posted_at")
    return last.groupBy("run_id", F.col("source_rank").alias("rank_no")).agg(F.sum("ghost_count").alias("n_announced"))


def p2_rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run and rank the box of its particles, their number and the number of its ghosts."""
    stats, ghosts = rank_stats(spark, sf_dir), ghost_counts(spark, sf_dir)
    return stats.join(ghosts, ["run_id", "rank_no"], "full").select(
        "run_id", "rank_no", F.coalesce("n", F.lit(0)).alias("n_particles"), *[f"{m}_{a}" for a in AXES for m in ("min", "max")], F.coalesce("n_ghosts", F.lit(0)).alias("n_ghosts")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks whose local box or announced ghosts disagree with their rows."""
    stats = rank_stats(spark, sf_dir).join(run_params(spark, sf_dir).select("run_id", "dim"), "run_id")
    local = table(spark, sf_dir, "bounding_boxes").where("box_kind = 'local'").select("run_id", "rank_no", "lo", "hi").distinct()
    same = F.lit(True)
    for k, a in enumerate(AXES):
        fits = F.get("lo", F.lit(k)).eqNullSafe(F.col(f"min_{a}")) & F.get("hi", F.lit(k)).eqNullSafe(F.col(f"max_{a}"))
        same = same & (fits if k < 2 else (fits | (F.col("dim") == 2)))
    bbox = stats.join(local, ["run_id", "rank_no"], "left").where(~same).select("run_id", "rank_no", F.lit("bbox").alias("fault"))
    both = ghost_counts(spark, sf_dir).join(announced_counts(spark, sf_dir), ["run_id", "rank_no"], "full")
    count = both.where(F.coalesce("n_ghosts", F.lit(0)) != F.coalesce("n_announced", F.lit(0))).select("run_id", "rank_no", F.lit("count").alias("fault"))
    return bbox.unionByName(count).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ghost points near each other, and the boxes each of them lies in."""
    runs = run_params(spark, sf_dir)
    points = placed_points(table(spark, sf_dir, "ghost_points"), runs, "ghost_id", ("xx", "yy", "zz")).withColumnRenamed("ghost_id", "id")
    bound = lambda side, k: F.get(side, F.lit(k))
    far = F.lit(float("inf"))
    boxes = (
        table(spark, sf_dir, "bounding_boxes")
        .join(runs.select("run_id", "dim"), "run_id")
        .select(
            "run_id", "box_id", *[bound(s, k).alias(f"{s}_{a}") for k, a in enumerate("xy") for s in ("lo", "hi")],
            F.when(F.col("dim") == 3, bound("lo", 2)).otherwise(-far).alias("lo_z"), F.when(F.col("dim") == 3, bound("hi", 2)).otherwise(far).alias("hi_z"),
        )
        .distinct()
    )
    return near_and_inside(points, boxes)


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable particles of all runs, worked out once: run_id, id, x, y, z, dim, link_len, rank_no."""
    return Scratch(spark, "particles").save(usable(spark, sf_dir), "points")


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable particles of all runs, for queries that read them once."""
    placed = placed_points(table(spark, sf_dir, "particles"), run_params(spark, sf_dir), "particle_id", AXES, keep=("rank_no",))
    return placed.withColumnRenamed("particle_id", "id")


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The particles with their grid cells."""
    points = particles(spark, sf_dir)
    return grid.with_cells(points, grid.saved_params(points))


def visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The particles in visiting order with their codes and reconstruction."""
    return Scratch(spark, "visits").save(codec.coded(celled(spark, sf_dir)), "codes")


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, mode``: the order every run was built in, however it is spelled."""
    kd = F.lower(F.coalesce("order_mode", F.lit(""))).contains("kd")
    return table(spark, sf_dir, "runs").where("run_id is not null").groupBy("run_id").agg(F.max(F.when(kd, "kd").otherwise("morton")).alias("mode"))


def recon_of(codes: DataFrame) -> DataFrame:
    return codes.select("run_id", "id", *[F.col(f"recon_{a}").alias(a) for a in AXES])


def _ints(df: DataFrame, *names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def run_ranges(spark, sf_dir):
    """Extent of every run."""
    return grid.axis_ranges(usable(spark, sf_dir)).drop("dim", "link_len")


def derive_params(spark, sf_dir):
    """Error bound, cell side and grid of every run."""
    p = grid.grid_params(usable(spark, sf_dir))
    return p.select("run_id", "b", "xi", "g", *_ints(p, "cells_x", "cells_y", "cells_z"))


def extent_linking_length(spark, sf_dir):
    """Linking length of every run by its extent and number of points."""
    r = grid.linking_length(grid.axis_ranges(usable(spark, sf_dir)))
    return r.select("run_id", F.round("b_of_extent", 6).alias("b_of_extent"))


def grid_coarsen(spark, sf_dir):
    """Cell side of every run at most four points a cell on average."""
    return grid.coarsened(grid.grid_params(usable(spark, sf_dir))).select("run_id", F.round("g", 6).alias("g"))


def cell_assign(spark, sf_dir):
    """Cell of every particle."""
    return celled(spark, sf_dir).select("run_id", "id", "cx", "cy", "cz", "cell_id")


def cell_histogram(spark, sf_dir):
    """Particles of every occupied cell."""
    return celled(spark, sf_dir).groupBy("run_id", "cell_id").agg(F.count("*").alias("n"))


def cell_decode_coords(spark, sf_dir):
    """Corner and centre of every occupied cell, from its number."""
    points = particles(spark, sf_dir)
    params = grid.saved_params(points)
    cells = grid.with_cells(points, params).select("run_id", "cell_id").distinct().join(params, "run_id")
    return grid.cell_coords(cells).select("run_id", "cell_id", "cx", "cy", "cz", *[f"corner_{a}" for a in AXES], *[f"centre_{a}" for a in AXES])


def cell_offsets(spark, sf_dir):
    """Number of particles before each occupied cell in raster order."""
    counts = cell_histogram(spark, sf_dir)
    return grid.prefix_sum(counts, ["run_id"], "cell_id", "n", "start").select("run_id", "cell_id", "n", "start")


def cell_gap_runs(spark, sf_dir):
    """Empty cells between each occupied cell and the one before it in raster order."""
    return grid.cell_gaps(celled(spark, sf_dir).select("run_id", "cell_id").distinct())


def trailing_gaps(spark, sf_dir):
    """Empty cells behind the last occupied cell of every run."""
    points = particles(spark, sf_dir)
    params = grid.saved_params(points)
    return grid.trailing_gaps(grid.with_cells(points, params), params)


def morton_code(spark, sf_dir):
    """Morton code of every particle within its cell."""
    cells = celled(spark, sf_dir)
    return cells.select("run_id", "id", "cell_id", grid.morton(cells).alias("morton"))


def visit_order(spark, sf_dir):
    """Place of every particle in its cell's and its run's visiting order."""
    return grid.visit_order(celled(spark, sf_dir)).select("run_id", "id", "cell_id", "seq", "visit_pos")


def kd_order(spark, sf_dir):
    """Greedy nearest-neighbour order of the particles of every cell, each next one nearest to the last one's reconstruction."""
    return codec.followed(celled(spark, sf_dir).withColumn("mode", F.lit("kd"))).select("run_id", "cell_id", "seq", "id")


def kd_codes(spark, sf_dir):
    """Quantisation codes of the runs built in greedy order, and their places in it."""
    built = celled(spark, sf_dir).join(modes(spark, sf_dir).where("mode = 'kd'"), "run_id")
    return codec.coded(built).select("run_id", "id", "seq", "visit_pos", "code_x", "code_y", "code_z")


def outlier_roundtrip(spark, sf_dir):
    """Outliers of every run and axis under a bound so tight that codes overflow, and particles that decoding puts off by more than the bound."""
    points = particles(spark, sf_dir)
    q = Scratch(spark, "tight").save(codec.coded(grid.with_cells(points, grid.saved_params(points, TIGHT))), "codes")
    back = codec.decoded(q.drop(*[f"recon_{a}" for a in AXES]).select("*", *[F.when(F.col(f"outlier_{a}") == 1, F.col(a)).alias(f"exact_{a}") for a in AXES]))
    off = F.greatest(*[F.abs(F.col(a) - F.col(f"recon_{a}")) for a in AXES]) > F.col("xi") * (1 + 1e-6)
    return back.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(off).alias("violations"), *[F.coalesce(F.sum(f"outlier_{a}"), F.lit(0)).alias(f"outliers_{a}") for a in AXES])


#: Error bound, as a share of the linking length, under which many codes overflow.
TIGHT = 2e-6


def quantize_codes(spark, sf_dir):
    """Quantisation codes of every particle."""
    return visited(spark, sf_dir).select("run_id", "id", "code_x", "code_y", "code_z")


def quantize_recon(spark, sf_dir):
    """Reconstruction of every particle, rounded."""
    return visited(spark, sf_dir).select("run_id", "id", *[F.round(F.col(f"recon_{a}"), 6).alias(f"recon_{a}") for a in AXES])


def outlier_flags(spark, sf_dir):
    """Outliers of every run and axis."""
    q = visited(spark, sf_dir)
    return q.groupBy("run_id").agg(*[F.coalesce(F.sum(f"outlier_{a}"), F.lit(0)).alias(f"outliers_{a}") for a in AXES])


def decode_recon(spark, sf_dir):
    """Reconstruction from the codes alone, rounded."""
    codes = visited(spark, sf_dir).select("run_id", "cell_id", "seq", "id", "dim", "xi", "ox", "oy", "oz", "code_x", "code_y", "code_z")
    return codec.decoded(codes).select("run_id", "id", *[F.round(F.col(f"recon_{a}"), 6).alias(f"recon_{a}") for a in AXES])


def roundtrip_check(spark, sf_dir):
    """Particles of every run, and those whose decoded place is off by more than the error bound."""
    q = visited(spark, sf_dir)
    back = codec.decoded(q.select("run_id", "cell_id", "seq", "id", "dim", "xi", "ox", "oy", "oz", "code_x", "code_y", "code_z"))
    both = q.select("run_id", "id", *AXES).join(back.select("run_id", "id", "xi", "recon_x", "recon_y", "recon_z"), ["run_id", "id"])
    off = F.greatest(*[F.abs(F.col(a) - F.col(f"recon_{a}")) for a in AXES]) > F.col("xi") * (1 + 1e-9)
    return both.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(off).alias("violations"))


def fof_links(spark, sf_dir):
    """Pairs of particles within the linking length."""
    return pairs.links(usable(spark, sf_dir))


def fof_clusters(spark, sf_dir):
    """Friends-of-friends cluster of every linked particle."""
    return pairs.fof(usable(spark, sf_dir))


def halo_catalog(spark, sf_dir):
    """Size, centre and extent of every cluster."""
    points = particles(spark, sf_dir)
    found = pairs.fof(points)
    members = points.join(found, ["run_id", "id"])
    return members.groupBy("run_id", "cluster_id").agg(F.count("*").alias("size"), *[F.round(F.avg(a), 6).alias(f"mean_{a}") for a in AXES], *[f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))])


def halo_size_hist(spark, sf_dir):
    """Clusters of every size."""
    return fof_clusters(spark, sf_dir).groupBy("run_id", "cluster_id").count().groupBy("run_id", F.col("count").alias("size")).agg(F.count("*").alias("clusters"))


def halo_topk(spark, sf_dir):
    """The ten largest clusters of every run."""
    sizes = fof_clusters(spark, sf_dir).groupBy("run_id", "cluster_id").agg(F.count("*").alias("size"))
    place = Window.partitionBy("run_id").orderBy(F.desc("size"), "cluster_id")
    return sizes.withColumn("place", F.row_number().over(place).cast("long")).where("place <= 10")


def _vulnerable(spark, sf_dir):
    points = particles(spark, sf_dir)
    return pairs.vulnerable_pairs(points, grid.saved_params(points))


def vulnerable_pairs(spark, sf_dir):
    """Pairs whose link a reconstruction may flip."""
    return _vulnerable(spark, sf_dir).select("run_id", "i", "j", "sign")


def editable_points(spark, sf_dir):
    """Particles of at least one vulnerable pair."""
    return pairs.editable_points(_vulnerable(spark, sf_dir))


def pair_summary(spark, sf_dir):
    """Vulnerable pairs of every run, by what they must stay."""
    return _vulnerable(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("pairs"), F.sum("sign").alias("apart"))


def _vulnerable_of(q):
    """Vulnerable pairs of coded particles, which know their run's parameters."""
    params = Scratch(q.sparkSession, "params").save(q.groupBy("run_id").agg(*[F.first(c).alias(c) for c in ("dim", "b", "xi")]), "params")
    return pairs.vulnerable_pairs(q, params)


def _measured(spark, sf_dir):
    q = visited(spark, sf_dir)
    vp = Scratch(spark, "pairs").save(_vulnerable_of(q).drop("d2"), "pairs")
    return q, vp, pairs.with_distance(vp, recon_of(q))


def violated_pairs(spark, sf_dir):
    """Vulnerable pairs whose link the reconstruction flips."""
    _, _, measured = _measured(spark, sf_dir)
    return measured.where((F.col("r2") > F.col("b") * F.col("b")).cast("long") != F.col("sign")).select("run_id", "i", "j", "sign")


def link_confusion(spark, sf_dir):
    """Vulnerable pairs by what they must be and what the reconstruction makes of them, and Matthews correlation."""
    _, _, measured = _measured(spark, sf_dir)
    return metrics.matthews(pairs.link_confusion(measured)).withColumn("mcc", F.round("mcc", 6))


def _two_clusterings(spark, sf_dir, recon=None):
    """Contingency of the clusters of the particles and of a reconstruction, by default the unedited one."""
    q = visited(spark, sf_dir)
    points = q.select("run_id", "id", *AXES, "dim", F.col("b").alias("link_len"))
    other = (recon or (lambda q: recon_of(q)))(q).select("run_id", "id", *AXES).join(points.select("run_id", "id", "dim", "link_len"), ["run_id", "id"])
    one, two = pairs.clusters(points), pairs.clusters(other)
    return metrics.contingency(one, two)


def contingency(spark, sf_dir):
    """Particles that each pair of original and reconstructed clusters shares, where either has more than one."""
    return _two_clusterings(spark, sf_dir).select("run_id", F.col("one").alias("cluster_id"), F.col("other").alias("recon_cluster_id"), "n")


def pair_confusion(spark, sf_dir):
    """Pairs of particles together in both clusterings, in one or in none, with the adjusted Rand index."""
    return metrics.adjusted_rand(metrics.pair_confusion(_two_clusterings(spark, sf_dir))).withColumn("ari", F.round("ari", 9))


#: Particles of a run beyond which the Rand index may be taken over a sample, and of the sample.
SAMPLE_FROM, SAMPLE = 500_000, 100_000


def sampled(points, most=SAMPLE, beyond=SAMPLE_FROM):
    """The points of every run, but of runs with more than ``beyond`` about ``most``, drawn by the hash of their id.

    The share of each run is fixed beforehand, so no run is ordered.
    """
    sizes = points.groupBy("run_id").agg(F.count("*").alias("_n"))
    level = F.when(F.col("_n") > beyond, most / F.col("_n")).otherwise(1.0)
    drawn = (F.pmod(F.xxhash64("id", F.lit(42)), F.lit(1 << 30)) / (1 << 30)) < level
    return points.join(sizes, "run_id").where(drawn).drop("_n")


def ari_sampled(spark, sf_dir):
    """Adjusted Rand index, of runs with more than SAMPLE_FROM particles over a sample."""
    some = sampled(visited(spark, sf_dir))
    points = some.select("run_id", "id", *AXES, "dim", F.col("b").alias("link_len"))
    other = recon_of(some).join(points.select("run_id", "id", "dim", "link_len"), ["run_id", "id"])
    one, two = pairs.clusters(points), pairs.clusters(other)
    return metrics.adjusted_rand(metrics.pair_confusion(metrics.contingency(one, two))).withColumn("ari", F.round("ari", 9))


def error_stats(spark, sf_dir):
    """Errors of the reconstruction, rounded."""
    q = visited(spark, sf_dir)
    points = q.select("run_id", "id", *AXES, "dim", F.col("b").alias("link_len"))
    e = metrics.error_stats(points, recon_of(q), grid.axis_ranges(points))
    return e.select("run_id", "n", *[F.round(c, 6).alias(c) for c in ("max_error", "mse", "rmse", "nrmse", "psnr")])


def auto_xi(spark, sf_dir):
    """Error bound that the reconstruction keeps, from its largest error."""
    q = visited(spark, sf_dir)
    return q.groupBy("run_id").agg(F.round(F.max(F.greatest(*[F.abs(F.col(a) - F.col(f"recon_{a}")) for a in AXES])), 9).alias("xi"))


def _pgd_terms(spark, sf_dir):
    _, _, measured = _measured(spark, sf_dir)
    tol = 2 * F.col("xi") / 65535 * 2 * F.sqrt(F.col("dim").cast("double"))
    return measured.withColumn("d", F.sqrt("r2")).withColumn("tol", tol)


def pgd_loss0(spark, sf_dir):
    """Loss of the unedited reconstruction."""
    t = _pgd_terms(spark, sf_dir)
    over = F.when((F.col("sign") == 1) & (F.col("d") <= F.col("b") + F.col("tol")), F.col("d") - (F.col("b") + F.col("tol"))).when((F.col("sign") == 0) & (F.col("d") > F.col("b") - F.col("tol")), F.col("d") - (F.col("b") - F.col("tol"))).otherwise(F.lit(0.0))
    return t.groupBy("run_id").agg(F.round(F.sum(over * over), 6).alias("loss"))


def pgd_gradient0(spark, sf_dir):
    """Gradient of every editable particle at the unedited reconstruction, where it isn't zero."""
    t = _pgd_terms(spark, sf_dir).where((F.col("d") >= F.col("tol")) & (F.col("sign") == (F.col("d") <= F.col("b")).cast("long")))
    pull = 2 * (F.col("d") - F.col("b")) / F.col("d")
    ends = F.explode(F.array(F.struct(F.col("i").alias("id"), F.lit(1.0).alias("way")), F.struct(F.col("j").alias("id"), F.lit(-1.0).alias("way"))))
    e = t.select("run_id", pull.alias("pull"), "dx", "dy", "dz", ends.alias("e"))
    return e.groupBy("run_id", "e.id").agg(*[F.round(F.sum(F.col("e.way") * F.col("pull") * F.col(f"d{a}")) + 0.0, 6).alias(f"grad_{a}") for a in AXES])


def pgd_edit(spark, sf_dir):
    """Vulnerable pairs of every run before and after gradient edits, and how many are violated."""
    q, vp, _ = _measured(spark, sf_dir)
    edited = edit.gradient_edit(recon_of(q), q.select("run_id", "id", *AXES), vp)
    both = edited.join(recon_of(q).select("run_id", "id", *[F.col(a).alias(f"r{a}") for a in AXES]), ["run_id", "id"])
    both = vp.join(_ends(both, "i"), ["run_id", "i"]).join(_ends(both, "j"), ["run_id", "j"])
    far = lambda r: sum((d * d for d in (F.col(f"i_{r}{a}") - F.col(f"j_{r}{a}") for a in AXES)), F.lit(0.0)) > F.col("b") * F.col("b")
    count = lambda r, name: [F.count("*").alias(f"pairs_{name}"), F.count_if(far(r).cast("long") != F.col("sign")).alias(f"violated_{name}")]
    return both.groupBy("run_id").agg(*count("r", "before"), *count("", "after"))


def _ends(places: DataFrame, end: str) -> DataFrame:
    """The places of pairs' ends, before (r) and after the edits."""
    return places.select("run_id", F.col("id").alias(end), *[F.col(f"{r}{a}").alias(f"{end}_{r}{a}") for r in ("", "r") for a in AXES])


def lossless_edit(spark, sf_dir):
    """The reconstruction with exact vulnerable particles, rounded."""
    q, vp, _ = _measured(spark, sf_dir)
    out = edit.exact_edit(recon_of(q), q.select("run_id", "id", *AXES), vp)
    return out.select("run_id", "id", "edited", *[F.round(a, 6).alias(a) for a in AXES])


def lossless_edit_ari(spark, sf_dir):
    """Adjusted Rand index after exact edits: 1 for every run."""
    exact = lambda q: edit.exact_edit(recon_of(q), q.select("run_id", "id", *AXES), _vulnerable_of(q))
    return metrics.adjusted_rand(metrics.pair_confusion(_two_clusterings(spark, sf_dir, exact))).select("run_id", F.round("ari", 9).alias("ari"))


def symbol_freq(spark, sf_dir):
    """How often each quantisation code occurs."""
    return codec.symbol_counts(codec.code_rows(visited(spark, sf_dir)))


def huffman_code_lengths(spark, sf_dir):
    """Every code's frequency and length of its Huffman code."""
    counts = Scratch(spark, "symbols").save(symbol_freq(spark, sf_dir), "counts")
    lengths = spark.createDataFrame([(int(s), n) for s, (_, n) in codec.code_table(counts).items()], "symbol long, length int")
    return counts.join(lengths, "symbol").select("symbol", "freq", "length")


def huffman_bits(spark, sf_dir):
    """Codes of all runs, their bits as packed, and distinct symbols."""
    codes = Scratch(spark, "codes").save(codec.code_rows(visited(spark, sf_dir)), "codes")
    counts = Scratch(spark, "symbols").save(codec.symbol_counts(codes), "counts")
    blocks = codec.pack_codes(codes, codec.code_table(counts))
    return blocks.agg(F.sum("n").alias("codes"), F.sum("n_bits").alias("bits")).crossJoin(counts.agg(F.count("*").alias("symbols")))  # two single rows


def entropy_roundtrip(spark, sf_dir):
    """Codes of every run and how many come out of coding and decoding changed."""
    codes = Scratch(spark, "codes").save(codec.code_rows(visited(spark, sf_dir)), "codes")
    tab = codec.code_table(codec.symbol_counts(codes))
    back = codec.unpack_codes(codec.pack_codes(codes, tab), tab).select("run_id", "pos", F.col("code").alias("back"))
    both = codes.join(back, ["run_id", "pos"], "full")
    return both.groupBy("run_id").agg(F.count("*").alias("codes"), F.count_if(~F.col("code").eqNullSafe(F.col("back"))).alias("changed"))


def _edit_mask(spark, sf_dir):
    q, vp, _ = _measured(spark, sf_dir)
    mark = pairs.editable_points(vp).withColumn("flag", F.lit(1))
    return q.select("run_id", "id", "visit_pos").join(mark, ["run_id", "id"], "left").select("run_id", F.col("visit_pos").alias("pos"), F.coalesce("flag", F.lit(0)).alias("flag"))


def pack_flags(spark, sf_dir):
    """The mask of editable particles in visiting order, packed into bytes."""
    return codec.packed_bits(_edit_mask(spark, sf_dir), ["run_id"], "pos", "flag").select("run_id", "byte_no", F.col("byte").cast("long").alias("byte"))


def unpack_flags(spark, sf_dir):
    """Bits of the packed mask, set and in all, of every run."""
    bits = codec.unpacked_bits(codec.packed_bits(_edit_mask(spark, sf_dir), ["run_id"], "pos", "flag"), ["run_id"])
    return bits.groupBy("run_id").agg(F.count("*").alias("bits"), F.sum("flag").alias("set_bits"))


def _contained(spark, sf_dir, **how) -> tuple[DataFrame, DataFrame, str]:
    """Particles, what comes out of a container of them, and the container's path."""
    points = particles(spark, sf_dir)
    path = Scratch(spark, "container").path("runs")
    container.compress(points, path, **how)
    return points, container.decompress(spark, path), path


def _compared(points, back):
    """Per run the particles, those off by more than the error bound (and the rounding of an edit), the edited ones and those of them that are exact."""
    both = points.join(back.select("run_id", "id", "edited", *[F.col(a).alias(f"r{a}") for a in AXES]), ["run_id", "id"], "left")
    most = F.greatest(*[F.abs(F.col(a) - F.col(f"r{a}")) for a in AXES])
    off = most > F.col("link_len") * grid.XI_SHARE * (1 + 4 / edit.LEVELS + 1e-9)
    return both.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(off | F.col("rx").isNull()).alias("violations"), F.count_if("edited").alias("edited"), F.count_if(F.col("edited") & (most == 0)).alias("exact"))


def container_edit_roundtrip(spark, sf_dir):
    """Compressing with gradient edits and decompressing: particles, particles off, edited particles."""
    points, back, _ = _contained(spark, sf_dir, modes=modes(spark, sf_dir), how="gradient", steps=50)
    return _compared(points, back).drop("exact")


def container_lossless_roundtrip(spark, sf_dir):
    """Compressing with exact values of vulnerable particles and decompressing: particles, particles off, edited and exact ones."""
    points, back, _ = _contained(spark, sf_dir, how="exact")
    return _compared(points, back)


def edit_only_roundtrip(spark, sf_dir):
    """A container of exact edits alone, applied to the base it was made for: particles, particles off, edited and exact ones."""
    q = visited(spark, sf_dir)
    points, base = q.select("run_id", "id", *AXES, "dim", F.col("b").alias("link_len")), recon_of(q)
    path = Scratch(spark, "container").path("edits")
    container.compress_edits(points, base, path, grid.XI_SHARE, how="exact")
    return _compared(points, container.decompress(spark, path, base))


def size_accounting(spark, sf_dir):
    """Particles, values, outliers, exact edits and raw bytes of a container, and whether it takes less than the raw values."""
    _, _, path = _contained(spark, sf_dir, how="exact")
    r = container.size_report(spark, path)
    return r.select("particles", "values", "outliers", "exact_edits", "raw_bytes", (F.col("payload_bytes") < F.col("raw_bytes")).alias("smaller"))


def _widths(points: DataFrame) -> DataFrame:
    return grid.grid_params(points).select("run_id", F.col("g").alias("width"))


def bbox_by_block(spark, sf_dir):
    """Box of every rank of every run."""
    return domain.rank_boxes(particles(spark, sf_dir))


def neighbor_blocks(spark, sf_dir):
    """Ranks whose boxes meet within the ghost width."""
    points = particles(spark, sf_dir)
    return domain.neighbour_ranks(domain.rank_boxes(points), _widths(points))


def ghost_rows(spark, sf_dir):
    """Particles that other ranks need as ghosts."""
    points = particles(spark, sf_dir)
    return domain.ghosts(points, domain.rank_boxes(points), _widths(points))


def extended_block(spark, sf_dir):
    """Own and ghost particles of every rank."""
    points = particles(spark, sf_dir)
    ghosts = domain.ghosts(points, domain.rank_boxes(points), _widths(points)).select("run_id", F.col("dest_rank").alias("rank_no"), "id", F.lit(1).alias("ghost"))
    both = points.where("rank_no is not null").select("run_id", "rank_no", "id", F.lit(0).alias("ghost")).unionByName(ghosts)
    return both.groupBy("run_id", "rank_no").agg(F.count_if(F.col("ghost") == 0).alias("own"), F.count_if(F.col("ghost") == 1).alias("ghosts"))


def axis_islands(spark, sf_dir):
    """Stretches of every axis without a gap wider than the ghost width."""
    points = particles(spark, sf_dir)
    return domain.islands(domain.axis_islands(points, _widths(points)))


def occupied_boxes(spark, sf_dir):
    """Products of axis islands that hold particles."""
    points = particles(spark, sf_dir)
    return domain.occupied_boxes(points, domain.axis_islands(points, _widths(points)), _widths(points)).drop("lo_z", "hi_z")


def _scan(points: DataFrame) -> DataFrame:
    return points.select("id", *[F.round(a, 6).alias(a) for a in AXES])


def particle_scan_orders2d(spark, sf_dir):
    """Orders as particles."""
    return _scan(adapters.orders2d(spark, sf_dir))


def particle_scan_events2d(spark, sf_dir):
    """Events as particles."""
    return _scan(adapters.events2d(spark, sf_dir))


def particle_scan_lineitem3d(spark, sf_dir):
    """Line items as particles."""
    return _scan(adapters.lineitem3d(spark, sf_dir))


def particle_scan_emb3d(spark, sf_dir):
    """Embeddings as particles."""
    return _scan(adapters.emb3d(spark, sf_dir))


def _clusters_of(points: DataFrame) -> DataFrame:
    return pairs.fof(points).select("id", "cluster_id")


def fof_clusters_orders2d(spark, sf_dir):
    """Friends-of-friends clusters of orders."""
    return _clusters_of(adapters.orders2d(spark, sf_dir))


def fof_clusters_events2d(spark, sf_dir):
    """Friends-of-friends clusters of events."""
    return _clusters_of(adapters.events2d(spark, sf_dir))


def fof_clusters_lineitem3d(spark, sf_dir):
    """Friends-of-friends clusters of line items."""
    return _clusters_of(adapters.lineitem3d(spark, sf_dir))


def pairs_lineitem3d(spark, sf_dir):
    """Vulnerable pairs of line items, with sign."""
    points = Scratch(spark, "adapted").save(adapters.lineitem3d(spark, sf_dir), "points")
    return pairs.vulnerable_pairs(points, grid.saved_params(points)).select("i", "j", "sign")


def fof_clusters_emb3d(spark, sf_dir):
    """Friends-of-friends clusters of embeddings."""
    return _clusters_of(adapters.emb3d(spark, sf_dir))


def raw_roundtrip(spark, sf_dir):
    """Number and extent of the particles of three axes after writing and reading raw coordinate files."""
    raw.register(spark)
    scratch = Scratch(spark, "raw")
    path = scratch.path("points")
    particles(spark, sf_dir).where("dim = 3").select(*AXES).write.format("raw_points").mode("append").options(path=path, dim="3").save()
    back = spark.read.format("raw_points").options(path=path, dim="3").load()
    return back.agg(F.count("*").alias("n"), *[f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))])


def container_roundtrip(spark, sf_dir):
    """Particles of every run and how many are off by more than the error bound after compressing and decompressing."""
    points = particles(spark, sf_dir)
    path = Scratch(spark, "container").path("runs")
    container.compress(points, path)
    back = container.decompress(spark, path).select("run_id", "id", *[F.col(a).alias(f"r{a}") for a in AXES])
    both = points.join(back, ["run_id", "id"], "left")
    off = F.greatest(*[F.abs(F.col(a) - F.col(f"r{a}")) for a in AXES]) > F.col("link_len") * grid.XI_SHARE * (1 + 1e-9)
    return both.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(off | F.col("rx").isNull()).alias("violations"))


def arrival_windows(spark, sf_dir):
    """Usable particle rows per run and ten minutes of arrival, by a stream over the table's files."""
    path = f"{sf_dir}/particles.parquet"
    scratch = Scratch(spark, "arrivals")
    stream = arrivals.windowed_counts(arrivals.arrivals(spark, path, spark.read.parquet(path).schema))
    arrivals.run_once(stream, scratch.path("out"), scratch.path("state"))
    out = arrivals.latest(spark.read.parquet(scratch.path("out")))
    return out.select("run_id", F.unix_timestamp("start").alias("start"), "n", "min_x", "max_x")


_QUERIES = (
    particle_scan_orders2d, particle_scan_events2d, particle_scan_emb3d, particle_scan_lineitem3d, fof_clusters_lineitem3d, pairs_lineitem3d, fof_clusters_orders2d, fof_clusters_events2d, fof_clusters_emb3d, raw_roundtrip, container_roundtrip, container_edit_roundtrip, container_lossless_roundtrip, edit_only_roundtrip, arrival_windows,
    p2_found, p2_rank_stats, p3_found, run_ranges, derive_params, extent_linking_length, grid_coarsen, cell_assign, cell_histogram, cell_decode_coords,
    cell_offsets, cell_gap_runs, trailing_gaps, morton_code, visit_order, kd_order, kd_codes, outlier_roundtrip, quantize_codes, quantize_recon, outlier_flags, decode_recon, roundtrip_check,
    fof_links, fof_clusters, halo_catalog, halo_size_hist, halo_topk, vulnerable_pairs, editable_points, pair_summary, violated_pairs, link_confusion,
    contingency, pair_confusion, ari_sampled, error_stats, auto_xi, pgd_loss0, pgd_gradient0, pgd_edit, lossless_edit, lossless_edit_ari, symbol_freq,
    huffman_code_lengths, huffman_bits, entropy_roundtrip, pack_flags, unpack_flags, size_accounting, bbox_by_block, neighbor_blocks, ghost_rows,
    extended_block, axis_islands, occupied_boxes,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_COUNTS_SQL = """
ghost_n AS (SELECT run_id, source_rank AS rank_no, count(DISTINCT ghost_id) AS n FROM ghost_points WHERE ghost_id IS NOT NULL AND source_rank IS NOT NULL AND run_id IS NOT NULL GROUP BY 1, 2)"""

_BOX_SQL = """
stat AS (SELECT run_id, rank_no, any_value(dim) AS dim, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z
         FROM part_rows WHERE rank_no IS NOT NULL GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return core_sql() | {
        "p2_found": f"""
WITH {PARTICLES}, {_BOX_SQL}, {_COUNTS_SQL},
said AS (
  SELECT run_id, source_rank AS rank_no, sum(ghost_count) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, dest_rank, source_rank ORDER BY posted_at DESC NULLS LAST, ghost_count DESC) AS k
    FROM ghost_buffers WHERE ghost_count IS NOT NULL AND source_rank IS NOT NULL AND run_id IS NOT NULL) WHERE k = 1 GROUP BY 1, 2)
SELECT DISTINCT s.run_id, s.rank_no, 'bbox' AS fault FROM stat s LEFT JOIN (SELECT DISTINCT run_id, rank_no, lo, hi FROM bounding_boxes WHERE box_kind = 'local') b
  ON s.run_id = b.run_id AND s.rank_no = b.rank_no
WHERE b.lo[1] IS DISTINCT FROM min_x OR b.hi[1] IS DISTINCT FROM max_x OR b.lo[2] IS DISTINCT FROM min_y OR b.hi[2] IS DISTINCT FROM max_y
   OR (s.dim = 3 AND (b.lo[3] IS DISTINCT FROM min_z OR b.hi[3] IS DISTINCT FROM max_z))
UNION ALL
SELECT coalesce(g.run_id, a.run_id) AS run_id, coalesce(g.rank_no, a.rank_no) AS rank_no, 'count' AS fault
FROM ghost_n g FULL JOIN said a ON g.run_id = a.run_id AND g.rank_no = a.rank_no WHERE coalesce(g.n, 0) <> coalesce(a.n, 0)""",
        "p2_rank_stats": f"""
WITH {PARTICLES}, {_BOX_SQL}, {_COUNTS_SQL}
SELECT coalesce(s.run_id, g.run_id) AS run_id, coalesce(s.rank_no, g.rank_no) AS rank_no, coalesce(s.n, 0) AS n_particles,
       min_x, max_x, min_y, max_y, min_z, max_z, coalesce(g.n, 0) AS n_ghosts
FROM stat s FULL JOIN ghost_n g ON s.run_id = g.run_id AND s.rank_no = g.rank_no""",
        "p3_found": f"""
WITH {GHOSTS},
cell AS (SELECT *, floor(x / link_len) AS cx, floor(y / link_len) AS cy FROM ghost_rows),
moved AS (SELECT c.*, c.cx + i AS jx, c.cy + j AS jy FROM cell c, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j)),
box AS (SELECT DISTINCT b.box_id, b.run_id, b.lo, b.hi, r.dim FROM bounding_boxes b JOIN runs r ON b.run_id = r.run_id)
SELECT 'near' AS rel, a.id AS left_id, b.id AS right_id
FROM moved a JOIN cell b ON a.run_id = b.run_id AND a.jx = b.cx AND a.jy = b.cy
WHERE a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= a.link_len * a.link_len
UNION ALL
SELECT 'inside' AS rel, p.id AS left_id, b.box_id AS right_id FROM ghost_rows p JOIN box b ON p.run_id = b.run_id
WHERE p.x BETWEEN b.lo[1] AND b.hi[1] AND p.y BETWEEN b.lo[2] AND b.hi[2] AND (b.dim = 2 OR p.z BETWEEN b.lo[3] AND b.hi[3])""",
    }
