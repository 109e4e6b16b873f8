"""Core operators on small fixtures, golden values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmesh.functions import metrics
from driftmesh.operators import codec, domain, edit, grid, pairs
from driftmesh.operators.components import components, contracted
from driftmesh.operators.dense import dense_stats
from driftmesh.operators.sweep import _Tiles, friends, near_and_inside, near_pairs
from driftmesh.sources import container, raw
from driftmesh.sources.tables import last_arrived, placed_points

POINT = "run_id int, id long, x double, y double, z double, dim int, link_len double"


def cloud(spark, n=300, dim=3, link=1.0, seed=1, side=8.0, run=1):
    rng = np.random.default_rng(seed)
    rows = [(run, i, *(np.round(rng.uniform(0, side, 3) * 1024) / 1024).tolist(), dim, link) for i in range(n)]
    if dim == 2:
        rows = [(r, i, x, y, 0.0, d, b) for r, i, x, y, _, d, b in rows]
    return spark.createDataFrame(rows, POINT), rows


def brute_links(rows, link):
    out = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) <= link * link:
                out.add((a[1], b[1]))
    return out


def roots(links):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(parent)}


# --- dense accumulators (problem 2)


def test_dense_stats_equals_group_by_with_a_hot_key(spark):
    rows = [(1, 5 if i % 3 else i, float(i), None if i % 7 == 0 else float(-i)) for i in range(3000)] + [(None, 1, 1.0, 1.0), (1, None, 1.0, 1.0), (2, -300, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "g int, k int, v double, w double").repartition(4)
    got = {(r.g, r.k): (r.n, r.min_v, r.max_v, r.min_w, r.max_w) for r in dense_stats(df, "g", "k", ("v", "w")).collect()}
    want = {}
    for g, k, v, w in rows:
        if g is not None and k is not None:
            want.setdefault((g, k), []).append((v, w))
    assert set(got) == set(want)
    for key, vals in want.items():
        vs, ws = [v for v, _ in vals if v is not None and not math.isnan(v)], [w for _, w in vals if w is not None]
        assert got[key] == (len(vals), min(vs, default=None), max(vs, default=None), min(ws, default=None), max(ws, default=None))


def test_dense_stats_hands_on_full_accumulators_and_takes_empty_tables(spark, monkeypatch):
    monkeypatch.setattr("driftmesh.operators.dense.MAX_BLOCKS", 2)
    df = spark.range(5000).select((F.col("id") % 50).alias("g"), (F.col("id") * 300).alias("k"))
    assert dense_stats(df, "g", "k").count() == 5000
    assert dense_stats(df.where("g < 0"), "g", "k").count() == 0


# --- sweep (problem 3)


@pytest.mark.parametrize("target", [20_000, 40, 4])
def test_sweep_equals_brute_force(spark, target):
    points, rows = cloud(spark, 260, side=6.0)
    extra = [(1, 1000, *rows[0][2:5], 3, 1.0), (2, 1001, *rows[0][2:5], 3, 1.0)]
    points = points.unionByName(spark.createDataFrame(extra, POINT))
    rows = rows + extra
    boxes = [(1, 1, 0.0, 3.0, 0.0, 3.0, 0.0, 6.0), (1, 2, 2.0, 1.0, 0.0, 9.0, 0.0, 9.0), (1, 3, None, 1.0, 0.0, 1.0, 0.0, 1.0), (2, 4, -9.0, 9.0, -9.0, 9.0, -9.0, 9.0), (1, 5, *(v for c in rows[3][2:5] for v in (c, c))), (1, 6, -1e308, 1e308, -1e308, 1e308, float("-inf"), float("inf"))]
    frame = spark.createDataFrame(boxes, "run_id int, box_id long, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    got = [tuple(r) for r in near_and_inside(points, frame, target).collect()]
    want = {("near", i, j) for i, j in brute_links(rows, 1.0)}
    for b in boxes:
        if None not in b:
            want |= {("inside", r[1], b[1]) for r in rows if r[0] == b[0] and all(b[2 + 2 * k] <= r[2 + k] <= b[3 + 2 * k] for k in range(3))}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_crowded_band_is_cut_and_hardly_copied(spark):
    n = 4000
    points = spark.range(n).select(F.lit(1).alias("run_id"), "id", (F.col("id") * 0.25).alias("x"), (F.col("id") % 7 * 0.1).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("reach"))
    tiles = _Tiles(points, 100)
    placed = tiles.placed()
    sizes = [r["count"] for r in placed.groupBy("strip", "cut").count().collect()]
    assert placed.count() < 1.1 * n and len(sizes) > 20 and max(sizes) < 220
    boxes = spark.createDataFrame([(1, k, 10.0 * k, 10.0 * k + 5, -1e308, 1e308, -1.0, 1.0) for k in range(90)], "run_id int, box_id long, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    assert tiles.caught(boxes).count() < 2 * 90
    got = friends(points, 100).collect()
    assert len(got) == n and {r.cluster_id for r in got} == {0}


def test_contraction_of_random_links():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 300):
        u, v = rng.integers(0, 400, (2, n))
        ids, top = contracted(u, v)
        want = roots(list(zip(u.tolist(), v.tolist())))
        assert dict(zip(ids.tolist(), top.tolist())) == {k: r for k, r in want.items() if k != r}


def test_sweep_of_empty_tables(spark):
    points, _ = cloud(spark, 5)
    boxes = spark.createDataFrame([], "run_id int, box_id long, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    assert near_and_inside(points.where("id < 0"), boxes).count() == 0


# --- cleaning


def test_last_arrived_takes_the_latest_row_and_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (2, 5, 3.0), (2, 5, 4.0), (3, None, 9.0)], "k int, arrived_at int, v double")
    assert {tuple(r) for r in last_arrived(df, ["k"], ["v"]).collect()} == {(1, 2.0), (2, 4.0), (3, 9.0)}


def test_placed_points_leaves_out_unusable_rows(spark):
    runs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "run_id int, dim int, link_len double")
    rows = [(1, 1, 1.0, 1.0, None, 1), (1, 2, float("nan"), 1.0, 1.0, 1), (2, 3, 1.0, 1.0, float("inf"), 1), (2, 4, 1.0, 1.0, 2.0, 1), (2, 4, 3.0, None, 2.0, 9), (9, 5, 1.0, 1.0, 1.0, 1), (2, None, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "run_id int, pid long, x double, y double, z double, arrived_at int")
    got = {(r.pid, r.x, r.z) for r in placed_points(df, runs, "pid", ("x", "y", "z")).collect()}
    assert got == {(1, 1.0, 0.0), (4, 1.0, 2.0)}


# --- grid, Morton, pairs, clusters


def test_spread_bits_and_morton_goldens(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 7, 512, 1023)], "v long")
    got = {r.v: r.e for r in df.select("v", grid.spread_bits(F.col("v")).alias("e")).collect()}
    assert got == {0: 0, 1: 1, 2: 8, 3: 9, 4: 64, 7: 73, 512: 134217728, 1023: 153391689}


def test_largest_coordinate_falls_into_the_last_cell(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 2, 1.0), (1, 1, 4.0, 4.0, 0.0, 2, 1.0)]
    points = spark.createDataFrame(rows, POINT)
    params = grid.grid_params(points, 0.0)
    got = {r.id: (r.cx, r.cy, r.cell_id) for r in grid.with_cells(points, params).collect()}
    assert got == {0: (0, 0, 0), 1: (3, 3, 15)}


@pytest.mark.parametrize("dim", [2, 3])
def test_links_and_clusters_equal_brute_force(spark, dim):
    points, rows = cloud(spark, 200, dim, seed=dim, side=8.0 if dim == 3 else 16.0)
    got = {(r.i, r.j) for r in pairs.links(points).collect()}
    want = brute_links(rows, 1.0)
    assert got == want
    labels = {r.id: r.cluster_id for r in components(pairs.links(points)).collect()}
    assert labels == roots(want)
    for target in (60,):
        found = friends(pairs.reaching(points), target).collect()
        assert {r.id: r.cluster_id for r in found} == labels and len(found) == len(labels)
        assert {(r.i, r.j) for r in near_pairs(pairs.reaching(points), target).collect()} == want
    assert pairs.clusters(points).count() == 200


def test_pair_at_exactly_the_linking_length_and_coincident_points(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 3, 1.0), (1, 1, 1.0, 0.0, 0.0, 3, 1.0), (1, 2, 1.0, 0.0, 0.0, 3, 1.0), (1, 3, 9.0, 9.0, 9.0, 3, 1.0)]
    points = spark.createDataFrame(rows, POINT)
    got = {(r.i, r.j) for r in pairs.links(points).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}


def test_long_chain_is_one_component(spark):
    links = spark.range(300).select(F.lit(1).alias("run_id"), F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert {r.cluster_id for r in components(links).collect()} == {0}


def test_prefix_sum_over_stretches(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("o"), F.lit(2).alias("v"))
    got = {r.o: (r.s, r.p) for r in grid.prefix_sum(df, ["g"], "o", "v", "s").join(grid.previous(grid.ranged(df, ["g"], "o"), ["g"], "o", "o", "p").select("o", "p"), "o").collect()}
    assert got == {i * 7: (2 * (i // 3), i * 7 - 21 if i > 2 else None) for i in range(100)}


# --- codec


def cells_of(points, xi=0.05, mode="morton"):
    return grid.with_cells(points, grid.grid_params(points, xi)).withColumn("mode", F.lit(mode))


def plain_chain(values, start, xi):
    codes, last = [], start
    for v in values:
        k = (v - last) / (2 * xi)
        k = int(math.copysign(math.floor(abs(k) + 0.5), k))
        codes.append(k + 32768 if abs(k) < 32768 else None)
        last = last + k * 2 * xi if abs(k) < 32768 else v
    return codes, last


@pytest.mark.parametrize("xi", [0.05, 1e-5, 1e-6])
@pytest.mark.parametrize("mode", ["morton", "kd"])
def test_codes_follow_the_recurrence_and_decode(spark, xi, mode):
    points, _ = cloud(spark, 150)
    rows = codec.coded(cells_of(points, xi, mode)).cache()
    by_cell = {}
    for r in sorted(rows.collect(), key=lambda r: (r.cell_id, r.seq)):
        by_cell.setdefault(r.cell_id, []).append(r)
    for cell in by_cell.values():
        assert [r.seq for r in cell] == list(range(len(cell)))
        for a in "xyz":
            assert [r[f"code_{a}"] for r in cell] == plain_chain([r[a] for r in cell], cell[0][f"o{a}"], xi)[0]
            assert all(abs(r[f"recon_{a}"] - r[a]) <= xi * (1 + 1e-6) and r[f"outlier_{a}"] == (r[f"code_{a}"] is None) for r in cell)
        if mode == "kd":  # each next point is nearest to the last reconstruction
            at = np.array([cell[0].ox, cell[0].oy, cell[0].oz])
            for k, r in enumerate(cell):
                far = [((np.array([q.x, q.y, q.z]) - at) ** 2).sum() for q in cell[k:]]
                assert far[0] <= min(far) + 1e-12
                at = np.array([r.recon_x, r.recon_y, r.recon_z])
    assert sorted(r.visit_pos for c in by_cell.values() for r in c) == list(range(150))
    back = codec.decoded(rows.drop(*[f"recon_{a}" for a in "xyz"]).select("*", *[F.when(F.col(f"outlier_{a}") == 1, F.col(a)).alias(f"exact_{a}") for a in "xyz"]))
    recon = {r.id: r for r in rows.collect()}
    assert all(abs(r[f"recon_{a}"] - recon[r.id][f"recon_{a}"]) < 1e-9 for r in back.collect() for a in "xyz")


def test_the_grid_finds_the_same_next_points(monkeypatch):
    rng = np.random.default_rng(3)
    for dim in (2, 3):
        points = np.round(rng.uniform(0, 4, (400, dim)), 1)
        points[:40] = points[0]
        plain = codec.walked(points, np.full(dim, 2.0), 0.01)
        monkeypatch.setattr(codec, "GRID_FROM", 10)
        grid_ = codec.walked(points, np.full(dim, 2.0), 0.01)
        monkeypatch.undo()
        assert all((a == b).all() for a, b in zip(plain, grid_))


def test_symbols_come_back_from_bits():
    rng = np.random.default_rng(6)
    for weights in ([5], [5, 1], [2**k for k in range(30)], rng.integers(1, 50, 300).tolist()):
        table = codec.huffman_table([(7 * k, w) for k, w in enumerate(weights)])
        symbols = rng.choice([7 * k for k in range(len(weights))], 500)
        raw, bits = codec.packed(symbols, table)
        assert bits == sum(table[s][1] for s in symbols.tolist()) and (codec.unpacked(raw, 500, table) == symbols).all()
    with pytest.raises(ValueError, match="early"):
        codec.unpacked(raw[:3], 500, table)


def test_huffman_goldens():
    assert codec.huffman_table([(10, 5), (20, 2), (30, 1), (40, 1)]) == {10: (1, 1), 20: (0, 2), 30: (2, 3), 40: (3, 3)}
    assert codec.huffman_table([(7, 3)]) == {7: (0, 1)}


def test_codes_come_back_from_packed_blocks(spark):
    codes = spark.range(20000).select(F.lit(1).alias("run_id"), F.col("id").alias("pos"), (32768 + F.floor(F.log2(F.col("id") % 97 + 1))).alias("code"))
    tab = codec.code_table(codec.symbol_counts(codes))
    back = codec.unpack_codes(codec.pack_codes(codes, tab), tab)
    assert codes.exceptAll(back.select("run_id", "pos", "code")).count() == 0 and back.count() == 20000


def test_packed_bits_golden(spark):
    df = spark.createDataFrame([(1, p, f) for p, f in enumerate([1, 0, 1, 1, 0, 0, 0, 0, 1])], "r int, pos long, flag int")
    packed = codec.packed_bits(df, ["r"], "pos", "flag")
    assert {r.byte_no: r.byte for r in packed.collect()} == {0: 176, 1: 128}
    assert sum(r.flag for r in codec.unpacked_bits(packed, ["r"]).collect()) == 4


# --- edits and metrics


def test_edits_keep_the_links(spark):
    points, _ = cloud(spark, 400, side=7.0)
    params = grid.grid_params(points)
    q = codec.quantised(grid.visit_order(grid.with_cells(points, params))).cache()
    recon = q.select("run_id", "id", *[F.col(f"recon_{a}").alias(a) for a in "xyz"])
    vp = pairs.vulnerable_pairs(q, params).cache()
    wrong = lambda r: pairs.with_distance(vp, r).where("(r2 > b * b) <> (sign = 1)").count()
    before = wrong(recon)
    assert before > 0 and wrong(edit.exact_edit(recon, points, vp)) == 0
    moved = edit.gradient_edit(recon, points, vp, max_iter=300)
    assert wrong(moved) < before / 2
    xi = q.first().xi
    off = moved.join(points.select("id", *[F.col(a).alias(f"t{a}") for a in "xyz"]), "id").select(F.max(F.greatest(*[F.abs(F.col(a) - F.col(f"t{a}")) for a in "xyz"])).alias("m")).first().m
    assert off <= xi + 4 * xi / 65535


def test_pair_confusion_goldens(spark):
    def score(one, two):
        frame = lambda c: spark.createDataFrame([(1, i, v) for i, v in enumerate(c)], "run_id int, id long, cluster_id long")
        r = metrics.adjusted_rand(metrics.pair_confusion(metrics.contingency(frame(one), frame(two)))).first()
        return r.tp, r.tn, r.fp, r.fn, round(r.ari, 12)

    assert score([0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 2]) == (2, 9, 2, 2, 0.318181818182)
    assert score([0, 0], [0, 0]) == (1, 0, 0, 0, 1.0)
    assert score([0, 1, 2], [0, 1, 2]) == (0, 3, 0, 0, 1.0)


# --- domains, sources


def test_axis_islands_split_at_gaps_wider_than_the_width(spark):
    rows = [(1, i, x, 0.0, 0.0, 2, 1.0) for i, x in enumerate([0.0, 0.9, 1.9, 3.0, 3.1, 9.0])]
    points = spark.createDataFrame(rows, POINT)
    widths = spark.createDataFrame([(1, 1.0)], "run_id int, width double")
    got = sorted((r.lo, r.hi, r.n) for r in domain.islands(domain.axis_islands(points, widths)).where("axis = 0").collect())
    assert got == [(0.0, 1.9, 3), (3.0, 3.1, 2), (9.0, 9.0, 1)]


def test_raw_files_come_back(spark, tmp_path):
    raw.register(spark)
    points, rows = cloud(spark, 500)
    for dtype in ("f64", "f32"):
        path = str(tmp_path / dtype)
        points.select("x", "y", "z").write.format("raw_points").mode("append").options(path=path, dim="3", dtype=dtype).save()
        back = spark.read.format("raw_points").options(path=path, dim="3", dtype=dtype, rows="64").load()
        assert sorted(tuple(r) for r in back.select("x", "y", "z").collect()) == sorted(tuple(r[2:5]) for r in rows)
    np.arange(7.0).tofile(tmp_path / "bad.bin")
    with pytest.raises(Exception, match="size"):
        spark.read.format("raw_points").options(path=str(tmp_path / "bad.bin"), dim="3").load().count()


def test_raw_writer_gives_one_file_an_axis_and_vectors_are_read(spark, tmp_path):
    raw.register(spark)
    points, rows = cloud(spark, 40)
    path = str(tmp_path / "axes")
    points.write.format("raw_points").mode("append").options(path=path, dim="3", dtype="f32", layout="axes").save()
    import os

    assert {f.split(".", 1)[1] for f in os.listdir(path)} == {"xx.f32", "yy.f32", "zz.f32"}
    back = spark.read.format("raw_points").options(path=path, dim="3", dtype="f32").load()
    assert sorted(tuple(r) for r in back.select("x", "y", "z").collect()) == sorted(tuple(r[2:5]) for r in rows)
    np.arange(5.0).tofile(tmp_path / "v.bin")
    assert [r.x for r in spark.read.format("raw_points").options(path=str(tmp_path / "v.bin"), dim="1").load().orderBy("idx").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="mounted"):
        spark.read.format("raw_points").options(path="hdfs://a/b", dim="3").load().count()


def test_raw_files_one_an_axis(spark, tmp_path):
    raw.register(spark)
    for a in "xy":
        np.arange(10.0).astype("<f4").tofile(tmp_path / f"{a}.f32")
    back = spark.read.format("raw_points").options(path=f"{tmp_path}/x.f32,{tmp_path}/y.f32", dim="2", dtype="f32", n="10").load()
    assert [(r.x, r.y) for r in back.orderBy("idx").collect()] == [(float(i), float(i)) for i in range(10)]


def test_container_keeps_every_particle_within_the_bound(spark, tmp_path):
    points, rows = cloud(spark, 200)
    container.compress(points, str(tmp_path / "c"))
    back = {r.id: (r.x, r.y, r.z) for r in container.decompress(spark, str(tmp_path / "c")).collect()}
    assert all(abs(u - v) <= 0.05 * (1 + 1e-9) for r in rows for u, v in zip(r[2:5], back[r[1]])) and len(back) == len(rows)


@pytest.mark.parametrize("how,mode,xi", [("gradient", "kd", 0.05), ("exact", "morton", 0.05), ("none", "morton", 1e-6)])
def test_containers_keep_links_and_bounds(spark, tmp_path, how, mode, xi):
    points, rows = cloud(spark, 300, side=6.0)
    container.compress(points, str(tmp_path / "c"), xi, modes=points.select("run_id", F.lit(mode).alias("mode")).distinct(), how=how, steps=300)
    back = container.decompress(spark, str(tmp_path / "c")).cache()
    got = {r.id: (r.x, r.y, r.z) for r in back.collect()}
    assert len(got) == 300 and all(abs(u - v) <= xi * (1 + 1e-4) for r in rows for u, v in zip(r[2:5], got[r[1]]))
    vp = pairs.vulnerable_pairs(points, grid.grid_params(points, xi))
    wrong = pairs.with_distance(vp, back).where("(r2 > b * b) <> (sign = 1)").count()
    assert wrong == 0 if how == "exact" else wrong <= 5
    r = container.size_report(spark, str(tmp_path / "c")).first()
    assert r.particles == 300 and (r.outliers > 0) == (xi < 1e-3) and (r.edits > 0) == (how == "gradient") and (r.exact_edits > 0) == (how == "exact")


def test_edits_alone_repair_a_foreign_base(spark, tmp_path):
    points, _ = cloud(spark, 200, dim=2, side=9.0)
    base = points.withColumn("x", F.col("x") + F.when(F.col("id") % 2 == 0, 0.03).otherwise(-0.03))
    container.compress_edits(points, base, str(tmp_path / "e"), how="exact")
    back = container.decompress(spark, str(tmp_path / "e"), base)
    params = spark.read.parquet(str(tmp_path / "e" / "params"))
    assert abs(params.first().xi - 0.03) < 1e-9
    vp = pairs.vulnerable_pairs(points, params)
    assert pairs.with_distance(vp, back).where("(r2 > b * b) <> (sign = 1)").count() == 0


def test_large_components_take_the_same_steps(spark, monkeypatch):
    points, _ = cloud(spark, 120, side=4.0)
    params = grid.grid_params(points)
    q = codec.coded(grid.with_cells(points, params)).cache()
    recon = q.select("run_id", "id", *[F.col(f"recon_{a}").alias(a) for a in "xyz"])
    vp = pairs.vulnerable_pairs(points, params).cache()
    one = {r.id: (r.qx, r.qy, r.qz) for r in edit.gradient_edits(recon, points, vp, max_iter=4).collect()}
    monkeypatch.setattr(edit, "MOST_PAIRS", 3)
    two = {r.id: (r.qx, r.qy, r.qz) for r in edit.gradient_edits(recon, points, vp, max_iter=4).collect()}
    assert set(one) == set(two) and max(abs(u - v) for k in one for u, v in zip(one[k], two[k])) <= 1


def test_error_bounds_and_linking_lengths(spark):
    points, _ = cloud(spark, 50)
    ranges = grid.axis_ranges(points).first()
    smallest = min(ranges.range_x, ranges.range_y, ranges.range_z)
    p = lambda *a: grid.grid_params(points, *a).first()
    assert p(0.1).xi == 0.1 and p(0.2, "abs").xi == 0.2 and abs(p(0.01, "rel").xi - 0.01 * smallest) < 1e-12
    assert abs(p(0.1, "abs", 0.2).b - 0.2 * (ranges.range_x * ranges.range_y * ranges.range_z / 50) ** (1 / 3)) < 1e-9


def test_command_line(spark, tmp_path):
    from driftmesh.cli import main, parse, score

    with pytest.raises(SystemExit):
        parse(["compress", "--out", "x"])
    points, _ = cloud(spark, 150)
    moved = points.withColumn("x", F.col("x") + 0.04)
    with pytest.raises(SystemExit):
        parse(["edit", "--points", "a", "--recon", "b", "--out", "x", "--edit", "none"])
    points.write.parquet(str(tmp_path / "p"))
    main(["compress", "--points", str(tmp_path / "p"), "--out", str(tmp_path / "c"), "--bound", "rel", "--xi", "0.001", "--order", "kd", "--edit", "exact"])
    main(["decompress", "--container", str(tmp_path / "c"), "--out", str(tmp_path / "xyz"), "--raw", "3"])
    raw.register(spark)
    assert spark.read.format("raw_points").options(path=str(tmp_path / "xyz"), dim="3").load().count() == 150
    r = score(points, moved, "exact").first()
    assert r.ari == 1.0 and r.n == 150 and r.max_error <= 0.04 + 1e-9


def test_registered_gradient_edit_runs_all_steps(monkeypatch):
    import inspect
    from unittest.mock import MagicMock

    from driftmesh.operators import edit
    from driftmesh.plans import queries

    class Seen(Exception):
        pass

    steps = inspect.signature(edit.gradient_edit)

    def seen(*args, **kwargs):
        bound = steps.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Seen(bound.arguments["max_iter"])

    monkeypatch.setattr(queries, "_measured", lambda spark, sf_dir: (MagicMock(), MagicMock(), MagicMock()))
    monkeypatch.setattr(queries, "recon_of", lambda q: q)
    monkeypatch.setattr(edit, "gradient_edit", seen)
    with pytest.raises(Seen, match="^1000$"):
        queries.pgd_edit(None, "")


def test_edits_of_many_runs_in_one_bucket_are_those_of_plain_steps():
    rng = np.random.default_rng(4)
    n, lr, steps = 150, 0.01, 400
    b, xi = np.array([1.0, 1.5]), np.array([0.05, 0.075])
    tol, run = np.array([edit.tolerance(x, 3) for x in xi]), np.repeat([0, 1], n)
    org = rng.uniform(0, 4, (2 * n, 3))
    pos = org + rng.uniform(-1, 1, org.shape) * xi[run, None]
    gap = np.sqrt(((org[:, None] - org) ** 2).sum(2))
    i, j = np.nonzero((run[:, None] == run) & (np.arange(2 * n)[:, None] < np.arange(2 * n)) & (np.abs(gap - b[run]) < 2 * np.sqrt(3) * xi[run]))
    apart = gap[i, j] > b[run[i]]
    plain, losses = pos, np.zeros((2, steps))
    m = v = np.zeros_like(pos)
    for t in range(1, steps + 1):
        way = plain[i] - plain[j]
        d = np.sqrt((way * way).sum(1))
        over = np.where(apart, np.minimum(d - b[run[i]] - tol[run[i]], 0), np.maximum(d - b[run[i]] + tol[run[i]], 0))
        losses[:, t - 1] = np.bincount(run[i], over * over, 2)
        pull = np.where((d >= tol[run[i]]) & (apart == (d <= b[run[i]])), 2 * (d - b[run[i]]) / d, 0)[:, None] * way
        grad = np.zeros_like(pos)
        np.add.at(grad, i, pull)
        np.add.at(grad, j, -pull)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        rate = lr * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        plain = np.clip(plain - rate * m / (np.sqrt(v) + 1e-8), org - xi[run, None], org + xi[run, None])
    got, noted = edit._descend(pos, org, i, j, apart, b, tol, xi, run, np.zeros(2, bool), lr, steps)
    assert np.abs(got - plain).max() < 1e-9 and np.allclose(noted, losses, rtol=1e-6, atol=1e-15)
    alone = run[i] == 1  # a run that is whole stops by itself, others go on
    far = edit._descend(pos, org, i, j, apart, b, np.array([tol[0], 10.0]), xi, run, np.array([False, True]), lr, steps)[0]
    assert (far[run == 1] == pos[run == 1]).all() and np.abs(far[run == 0] - plain[run == 0]).max() < 1e-9 and alone.any()
