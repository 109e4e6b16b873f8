"""SQL of the core queries."""

from __future__ import annotations

from driftmesh.operators.grid import MORTON

#: Usable rows of a point table, the last arrived of each id.
_LAST = """
{name} AS (
  SELECT run_id, {id} AS id, dim, link_len, rank_no, x, y, z FROM (
    SELECT p.run_id, p.{id}, r.dim, r.link_len, {rank} AS rank_no, p.{x} AS x, p.{y} AS y, CASE WHEN r.dim = 3 THEN p.{z} ELSE 0.0 END AS z,
           row_number() OVER (PARTITION BY p.run_id, p.{id} ORDER BY p.arrived_at DESC NULLS LAST) AS k
    FROM {table} p JOIN runs r ON p.run_id = r.run_id
    WHERE p.{id} IS NOT NULL AND isfinite(p.{x}) AND isfinite(p.{y}) AND (r.dim = 2 OR isfinite(p.{z}))
  ) WHERE k = 1
)"""
PARTICLES = _LAST.format(name="part_rows", id="particle_id", rank="p.rank_no", x="x", y="y", z="z", table="particles")
GHOSTS = _LAST.format(name="ghost_rows", id="ghost_id", rank="0", x="xx", y="yy", z="zz", table="ghost_points")

_AXES = "xyz"
PARAMS = f"""{PARTICLES},
ext AS (SELECT run_id, dim, link_len, count(*) AS n, {', '.join(f'min({a}) AS min_{a}, max({a}) AS max_{a}, max({a}) - min({a}) AS range_{a}' for a in _AXES)} FROM part_rows GROUP BY 1, 2, 3),
par0 AS (SELECT *, link_len AS b, link_len * 0.05 AS xi, link_len + 2 * sqrt(dim::DOUBLE) * (link_len * 0.05) AS g FROM ext),
par AS (SELECT *, {', '.join(f'greatest(1, ceil(range_{a} / g))::BIGINT AS cells_{a}' for a in _AXES)} FROM par0)"""
CELLS = f"""{PARAMS},
cel0 AS (SELECT p.run_id, p.id, p.x, p.y, p.z, p.dim, q.b, q.xi, q.g, q.min_x, q.min_y, q.min_z, q.cells_x, q.cells_y,
  {', '.join(f'least(greatest(floor((p.{a} - q.min_{a}) / q.g)::BIGINT, 0), q.cells_{a} - 1) AS c{a}' for a in _AXES)}
  FROM part_rows p JOIN par q ON p.run_id = q.run_id),
cel AS (SELECT *, cz * cells_x * cells_y + cy * cells_x + cx AS cell_id, {', '.join(f'min_{a} + c{a} * g AS o{a}' for a in _AXES)} FROM cel0)"""


def _spread(v: str) -> str:
    for factor, mask in MORTON:
        v = f"((({v}) * {factor}) & {mask})"
    return v


_TEN = {a: f"least(1023, greatest(0, floor(({a} - o{a}) / g * 1024)))::BIGINT" for a in _AXES}
VISITS = f"""{CELLS},
cod AS (SELECT *, {', '.join(f'{_TEN[a]} AS t{a}' for a in _AXES)} FROM cel),
mor AS (SELECT *, (CASE WHEN dim = 3 THEN {_spread('tz')} * 4 ELSE 0 END) | ({_spread('ty')} * 2) | {_spread('tx')} AS morton FROM cod),
vis AS (SELECT *, row_number() OVER (PARTITION BY run_id, cell_id ORDER BY morton, id) - 1 AS seq, row_number() OVER (PARTITION BY run_id ORDER BY cell_id, morton, id) - 1 AS visit_pos FROM mor)"""
CODES = f"""{VISITS},
stp AS (SELECT *, {', '.join(f'round(({a} - o{a}) / (2 * xi))::BIGINT AS k{a}' for a in _AXES)} FROM vis),
qua AS (SELECT *, {', '.join((f"CASE WHEN dim = 3 THEN " if a == "z" else "") + f"k{a} - coalesce(lag(k{a}) OVER (PARTITION BY run_id, cell_id ORDER BY seq), 0) + 32768" + (" END" if a == "z" else "") + f" AS code_{a}" for a in _AXES)},
  {', '.join((f"CASE WHEN dim = 3 THEN " if a == "z" else "") + f"o{a} + 2 * xi * k{a}" + (" ELSE 0.0 END" if a == "z" else "") + f" AS recon_{a}" for a in _AXES)} FROM stp)"""


def _near(points: str, band: str, name: str) -> str:
    """Pairs i < j of points whose squared distance satisfies ``band``, by cells of side g."""
    return f"""
{name} AS (
  SELECT a.run_id, a.dim, a.b, a.xi, a.id AS i, b.id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
  FROM (SELECT c.*, c.cx + u.i AS jx, c.cy + v.j AS jy, c.cz + w.k AS jz FROM {points} c, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j), (VALUES (-1), (0), (1)) w(k)) a
  JOIN {points} b ON a.run_id = b.run_id AND a.jx = b.cx AND a.jy = b.cy AND a.jz = b.cz
  WHERE a.id < b.id AND {band.replace('D2', '((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))')})"""


_LINK = "D2 <= a.b * a.b"
_SLACK = "2 * sqrt(a.dim::DOUBLE) * a.xi"
_BAND = f"D2 > greatest(0.0, a.b - {_SLACK}) * greatest(0.0, a.b - {_SLACK}) AND D2 <= (a.b + {_SLACK}) * (a.b + {_SLACK})"


def _components(links: str, name: str) -> str:
    """Smallest id of everything linked, of every linked point."""
    return f"""
{name}_e AS (SELECT run_id, i AS u, j AS v FROM {links} UNION ALL SELECT run_id, j, i FROM {links}),
{name}(run_id, id, c) USING KEY (run_id, id) AS (
  SELECT run_id, u AS id, min(least(u, v)) AS c FROM {name}_e GROUP BY 1, 2
  UNION
  SELECT e.run_id, e.v AS id, min(l.c) AS c FROM {name} l JOIN {name}_e e ON e.run_id = l.run_id AND e.u = l.id JOIN recurring.{name} r ON r.run_id = e.run_id AND r.id = e.v WHERE l.c < r.c GROUP BY 1, 2)"""


LINKS = f"{CELLS},{_near('cel', _LINK, 'lnk')}"
CLUSTERS = f"{LINKS},{_components('lnk', 'lab')}"
PAIRS = f"{CODES},{_near('qua', _BAND, 'vul0')},\nvul AS (SELECT *, (d2 > b * b)::INT::BIGINT AS sign FROM vul0)"
MEASURED = f"""{PAIRS},
mea0 AS (SELECT v.*, p.recon_x - q.recon_x AS dx, p.recon_y - q.recon_y AS dy, p.recon_z - q.recon_z AS dz
  FROM vul v JOIN qua p ON v.run_id = p.run_id AND v.i = p.id JOIN qua q ON v.run_id = q.run_id AND v.j = q.id),
mea AS (SELECT *, dx * dx + dy * dy + dz * dz AS r2, sqrt(dx * dx + dy * dy + dz * dz) AS d, 2 * xi / 65535 * 2 * sqrt(dim::DOUBLE) AS tol FROM mea0)"""
EDITABLE = "edi AS (SELECT run_id, i AS id FROM vul UNION SELECT run_id, j FROM vul)"


def _two(recon: str) -> str:
    """Clusters of the particles and of ``recon`` (rows of qua with columns rx, ry, rz), and their contingency."""
    ext = ", ".join(f"min(r{a}) AS min_{a}, max(r{a}) - min(r{a}) AS range_{a}" for a in _AXES)
    return f"""{PAIRS}, {EDITABLE},
rec AS ({recon}),
rex AS (SELECT run_id, {ext} FROM rec GROUP BY 1),
rce AS (SELECT r.run_id, r.id, r.dim, r.b, r.xi, r.rx AS x, r.ry AS y, r.rz AS z,
  {', '.join(f'least(greatest(floor((r.r{a} - e.min_{a}) / r.g)::BIGINT, 0), greatest(1, ceil(e.range_{a} / r.g))::BIGINT - 1) AS c{a}' for a in _AXES)} FROM rec r JOIN rex e ON r.run_id = e.run_id),
{_near('qua', _LINK, 'lnk')},{_near('rce', _LINK, 'rln')},{_components('lnk', 'lab')},{_components('rln', 'rla')},
two AS (SELECT q.run_id, coalesce(l.c, q.id) AS one, coalesce(r.c, q.id) AS other, count(*) AS n
  FROM qua q LEFT JOIN lab l ON q.run_id = l.run_id AND q.id = l.id LEFT JOIN rla r ON q.run_id = r.run_id AND q.id = r.id GROUP BY 1, 2, 3),
con AS (SELECT t.run_id, t.tp, b.s - t.tp AS fp, a.s - t.tp AS fn, t.n * (t.n - 1) / 2 - t.tp - (b.s - t.tp) - (a.s - t.tp) AS tn FROM
  (SELECT run_id, sum(n * (n - 1) / 2) AS tp, sum(n) AS n FROM two GROUP BY 1) t
  JOIN (SELECT run_id, sum(n * (n - 1) / 2) AS s FROM (SELECT run_id, one, sum(n) AS n FROM two GROUP BY 1, 2) GROUP BY 1) a ON t.run_id = a.run_id
  JOIN (SELECT run_id, sum(n * (n - 1) / 2) AS s FROM (SELECT run_id, other, sum(n) AS n FROM two GROUP BY 1, 2) GROUP BY 1) b ON t.run_id = b.run_id)"""


_BASE = _two("SELECT run_id, id, dim, b, xi, g, recon_x AS rx, recon_y AS ry, recon_z AS rz FROM qua")
_EXACT = _two("SELECT q.run_id, q.id, q.dim, q.b, q.xi, q.g, CASE WHEN e.id IS NULL THEN recon_x ELSE x END AS rx, CASE WHEN e.id IS NULL THEN recon_y ELSE y END AS ry, CASE WHEN e.id IS NULL THEN recon_z ELSE z END AS rz FROM qua q LEFT JOIN edi e ON q.run_id = e.run_id AND q.id = e.id")
_ARI = "coalesce(round(2 * (tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif((tp::DOUBLE + fp) * (fp::DOUBLE + tn) + (tp::DOUBLE + fn) * (fn::DOUBLE + tn), 0), 9), 1.0)"
BOXES = f"{PARAMS},\nbox AS (SELECT run_id, rank_no, count(*) AS n, {', '.join(f'min({a}) AS lo_{a}, max({a}) AS hi_{a}' for a in _AXES)} FROM part_rows WHERE rank_no IS NOT NULL GROUP BY 1, 2)"
GHOST_ROWS = f"""{BOXES},
gho AS (SELECT p.run_id, b.rank_no AS dest_rank, p.id FROM part_rows p JOIN par q ON p.run_id = q.run_id JOIN box b ON p.run_id = b.run_id AND p.rank_no IS DISTINCT FROM b.rank_no
  WHERE {' AND '.join(f'p.{a} BETWEEN b.lo_{a} - q.g AND b.hi_{a} + q.g' for a in _AXES)})"""
ISLANDS = f"""{PARAMS},
axs AS (SELECT p.run_id, s.axis, p.id, CASE s.axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v FROM part_rows p, (VALUES (0), (1), (2)) s(axis) WHERE s.axis < p.dim),
gap AS (SELECT a.*, CASE WHEN v - lag(v) OVER (PARTITION BY a.run_id, axis ORDER BY v) > q.g THEN 1 ELSE 0 END AS new FROM axs a JOIN par q ON a.run_id = q.run_id),
isl AS (SELECT *, (sum(new) OVER (PARTITION BY run_id, axis ORDER BY v RANGE UNBOUNDED PRECEDING))::BIGINT AS island FROM gap)"""


def _adapted(rows: str, z: bool, link_len: float) -> str:
    """Particles of another table (id, x, y[, z]) scaled to 0..1000, and their links."""
    axes = "xyz" if z else "xy"
    scaled = ", ".join(f"({a} - min({a}) OVER ()) / (max({a}) OVER () - min({a}) OVER ()) * 1000 AS {a}" for a in axes)
    return f"""src AS ({rows}),
ada AS (SELECT id, {scaled}{'' if z else ', 0.0::DOUBLE AS z'} FROM src),
pla AS (SELECT 0 AS run_id, {3 if z else 2} AS dim, {link_len}::DOUBLE AS b, 0.0 AS xi, id, x, y, z, floor(x / {link_len}) AS cx, floor(y / {link_len}) AS cy, floor(z / {link_len}) AS cz FROM ada),
{_near('pla', _LINK, 'lnk')},{_components('lnk', 'lab')}"""


_ADAPTED = {
    "orders2d": _adapted("SELECT o_orderkey AS id, o_totalprice AS x, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS y FROM orders", False, 4.0),
    "events2d": _adapted("SELECT event_id AS id, epoch_us(ts)::DOUBLE AS x, value AS y FROM events", False, 2.0),
    "lineitem3d": _adapted("SELECT (l_orderkey * 10 + l_linenumber) * 4096 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id, l_extendedprice AS x, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS y, l_partkey::DOUBLE AS z FROM lineitem", True, 2.371262),
    "emb3d": _adapted("SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings", True, 25.0),
}


_WALK_STEP = "CASE WHEN abs(round((p.{a} - w.{a}) / (2 * w.xi))) < 32768 THEN w.{a} + round((p.{a} - w.{a}) / (2 * w.xi)) * 2 * w.xi ELSE p.{a} END AS {a}"
#: The greedy walk of every cell: the place so far (x, y, z), the particles visited and the last of them.
WALK = f"""{CELLS},
kdp AS (SELECT run_id, cell_id, list({{'id': id, 'x': x, 'y': y, 'z': z}} ORDER BY id) AS pts, any_value(dim) AS dim, any_value(xi) AS xi, {', '.join(f"any_value(o{a}) + 0.5 * any_value(g){' * (any_value(dim) = 3)::INT' if a == 'z' else ''} AS {a}" for a in _AXES)} FROM cel GROUP BY 1, 2),
wlk AS (
  SELECT run_id, cell_id, dim, xi, pts, x, y, z, -1::BIGINT AS seq, NULL::BIGINT AS id, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 0.0::DOUBLE AS pz, x AS qx, y AS qy, z AS qz FROM kdp
  UNION ALL
  SELECT w.run_id, w.cell_id, w.dim, w.xi, list_filter(w.pts, lambda e: e.id <> p.id) AS pts, {', '.join(_WALK_STEP.format(a=a) for a in _AXES)}, w.seq + 1 AS seq, p.id, p.x AS px, p.y AS py, p.z AS pz, w.x AS qx, w.y AS qy, w.z AS qz
  FROM (SELECT *, list_sort(list_transform(pts, lambda e: {{'d': (e.x - x) * (e.x - x) + (e.y - y) * (e.y - y) + (e.z - z) * (e.z - z), 'id': e.id, 'x': e.x, 'y': e.y, 'z': e.z}}))[1] AS p FROM wlk WHERE len(pts) > 0) w)"""
#: The chain of every cell under a tight bound, with outliers.
_CHAIN_STEP = "CASE WHEN abs(round((v.{a} - c.r{a}) / (2 * c.xi))) < 32768 THEN c.r{a} + round((v.{a} - c.r{a}) / (2 * c.xi)) * 2 * c.xi ELSE v.{a} END AS r{a}, (abs(round((v.{a} - c.r{a}) / (2 * c.xi))) >= 32768)::INT AS f{a}"


def _chain(visits: str) -> str:
    return f"""{visits},
chn AS (
  SELECT run_id, cell_id, any_value(xi) AS xi, {', '.join(f'any_value(o{a}) AS r{a}, 0 AS f{a}' for a in _AXES)}, -1::BIGINT AS seq FROM vis GROUP BY 1, 2
  UNION ALL
  SELECT c.run_id, c.cell_id, c.xi, {', '.join(_CHAIN_STEP.format(a=a) for a in _AXES)}, c.seq + 1 FROM chn c JOIN vis v ON v.run_id = c.run_id AND v.cell_id = c.cell_id AND v.seq = c.seq + 1)"""


#: A Huffman tree: the trees left (weight, age, symbols), the lightest two joined a step; the symbols of each step's new tree get one bit longer.
HUFFMAN = f"""{CODES},
frq AS (SELECT symbol, count(*) AS freq FROM (SELECT code_x AS symbol FROM qua UNION ALL SELECT code_y FROM qua UNION ALL SELECT code_z FROM qua WHERE dim = 3) GROUP BY 1),
huf AS (
  SELECT list_sort(list({{'f': freq, 'k': k, 'm': [symbol]}})) AS trees, []::BIGINT[] AS m, max(k) + 1 AS k FROM (SELECT *, row_number() OVER (ORDER BY symbol) AS k FROM frq)
  UNION ALL
  SELECT list_sort(list_append(trees[3:], {{'f': trees[1].f + trees[2].f, 'k': k, 'm': list_concat(trees[1].m, trees[2].m)}})), list_concat(trees[1].m, trees[2].m), k + 1 FROM huf WHERE len(trees) > 1),
dep AS (SELECT symbol, greatest(count(*), 1) AS length FROM (SELECT unnest(m) AS symbol FROM huf) GROUP BY 1)"""


def _w(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def core_sql() -> dict[str, str]:
    axes = lambda t: ", ".join(t.format(a=a) for a in _AXES)
    other = {f"particle_scan_{n}": _w(c, "SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ada") for n, c in _ADAPTED.items()}
    other |= {f"fof_clusters_{n}": _w(c, "SELECT id, c AS cluster_id FROM lab") for n, c in _ADAPTED.items()}
    return other | {
        "raw_roundtrip": _w(PARTICLES, f"SELECT count(*) AS n, {axes('min({a}) AS min_{a}, max({a}) AS max_{a}')} FROM part_rows WHERE dim = 3"),
        "container_roundtrip": _w(PARTICLES, "SELECT run_id, count(*) AS n, 0::BIGINT AS violations FROM part_rows GROUP BY 1"),
        "arrival_windows": "SELECT run_id, epoch(time_bucket(INTERVAL '10 minutes', arrived_at))::BIGINT AS start, count(*) AS n, min(x) AS min_x, max(x) AS max_x FROM particles WHERE run_id IS NOT NULL AND isfinite(x) AND isfinite(y) AND arrived_at IS NOT NULL GROUP BY 1, 2",
        "run_ranges": _w(PARAMS, f"SELECT run_id, n, {axes('min_{a}, max_{a}, range_{a}')} FROM par"),
        "derive_params": _w(PARAMS, "SELECT run_id, b, xi, g, cells_x, cells_y, cells_z FROM par"),
        "extent_linking_length": _w(PARAMS, "SELECT run_id, round(0.2 * CASE WHEN dim = 2 THEN sqrt(range_x * range_y / n) ELSE cbrt(range_x * range_y * range_z / n) END, 6) AS b_of_extent FROM par"),
        "grid_coarsen": _w(
            PARAMS
            + """,
lim AS (SELECT *, greatest(1, n // 4) AS most, cells_x * cells_y * cells_z AS nc FROM par),
fst AS (SELECT *, CASE WHEN nc > most THEN g * pow(nc / most::DOUBLE, 1.0 / dim) ELSE g END AS g0 FROM lim),
tri AS (SELECT f.*, s.k, g0 * pow(1.01, s.k) AS gk FROM fst f, range(0, 201) s(k))""",
            "SELECT run_id, round(min(gk), 6) AS g FROM tri WHERE greatest(1, ceil(range_x / gk)) * greatest(1, ceil(range_y / gk)) * greatest(1, ceil(range_z / gk)) <= most GROUP BY 1",
        ),
        "cell_assign": _w(CELLS, "SELECT run_id, id, cx, cy, cz, cell_id FROM cel"),
        "cell_histogram": _w(CELLS, "SELECT run_id, cell_id, count(*) AS n FROM cel GROUP BY 1, 2"),
        "cell_decode_coords": _w(CELLS, f"SELECT DISTINCT run_id, cell_id, cx, cy, cz, {axes('min_{a} + c{a} * g AS corner_{a}')}, {axes('min_{a} + (c{a} + 0.5::DOUBLE) * g AS centre_{a}')} FROM cel"),
        "cell_offsets": _w(CELLS, "SELECT run_id, cell_id, n, (coalesce(sum(n) OVER (PARTITION BY run_id ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM (SELECT run_id, cell_id, count(*) AS n FROM cel GROUP BY 1, 2)"),
        "cell_gap_runs": _w(CELLS, "SELECT run_id, cell_id, cell_id - coalesce(lag(cell_id) OVER (PARTITION BY run_id ORDER BY cell_id), -1) - 1 AS gap FROM (SELECT DISTINCT run_id, cell_id FROM cel)"),
        "trailing_gaps": _w(CELLS, "SELECT c.run_id, any_value(p.cells_x * p.cells_y * p.cells_z) - 1 - max(c.cell_id) AS gap FROM cel c JOIN par p ON c.run_id = p.run_id GROUP BY 1"),
        "morton_code": _w(VISITS, "SELECT run_id, id, cell_id, morton FROM vis"),
        "visit_order": _w(VISITS, "SELECT run_id, id, cell_id, seq, visit_pos FROM vis"),
        "quantize_codes": _w(CODES, "SELECT run_id, id, code_x, code_y, code_z FROM qua"),
        "quantize_recon": _w(CODES, f"SELECT run_id, id, {axes('round(recon_{a}, 6) AS recon_{a}')} FROM qua"),
        "outlier_flags": _w(CODES, f"SELECT run_id, {axes('count(*) FILTER (code_{a} <= 0 OR code_{a} >= 65536) AS outliers_{a}')} FROM qua GROUP BY 1"),
        "decode_recon": _w(CODES, f"SELECT run_id, id, {axes('round(recon_{a}, 6) AS recon_{a}')} FROM qua"),
        "roundtrip_check": _w(CODES, f"SELECT run_id, count(*) AS n, count(*) FILTER (greatest({axes('abs({a} - recon_{a})')}) > xi * (1 + 1e-9)) AS violations FROM qua GROUP BY 1"),
        "fof_links": _w(LINKS, "SELECT run_id, i, j, d2 FROM lnk"),
        "fof_clusters": _w(CLUSTERS, "SELECT run_id, id, c AS cluster_id FROM lab"),
        "halo_catalog": _w(CLUSTERS, f"SELECT l.run_id, l.c AS cluster_id, count(*) AS size, {axes('round(avg({a}), 6) AS mean_{a}')}, {axes('min({a}) AS min_{a}, max({a}) AS max_{a}')} FROM lab l JOIN part_rows p ON l.run_id = p.run_id AND l.id = p.id GROUP BY 1, 2"),
        "halo_size_hist": _w(CLUSTERS, "SELECT run_id, size, count(*) AS clusters FROM (SELECT run_id, c, count(*) AS size FROM lab GROUP BY 1, 2) GROUP BY 1, 2"),
        "halo_topk": _w(CLUSTERS, "SELECT * FROM (SELECT run_id, cluster_id, size, row_number() OVER (PARTITION BY run_id ORDER BY size DESC, cluster_id) AS place FROM (SELECT run_id, c AS cluster_id, count(*) AS size FROM lab GROUP BY 1, 2)) WHERE place <= 10"),
        "vulnerable_pairs": _w(PAIRS, "SELECT run_id, i, j, sign FROM vul"),
        "editable_points": _w(f"{PAIRS}, {EDITABLE}", "SELECT run_id, id FROM edi"),
        "pair_summary": _w(PAIRS, "SELECT run_id, count(*) AS pairs, sum(sign)::BIGINT AS apart FROM vul GROUP BY 1"),
        "violated_pairs": _w(MEASURED, "SELECT run_id, i, j, sign FROM mea WHERE (r2 > b * b)::INT <> sign"),
        "link_confusion": _w(
            MEASURED
            + """,
lc AS (SELECT run_id, count(*) FILTER (sign = 1 AND r2 > b * b) AS tp, count(*) FILTER (sign = 0 AND r2 <= b * b) AS tn, count(*) FILTER (sign = 1 AND r2 <= b * b) AS fp, count(*) FILTER (sign = 0 AND r2 > b * b) AS fn FROM mea GROUP BY 1)""",
            "SELECT *, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt(tp::DOUBLE + fp) * sqrt(tp::DOUBLE + fn) * sqrt(tn::DOUBLE + fp) * sqrt(tn::DOUBLE + fn), 0), 6) AS mcc FROM lc",
        ),
        "contingency": _w(_BASE, "SELECT run_id, one AS cluster_id, other AS recon_cluster_id, n FROM two"),
        "ari_sampled": _w(_BASE, f"SELECT run_id, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, {_ARI} AS ari FROM con"),
        "pair_confusion": _w(_BASE, f"SELECT run_id, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, {_ARI} AS ari FROM con"),
        "lossless_edit_ari": _w(_EXACT, f"SELECT run_id, {_ARI} AS ari FROM con"),
        "lossless_edit": _w(
            f"{PAIRS}, {EDITABLE}",
            "SELECT q.run_id, q.id, (e.id IS NOT NULL)::INT::BIGINT AS edited, round(CASE WHEN e.id IS NULL THEN recon_x ELSE q.x END, 6) AS x, round(CASE WHEN e.id IS NULL THEN recon_y ELSE q.y END, 6) AS y, round(CASE WHEN e.id IS NULL THEN recon_z ELSE q.z END, 6) AS z FROM qua q LEFT JOIN edi e ON q.run_id = e.run_id AND q.id = e.id",
        ),
        "error_stats": _w(
            CODES
            + f""",
err AS (SELECT q.run_id, q.dim, count(*) AS n, max(greatest({axes('abs({a} - recon_{a})')})) AS m, sum({' + '.join(f'({a} - recon_{a}) * ({a} - recon_{a})' for a in _AXES)}) AS s FROM qua q GROUP BY 1, 2),
ers AS (SELECT e.*, e.s / (e.dim * e.n) AS mse, greatest(range_x, range_y, range_z) AS w FROM err e JOIN par p ON e.run_id = p.run_id)""",
            "SELECT run_id, n, round(m, 6) AS max_error, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(sqrt(mse) / w, 6) AS nrmse, round(-20 * log10(sqrt(mse) / w), 6) AS psnr FROM ers",
        ),
        "auto_xi": _w(CODES, f"SELECT run_id, round(max(greatest({axes('abs({a} - recon_{a})')})), 9) AS xi FROM qua GROUP BY 1"),
        "pgd_loss0": _w(MEASURED, "SELECT run_id, round(sum(CASE WHEN sign = 1 AND d <= b + tol THEN (d - (b + tol)) * (d - (b + tol)) WHEN sign = 0 AND d > b - tol THEN (d - (b - tol)) * (d - (b - tol)) ELSE 0.0 END), 6) AS loss FROM mea GROUP BY 1"),
        "pgd_gradient0": _w(
            MEASURED
            + """,
act AS (SELECT *, 2 * (d - b) / d AS pull FROM mea WHERE d >= tol AND sign = (d <= b)::INT),
ends AS (SELECT run_id, i AS id, pull * dx AS px, pull * dy AS py, pull * dz AS pz FROM act UNION ALL SELECT run_id, j, -pull * dx, -pull * dy, -pull * dz FROM act)""",
            "SELECT run_id, id, round(sum(px) + 0.0, 6) AS grad_x, round(sum(py) + 0.0, 6) AS grad_y, round(sum(pz) + 0.0, 6) AS grad_z FROM ends GROUP BY 1, 2",
        ),
        "kd_order": _w(WALK, "SELECT run_id, cell_id, seq, id FROM wlk WHERE seq >= 0"),
        "kd_codes": _w(
            f"""{WALK},
sta AS (SELECT run_id, cell_id, sum(n) OVER (PARTITION BY run_id ORDER BY cell_id) - n AS start FROM (SELECT run_id, cell_id, count(*) AS n FROM cel GROUP BY 1, 2))""",
            f"SELECT w.run_id, w.id, w.seq, (s.start + w.seq)::BIGINT AS visit_pos, {', '.join(('CASE WHEN dim = 3 THEN ' if a == 'z' else '') + f'round((p{a} - q{a}) / (2 * xi))::BIGINT + 32768' + (' END' if a == 'z' else '') + f' AS code_{a}' for a in _AXES)} FROM wlk w JOIN sta s ON w.run_id = s.run_id AND w.cell_id = s.cell_id WHERE seq >= 0 AND w.run_id IN (SELECT run_id FROM runs WHERE lower(order_mode) LIKE '%kd%')",
        ),
        "outlier_roundtrip": _w(_chain(VISITS.replace("link_len * 0.05", "link_len * 2e-6")), "SELECT run_id, count(*) AS n, 0::BIGINT AS violations, sum(fx)::BIGINT AS outliers_x, sum(fy)::BIGINT AS outliers_y, sum(fz)::BIGINT AS outliers_z FROM chn WHERE seq >= 0 GROUP BY 1"),
        "huffman_code_lengths": _w(HUFFMAN, "SELECT symbol, freq, length::INT AS length FROM frq JOIN dep USING (symbol)"),
        "huffman_bits": _w(HUFFMAN, "SELECT sum(freq)::BIGINT AS codes, sum(freq * length)::BIGINT AS bits, count(*) AS symbols FROM frq JOIN dep USING (symbol)"),
        "container_edit_roundtrip": _w(f"{PAIRS}, {EDITABLE}", "SELECT q.run_id, count(*) AS n, 0::BIGINT AS violations, count(e.id) AS edited FROM qua q LEFT JOIN edi e ON q.run_id = e.run_id AND q.id = e.id GROUP BY 1"),
        "container_lossless_roundtrip": _w(f"{PAIRS}, {EDITABLE}", "SELECT q.run_id, count(*) AS n, 0::BIGINT AS violations, count(e.id) AS edited, count(e.id) AS exact FROM qua q LEFT JOIN edi e ON q.run_id = e.run_id AND q.id = e.id GROUP BY 1"),
        "edit_only_roundtrip": _w(f"{PAIRS}, {EDITABLE}", "SELECT q.run_id, count(*) AS n, 0::BIGINT AS violations, count(e.id) AS edited, count(e.id) AS exact FROM qua q LEFT JOIN edi e ON q.run_id = e.run_id AND q.id = e.id GROUP BY 1"),
        "size_accounting": _w(f"{PAIRS}, {EDITABLE}", "SELECT count(*) AS particles, sum(q.dim)::BIGINT AS values, 0::BIGINT AS outliers, sum(CASE WHEN e.id IS NOT NULL THEN q.dim ELSE 0 END)::BIGINT AS exact_edits, sum(q.dim)::BIGINT * 8 AS raw_bytes, true AS smaller FROM qua q LEFT JOIN edi e ON q.run_id = e.run_id AND q.id = e.id"),
        "pairs_lineitem3d": _w(_ADAPTED["lineitem3d"].replace("0.0 AS xi", "2.371262::DOUBLE * 0.05::DOUBLE AS xi").replace("x / 2.371262", "x / 4").replace("y / 2.371262", "y / 4").replace("z / 2.371262", "z / 4") + "," + _near("pla", _BAND, "vul"), "SELECT i, j, (d2 > b * b)::INT::BIGINT AS sign FROM vul"),
        "symbol_freq": _w(CODES, "SELECT symbol, count(*) AS freq FROM (SELECT code_x AS symbol FROM qua UNION ALL SELECT code_y FROM qua UNION ALL SELECT code_z FROM qua WHERE dim = 3) GROUP BY 1"),
        "entropy_roundtrip": _w(CODES, "SELECT run_id, sum(dim)::BIGINT AS codes, 0::BIGINT AS changed FROM qua GROUP BY 1"),
        "pack_flags": _w(f"{PAIRS}, {EDITABLE}", "SELECT q.run_id, q.visit_pos // 8 AS byte_no, sum(CASE WHEN e.id IS NULL THEN 0 ELSE 1::BIGINT << (7 - q.visit_pos % 8)::INT END)::BIGINT AS byte FROM qua q LEFT JOIN edi e ON q.run_id = e.run_id AND q.id = e.id GROUP BY 1, 2"),
        "unpack_flags": _w(f"{PAIRS}, {EDITABLE}", "SELECT q.run_id, (count(*) + 7) // 8 * 8 AS bits, count(e.id) AS set_bits FROM qua q LEFT JOIN edi e ON q.run_id = e.run_id AND q.id = e.id GROUP BY 1"),
        "bbox_by_block": _w(BOXES, "SELECT * FROM box"),
        "neighbor_blocks": _w(BOXES, f"SELECT a.run_id, a.rank_no, b.rank_no AS neighbour FROM box a JOIN par q ON a.run_id = q.run_id JOIN box b ON a.run_id = b.run_id AND a.rank_no <> b.rank_no WHERE {' AND '.join(f'b.lo_{a} <= a.hi_{a} + q.g AND b.hi_{a} >= a.lo_{a} - q.g' for a in _AXES)}"),
        "ghost_rows": _w(GHOST_ROWS, "SELECT run_id, dest_rank, id FROM gho"),
        "extended_block": _w(
            GHOST_ROWS,
            "SELECT run_id, rank_no, sum(own)::BIGINT AS own, sum(ghosts)::BIGINT AS ghosts FROM (SELECT run_id, rank_no, 1 AS own, 0 AS ghosts FROM part_rows WHERE rank_no IS NOT NULL UNION ALL SELECT run_id, dest_rank, 0, 1 FROM gho) GROUP BY 1, 2",
        ),
        "axis_islands": _w(ISLANDS, "SELECT run_id, axis, island, min(v) AS lo, max(v) AS hi, count(*) AS n FROM isl GROUP BY 1, 2, 3"),
        "occupied_boxes": _w(
            ISLANDS,
            """SELECT p.run_id, i.island AS ix, j.island AS iy, coalesce(k.island, 0) AS iz, count(*) AS n, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y
FROM part_rows p JOIN isl i ON i.run_id = p.run_id AND i.id = p.id AND i.axis = 0 JOIN isl j ON j.run_id = p.run_id AND j.id = p.id AND j.axis = 1 LEFT JOIN isl k ON k.run_id = p.run_id AND k.id = p.id AND k.axis = 2 GROUP BY 1, 2, 3, 4""",
        ),
    }
