"""Registered core queries against their SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

from driftmesh.plans.queries import oracle_sql, queries

SHORT = (
    "p2_found", "p2_rank_stats", "p3_found", "kd_codes", "outlier_roundtrip", "trailing_gaps", "cell_assign", "cell_offsets", "cell_gap_runs", "cell_decode_coords", "visit_order", "quantize_codes", "decode_recon",
    "fof_links", "fof_clusters", "vulnerable_pairs", "link_confusion", "pgd_gradient0", "lossless_edit", "pack_flags", "neighbor_blocks", "ghost_rows", "occupied_boxes", "arrival_windows",
)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*'}')")
    return con


@pytest.mark.parametrize("name", SHORT)
def test_query_equals_its_sql(spark, sf_dir, duck, tmp_path, name):
    queries()[name](spark, sf_dir).write.parquet(str(tmp_path / "out"))
    got, want = f"read_parquet('{tmp_path}/out/*.parquet')", f"({oracle_sql()[name]})"
    columns = ", ".join(sorted(r[0] for r in duck.execute(f"DESCRIBE SELECT * FROM {got}").fetchall()))
    count = lambda q: duck.execute(f"SELECT count(*) FROM {q}").fetchone()[0]
    duck.execute(f"CREATE OR REPLACE TABLE wanted AS SELECT * FROM {want}")
    assert count(got) == count("wanted") > 0
    assert count(f"(SELECT {columns} FROM {got} EXCEPT ALL SELECT {columns} FROM wanted)") == 0


def test_every_query_has_a_description_and_sql_belongs_to_a_query():
    assert all(q.__doc__ for q in queries().values()) and set(oracle_sql()) <= set(queries())
