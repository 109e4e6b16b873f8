"""Groups of records linked by chains of pairwise matches.

Randomised graph contraction: in every round each vertex hooks to the vertex
of its closed neighbourhood that comes first in a hash order drawn afresh for
the round, the edges are relabelled and deduplicated, and the hooks are kept
as one mapping table a round.  When no edge is left, the mappings are expanded
backwards.  Each round removes an expected constant share of the vertices
whatever the shape of the graph, so long chains take no more rounds than
stars, and the tables shrink geometrically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.scratch import Scratch

MAX_ROUNDS = 200


def connected_groups(pairs: DataFrame, a: str, b: str, seed: int = 17) -> DataFrame:
    """``group_id, elem`` of every id that is linked to another one.

    ``pairs`` holds one match a row in the long columns ``a`` and ``b``; its
    other columns are ignored, whatever their names.  ``group_id`` is the
    smallest id of the group.  Rows with a null on either side link nothing,
    ids linked only to themselves are left out, repeated and reversed pairs
    count once, and an empty table gives an empty result.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    u, v = pairs[a].cast("long"), pairs[b].cast("long")
    edges = pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).distinct()
    edges = scratch.save(edges, "edges0")

    rounds = 0
    while edges.limit(1).count():
        if rounds == MAX_ROUNDS:
            raise RuntimeError("the contraction did not end")
        order = lambda c, r=rounds: F.xxhash64(F.lit(seed + r), c)
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        hooks = (
            ends.groupBy("u")
            .agg(F.min(order(F.col("v"))).alias("h"), F.min_by("v", order(F.col("v"))).alias("v"))
            .select("u", F.when(order(F.col("u")) <= F.col("h"), F.col("u")).otherwise(F.col("v")).alias("r"))
        )
        hooks = scratch.save(hooks, f"hooks{rounds}")
        ru, rv = hooks.select("u", F.col("r").alias("ru")), hooks.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        left = edges.join(ru, "u").join(rv, "v").where("ru <> rv")
        left = left.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        edges = scratch.save(left, f"edges{rounds + 1}")
        scratch.drop(f"edges{rounds}")
        rounds += 1

    if rounds == 0:
        return edges.select(F.col("u").alias("group_id"), F.col("v").alias("elem"))
    labels = spark.read.schema("u long, r long").parquet(scratch.path(f"hooks{rounds - 1}"))
    for k in range(rounds - 2, -1, -1):
        hooks = spark.read.schema("u long, r long").parquet(scratch.path(f"hooks{k}"))
        above = labels.select(F.col("u").alias("r"), F.col("r").alias("top"))
        labels = scratch.save(hooks.join(above, "r", "left").select("u", F.coalesce("top", "r").alias("r")), f"labels{k}")
        scratch.drop(f"hooks{k + 1}", f"labels{k + 1}")
    smallest = scratch.save(labels.groupBy("r").agg(F.min("u").alias("group_id")), "smallest")  # a table of its own, so that a giant group is split in the join
    return labels.join(smallest, "r").select("group_id", F.col("u").alias("elem"))
