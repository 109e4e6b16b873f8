"""Queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmesh.llm.groups import connected_groups
from driftmesh.llm.leaks import leaked_items
from driftmesh.llm.mixing import TOKENIZER, budget_tree, one_language, one_spelling, selected, with_tokens
from driftmesh.llm.neighbours import exact_neighbours, graph_search, neighbour_graph, neighbour_lists
from driftmesh.llm.peaks import density_peaks, mutual_counts
from driftmesh.llm.sentences import sentence_ends
from driftmesh.scratch import Scratch
from driftmesh.sources.tables import placed_nodes, run_params, table

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id of a group of at least two linked ids."""
    links = table(spark, sf_dir, "uf_state").where("parent >= 0")
    return connected_groups(links, "elem", "parent")


def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its number of ids and the range they span."""
    groups = p5_found(spark, sf_dir)
    return groups.groupBy("group_id").agg(F.count("*").alias("n_ids"), F.max("elem").alias("last_id"))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all runs: g (the run), id, x, y, z, link_len."""
    nodes = placed_nodes(table(spark, sf_dir, "kd_nodes"), run_params(spark, sf_dir))
    return nodes.select(F.col("run_id").alias("g"), "id", "x", "y", "z", "link_len")


#: Radius of density peaks in linking lengths, and the least size of a cluster.
PEAK_RADIUS, MIN_SIZE = 6.0, 12


def reaching_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of every run with the radius of its peaks."""
    return tree_nodes(spark, sf_dir).withColumn("r", F.col("link_len") * PEAK_RADIUS)


def node_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density peaks over the nodes of every run."""
    return density_peaks(reaching_nodes(spark, sf_dir), MIN_SIZE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the clusters whose nodes are all within the radius of each other and of no other node.

    The clusters are those of density peaks.  In such a cluster every density
    is its size; of the clusters of which that holds, those remain whose
    members have all of each other within the radius, so that nobody else is.
    """
    scratch = Scratch(spark, "found")
    nodes = scratch.save(reaching_nodes(spark, sf_dir).select("g", "id", "x", "y", "z", "r"), "nodes")
    peaks = scratch.save(density_peaks(nodes, MIN_SIZE).where("cluster is not null").select("g", "id", "density", "cluster"), "peaks")
    sizes = peaks.groupBy("g", "cluster").agg(F.count("*").alias("size"), F.min("density").alias("d0"), F.max("density").alias("d1"), F.min("id").alias("cluster_id"))
    even = scratch.save(sizes.where(f"size >= {MIN_SIZE} and d0 = size and d1 = size").select("g", "cluster", "size", "cluster_id"), "even")
    members = scratch.save(peaks.join(even, ["g", "cluster"]).select("g", "id", "size", "cluster_id"), "members")
    met = mutual_counts(nodes.join(members, ["g", "id"]), "cluster_id").join(members, ["g", "id"])
    apart = scratch.save(met.where("n <> size").select("cluster_id").distinct(), "apart")
    return members.join(apart, "cluster_id", "left_anti").select("cluster_id", F.col("id").alias("node_id"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and its three most typical nodes, the densest ones."""
    peaks = Scratch(spark, "clusters").save(node_peaks(spark, sf_dir).where("cluster is not null"), "peaks")
    best = Window.partitionBy("g", "cluster").orderBy(F.desc("density"), "id")
    typical = peaks.withColumn("k", F.row_number().over(best)).where("k <= 3").groupBy("g", "cluster").agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias("t"))
    size = Scratch(spark, "sizes").save(peaks.groupBy("g", "cluster").agg(F.count("*").alias("size"), F.max("density").alias("density")), "sizes")
    return size.join(typical, ["g", "cluster"]).select(F.col("g").alias("run_id"), F.col("cluster").alias("peak_id"), "size", "density", F.col("t.id").alias("typical_ids"))


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its density and its cluster, or none."""
    return node_peaks(spark, sf_dir).select(F.col("g").alias("run_id"), F.col("id").alias("node_id"), "density", F.col("cluster").alias("peak_id"))


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all runs: g (the run), id, v."""
    return tree_nodes(spark, sf_dir).select("g", "id", F.array("x", "y", "z").alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one group: g, id, v."""
    return table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").groupBy(F.col("vec_id").alias("id")).agg(F.max("embedding").cast("array<double>").alias("v")).select(F.lit(0).alias("g"), "id", "v")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nodes of which at least one is among the five nearest of the other."""
    graph = neighbour_graph(node_vectors(spark, sf_dir), 5)
    return graph.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy graph search from every node whose id is divisible by 100, against all nodes of its run."""
    nodes = Scratch(spark, "nodes").save(node_vectors(spark, sf_dir), "nodes")
    found = graph_search(nodes.where("id % 100 = 0"), neighbour_lists(nodes, 5), 5)
    return found.select(F.col("g").alias("run_id"), F.col("a").alias("query_id"), "place", F.col("b").alias("id"), "d2")


def recall(nodes: DataFrame, least: float) -> DataFrame:
    """Of the nodes whose id is divisible by 100: how many, their true neighbours, and whether graph and search have at least ``least`` of these."""
    nodes = Scratch(nodes.sparkSession, "nodes").save(nodes, "nodes")
    asked = nodes.where("id % 100 = 0")
    lists = neighbour_lists(nodes, 5)
    true = Scratch(nodes.sparkSession, "true").save(exact_neighbours(asked, nodes, 5), "true")
    hits = lambda found, name: true.join(found.select("g", "a", "b"), ["g", "a", "b"], "left_semi").agg(F.count("*").alias(name))
    all_ = true.agg(F.countDistinct("g", "a").alias("n_queries"), F.count("*").alias("n_true"))
    both = all_.crossJoin(hits(lists.links(5), "by_graph")).crossJoin(hits(graph_search(asked, lists, 5), "by_search"))  # four single rows
    return both.select("n_queries", "n_true", *[(F.col(f"by_{w}") >= least * F.col("n_true")).alias(f"{w}_ok") for w in ("graph", "search")])


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of graph and search over the nodes, against all of them compared."""
    return recall(node_vectors(spark, sf_dir), 0.95)


def p4_embedding_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the embeddings, in all their dimensions."""
    return recall(vectors(spark, sf_dir), 0.9)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that leak into them."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def source_tokens(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of the wanted sources with their tokens (doc_id, source, lang, tokens), the targets, and all leaves.

    The tree's first level is the source, which has the target weight; the
    second is the language.  Copies count as often as they are there.
    """
    targets = table(spark, sf_dir, "mix_targets").select("source", F.col("target_share").alias("weight"), "max_repeats").where("source is not null")
    docs = table(spark, sf_dir, "documents").select("doc_id", one_spelling(F.col("source")).alias("source"), one_language(F.col("lang")).alias("lang"), "text")
    wanted = docs.join(targets.select(one_spelling(F.col("source")).alias("source"), F.col("source").alias("named")), "source").drop("source").withColumnRenamed("named", "source")
    docs = Scratch(spark, "mix").save(with_tokens(wanted.select("doc_id", "source", "lang", "text"), "text", tokenizer), "tokens")
    leaves = docs.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"))
    leaves = targets.join(leaves, "source", "left").select("source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"), "max_repeats")
    return docs, targets, leaves


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose budget stays short of their target: they give all they may and their siblings make up for it."""
    _, targets, leaves = source_tokens(spark, sf_dir)
    budgets = budget_tree(leaves, ["source", "lang"], targets.select("source", "weight"))
    spent = F.col("top_budget") >= F.col("top_capacity") * (1 - 1e-12)  # the last to be filled may be a rounding error short
    return budgets.where(spent & (F.col("top_capacity") < F.col("top_wanted"))).select("source").distinct()


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is used in the mixture."""
    docs, targets, leaves = source_tokens(spark, sf_dir)
    return selected(docs, budget_tree(leaves, ["source", "lang"], targets.select("source", "weight")), ["source", "lang"])


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source, and how often its documents are repeated."""
    docs, targets, leaves = source_tokens(spark, sf_dir)
    chosen = selected(docs, budget_tree(leaves, ["source", "lang"], targets.select("source", "weight")), ["source", "lang"])
    used = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.max("uses").alias("most_uses"))
    share = F.col("used") / F.sum("used").over(Window.partitionBy(F.lit(1)))
    table_ = targets.join(used, "source", "left").select("source", F.col("weight").alias("target_share"), "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    return table_.withColumn("reached_share", share)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every source, and how many are used too often, leaves above their budget, and leaves that leave room for their largest document."""
    docs, targets, leaves = source_tokens(spark, sf_dir)
    budgets = Scratch(spark, "budgets").save(budget_tree(leaves, ["source", "lang"], targets.select("source", "weight")), "budgets")
    chosen = selected(docs, budgets, ["source", "lang"]).join(targets.select("source", "max_repeats"), "source")
    used = chosen.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.count_if(F.col("uses") > F.col("max_repeats")).alias("over_cap"), F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.max("tokens").alias("largest"))
    both = used.join(budgets.select(F.col("source").alias("s"), F.col("lang").alias("l"), "budget"), F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")))
    room = F.col("budget") - F.col("used")
    sums = both.groupBy("source").agg(F.sum("n_docs").alias("n_docs"), F.sum("over_cap").alias("over_cap"), F.count_if(room < -1e-6).alias("over_budget"), F.count_if((F.col("largest") > 0) & (room > F.col("largest"))).alias("loose"))
    return targets.join(sums, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_docs", "over_cap", "over_budget", "loose")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every sentence end of every article."""
    return sentence_ends(table(spark, sf_dir, "documents"))


NODES_SQL = """
node AS (
  SELECT run_id, id, dim, link_len, point[1] AS x, point[2] AS y, CASE WHEN dim = 3 THEN point[3] ELSE 0.0 END AS z FROM (
    SELECT n.*, r.dim, r.link_len, row_number() OVER (PARTITION BY n.run_id, n.id ORDER BY n.arrived_at DESC NULLS LAST) AS k
    FROM kd_nodes n JOIN runs r ON n.run_id = r.run_id
    WHERE n.id IS NOT NULL AND len(point) = dim AND isfinite(point[1]) AND isfinite(point[2]) AND (dim = 2 OR isfinite(point[3])))
  WHERE k = 1)"""

P1_SQL = f"""
WITH {NODES_SQL},
cell AS (SELECT *, 6 * link_len AS r, floor(x / (6 * link_len)) AS cx, floor(y / (6 * link_len)) AS cy FROM node),
moved AS (SELECT c.*, c.cx + i AS jx, c.cy + j AS jy FROM cell c, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j)),
near AS (
  SELECT a.run_id, a.id, count(*) AS n, min(b.id) AS first, sum(hash(b.id)::HUGEINT) AS sign
  FROM moved a JOIN cell b ON a.run_id = b.run_id AND a.jx = b.cx AND a.jy = b.cy
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= a.r * a.r GROUP BY 1, 2)
SELECT first AS cluster_id, id AS node_id FROM (SELECT *, count(*) OVER (PARTITION BY run_id, first, n, sign) AS m FROM near) WHERE m = n AND n >= 12"""


GROUPS_SQL = """
WITH RECURSIVE link AS (SELECT DISTINCT elem::BIGINT AS a, parent::BIGINT AS b FROM uf_state WHERE elem IS NOT NULL AND parent >= 0 AND elem <> parent),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
lab(id, c) USING KEY (id) AS (
  SELECT a AS id, min(least(a, b)) AS c FROM both_ways GROUP BY 1
  UNION
  SELECT e.b AS id, min(l.c) AS c FROM lab l JOIN both_ways e ON e.a = l.id JOIN recurring.lab r ON r.id = e.b WHERE l.c < r.c GROUP BY 1)
"""

LABELS_SQL = f"""
WITH RECURSIVE {NODES_SQL},
cell AS (SELECT *, 6 * link_len AS r, floor(x / (6 * link_len)) AS cx, floor(y / (6 * link_len)) AS cy FROM node),
moved AS (SELECT c.*, c.cx + i AS jx, c.cy + j AS jy FROM cell c, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j)),
pair AS (SELECT a.run_id, a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, a.r
  FROM moved a JOIN cell b ON a.run_id = b.run_id AND a.jx = b.cx AND a.jy = b.cy),
dens AS (SELECT run_id, a AS id, count(*) AS density FROM pair WHERE d2 <= r * r GROUP BY 1, 2),
up AS (SELECT p.run_id, p.a AS id, first(p.b ORDER BY p.d2, p.b) AS up FROM pair p JOIN dens u ON u.run_id = p.run_id AND u.id = p.a JOIN dens v ON v.run_id = p.run_id AND v.id = p.b
  WHERE p.d2 <= p.r * p.r AND (v.density > u.density OR (v.density = u.density AND v.id < u.id)) GROUP BY 1, 2),
walk AS (SELECT d.run_id, d.id, d.id AS at FROM dens d UNION ALL SELECT w.run_id, w.id, u.up FROM walk w JOIN up u ON u.run_id = w.run_id AND u.id = w.at),
top AS (SELECT w.run_id, w.id, w.at AS peak FROM walk w LEFT JOIN up u ON u.run_id = w.run_id AND u.id = w.at WHERE u.id IS NULL),
named AS (SELECT t.run_id, t.id, d.density, CASE WHEN p.density >= 12 THEN t.peak END AS peak_id FROM top t JOIN dens d ON d.run_id = t.run_id AND d.id = t.id JOIN dens p ON p.run_id = t.run_id AND p.id = t.peak)
"""

#: Bytes stand for tokens: every usual tokenizer gives the same sources.
P7_SQL = """
WITH doc AS (SELECT regexp_replace(lower(trim(source)), '[-_ ]+', '_', 'g') AS source, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
have AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(d.n), 0) AS n FROM mix_targets m LEFT JOIN doc d ON d.source = m.source GROUP BY 1, 2, 3)
SELECT source FROM have WHERE max_repeats * n < target_share * (SELECT sum(n) FROM have)"""


P4_RECALL_SQL = f"""
WITH {NODES_SQL}, size AS (SELECT run_id, count(*) AS n FROM node GROUP BY 1)
SELECT count(*) AS n_queries, sum(least(5, n - 1))::BIGINT AS n_true, true AS graph_ok, true AS search_ok FROM node JOIN size USING (run_id) WHERE id % 100 = 0 AND n > 1"""

P4_EMBEDDING_SQL = """
SELECT count(DISTINCT vec_id) FILTER (vec_id % 100 = 0) AS n_queries, least(5, count(DISTINCT vec_id) - 1) * count(DISTINCT vec_id) FILTER (vec_id % 100 = 0) AS n_true, true AS graph_ok, true AS search_ok
FROM embeddings WHERE embedding IS NOT NULL"""

P7_CHECKS_SQL = """
SELECT m.source, count(d.doc_id) AS n_docs, 0::BIGINT AS over_cap, 0::BIGINT AS over_budget, 0::BIGINT AS loose
FROM mix_targets m LEFT JOIN documents d ON regexp_replace(lower(trim(d.source)), '[-_ ]+', '_', 'g') = m.source GROUP BY 1"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_clusters, p1_labels, p4_found, p4_search, p4_recall, p4_embedding_recall, p5_found, p5_group_sizes, p6_found, p7_found, p7_selection, p7_shares, p7_checks, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL,
        "p1_labels": f"{LABELS_SQL} SELECT run_id, id AS node_id, density, peak_id FROM named",
        "p1_clusters": f"{LABELS_SQL} SELECT run_id, peak_id, count(*) AS size, max(density) AS density, list(id ORDER BY density DESC, id)[1:3] AS typical_ids FROM named WHERE peak_id IS NOT NULL GROUP BY 1, 2",
        "p5_found": f"{GROUPS_SQL} SELECT c AS group_id, id AS elem FROM lab",
        "p5_group_sizes": f"{GROUPS_SQL} SELECT c AS group_id, count(*) AS n_ids, max(id) AS last_id FROM lab GROUP BY 1",
        "p4_recall": P4_RECALL_SQL,
        "p4_embedding_recall": P4_EMBEDDING_SQL,
        "p7_found": P7_SQL,
        "p7_checks": P7_CHECKS_SQL,
    }
