"""Scores of a reconstruction and of its clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_stats(points: DataFrame, recon: DataFrame, ranges: DataFrame) -> DataFrame:
    """Largest error, MSE over all axes, RMSE, RMSE over the largest range, PSNR, one row a run."""
    other = recon.select("run_id", "id", *[F.col(a).alias(f"r{a}") for a in "xyz"])
    d = {a: F.abs(F.col(a) - F.col(f"r{a}")) for a in "xyz"}
    stats = points.join(other, ["run_id", "id"]).groupBy("run_id", "dim").agg(
        F.max(F.greatest(*d.values())).alias("max_error"), F.sum(sum((e * e for e in d.values()), F.lit(0.0))).alias("square_error"), F.count("*").alias("n")
    )
    widest = ranges.select("run_id", F.greatest("range_x", "range_y", "range_z").alias("widest"))
    s = stats.join(widest, "run_id").withColumn("mse", F.col("square_error") / (F.col("dim") * F.col("n"))).withColumn("rmse", F.sqrt("mse"))
    s = s.withColumn("nrmse", F.col("rmse") / F.nullif("widest", F.lit(0.0)))
    return s.select("run_id", "n", "max_error", "mse", "rmse", "nrmse", (-20 * F.log10(F.nullif("nrmse", F.lit(0.0)))).alias("psnr"))


def contingency(one: DataFrame, other: DataFrame) -> DataFrame:
    """How many points each pair of clusters of two clusterings (run_id, id, cluster_id) shares."""
    both = one.select("run_id", "id", F.col("cluster_id").alias("one")).join(other.select("run_id", "id", F.col("cluster_id").alias("other")), ["run_id", "id"])
    return both.groupBy("run_id", "one", "other").agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return F.sum(n * (n - 1) / 2)


def pair_confusion(table: DataFrame) -> DataFrame:
    """Pairs of points together in both, one or neither clustering, one row a run, as doubles."""
    cells = table.groupBy("run_id").agg(_pairs(F.col("n")).alias("both"), F.sum("n").alias("points"))
    rows = table.groupBy("run_id", "one").agg(F.sum("n").alias("n")).groupBy("run_id").agg(_pairs(F.col("n")).alias("in_one"))
    cols = table.groupBy("run_id", "other").agg(F.sum("n").alias("n")).groupBy("run_id").agg(_pairs(F.col("n")).alias("in_other"))
    p = cells.join(rows, "run_id").join(cols, "run_id")
    p = p.select("run_id", F.col("both").alias("tp"), (F.col("in_other") - F.col("both")).alias("fp"), (F.col("in_one") - F.col("both")).alias("fn"), (F.col("points") * (F.col("points") - 1) / 2).alias("all"))
    return p.withColumn("tn", F.col("all") - F.col("tp") - F.col("fp") - F.col("fn")).drop("all")


def adjusted_rand(confusion: DataFrame) -> DataFrame:
    """Adjusted Rand index, 1 where it is undefined."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    below = (tp + fp) * (fp + tn) + (tp + fn) * (fn + tn)
    return confusion.withColumn("ari", F.coalesce(2 * (tp * tn - fp * fn) / F.nullif(below, F.lit(0.0)), F.lit(1.0)))


def matthews(confusion: DataFrame) -> DataFrame:
    """Matthews correlation, null where a margin is empty."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    below = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return confusion.withColumn("mcc", (tp * tn - fp * fn) / F.nullif(below, F.lit(0.0)))
