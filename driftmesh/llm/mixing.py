"""Mixing sources to target weights.

The sources and what they divide into form a tree.  Weights are propagated
from the root to the leaves as budgets; what a child cannot supply within its
repeats goes to its siblings in proportion to their weights, and only what the
whole family cannot supply goes to the next family up.  A leaf fills its
budget with whole epochs and, of the next epoch in seeded order, a prefix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vocabulary of a public byte-level tokenizer, token and rank a line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Ranges of the seeded order by which a leaf's prefix is found; only one of them is ordered row by row.
RANGES = 4096


def one_spelling(c: Column) -> Column:
    """A name in lower case without outer blanks, its inner blanks and hyphens made underscores; null if nothing is left."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s", " "))), r"[-_ ]+", "_")
    return F.when(plain != "", plain)


def one_language(c: Column) -> Column:
    """A language code without its suffix."""
    return F.regexp_extract(one_spelling(c), "^([a-z]+)", 1)


def with_tokens(texts: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``texts`` with ``tokens``, the tokens of the column ``text``, in its place; a null text has none."""
    keep = [c for c in texts.columns if c != text]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encode = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    schema = ", ".join(f"{n} {t}" for n, t in texts.dtypes if n != text) + ", tokens long"
    return texts.select(*keep, text).mapInArrow(count, schema)


def budget_tree(leaves: DataFrame, levels: Sequence[str], weights: DataFrame, total: int | None = None) -> DataFrame:
    """Every leaf's budget of tokens.

    ``leaves``: the columns of ``levels`` (root's children first; their
    combination is unique), tokens, max_repeats.  ``weights``: the first
    level and its ``weight``; further levels are weighted by their tokens.
    ``total`` is what is to be mixed, by default the tokens of all leaves.
    Result: the levels, tokens, capacity (max_repeats * tokens), budget, and
    of the first level top_wanted, its share of the total, top_capacity and
    top_budget, what it is given once shortages are passed on.
    A first level without a weight gets nothing; where everything together
    has less than the total, all of it is used.  Every table may be empty.
    """
    nodes = leaves.withColumn("capacity", F.col("tokens") * F.col("max_repeats"))
    everything = F.lit(float(total)) if total is not None else F.sum("tokens").over(Window.partitionBy(F.lit(1))).cast("double")
    frame = nodes.groupBy(levels[0]).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").cast("double").alias("capacity")).join(weights, levels[0])
    frame = frame.withColumn("whole", everything).withColumn("budget", F.least(F.col("whole"), F.sum("capacity").over(Window.partitionBy(F.lit(1)))))
    frame = _filled(frame, [F.lit(1)], "budget").withColumn("top_wanted", F.col("weight") * F.col("whole")).withColumn("top_capacity", F.col("capacity")).withColumn("top_budget", F.col("budget"))
    for k in range(1, len(levels)):
        parent, here = list(levels[:k]), list(levels[: k + 1])
        below = nodes.groupBy(*here).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").cast("double").alias("capacity")).withColumn("weight", F.col("tokens").cast("double"))
        up = frame.select(*[F.col(c).alias(f"up_{c}") for c in parent], "budget", "top_wanted", "top_capacity", "top_budget")
        on = [below[c].eqNullSafe(up[f"up_{c}"]) for c in parent]
        frame = _filled(below.join(up, on).drop(*[f"up_{c}" for c in parent]), parent, "budget")
    return frame.select(*levels, "tokens", "capacity", "budget", "top_wanted", "top_capacity", "top_budget")


def _filled(children: DataFrame, parent: Sequence, budget: str) -> DataFrame:
    """The parent's budget poured into its children by weight, none above its capacity.

    Children are full in order of capacity over weight.  If those before one
    are full, the rest stands at ``level`` per weight in all others; the
    highest such level is the true one.
    """
    full = Window.partitionBy(*parent).orderBy(F.expr("case when weight > 0 then capacity / weight end").asc_nulls_last(), "capacity")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.nullif(F.sum("weight").over(after), F.lit(0.0))
    poured = children.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy(*parent)))
    return poured.withColumn("budget", F.coalesce(F.least("capacity", F.col("level") * F.col("weight")), F.lit(0.0))).drop("level")


def selected(docs: DataFrame, budgets: DataFrame, leaf: Sequence[str], seed: int = 7) -> DataFrame:
    """How often every document is used.

    ``docs``: doc_id, tokens and the ``leaf`` columns.  ``budgets``: the leaf
    columns, tokens, budget.  Result: doc_id, the leaf columns, tokens, uses.
    An epoch uses each document of its leaf once; the last, partial epoch is
    the longest prefix of the documents in seeded order that fits what is
    left; where nothing is left there is no such epoch, so a budget within a
    leaf's capacity never repeats a document too often.  Documents of equal
    hash are ordered by id; documents of no leaf are not used and left out,
    and a leaf without tokens is not used.
    """
    b = budgets.select(*[F.col(c).alias(f"b_{c}") for c in leaf], F.floor(F.col("budget") / F.nullif("tokens", F.lit(0))).alias("epochs"), (F.col("budget") - F.floor(F.col("budget") / F.nullif("tokens", F.lit(0))) * F.col("tokens")).alias("rest"))
    on = [docs[c].eqNullSafe(b[f"b_{c}"]) for c in leaf]
    placed = docs.join(b, on).drop(*[f"b_{c}" for c in leaf])
    placed = placed.withColumn("order", F.xxhash64("doc_id", F.lit(seed), F.coalesce("epochs", F.lit(0)))).withColumn("range", F.pmod(F.shiftrightunsigned("order", 40), F.lit(RANGES)))
    ranges = placed.groupBy(*leaf, "range").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    so_far = F.sum("sum").over(Window.partitionBy(*leaf).orderBy("range"))
    cut = ranges.withColumn("upto", so_far).where("upto > rest").groupBy(*leaf).agg(F.min(F.struct("range", (F.col("upto") - F.col("sum")).alias("taken"))).alias("cut"))
    cut = cut.select(*[F.col(c).alias(f"c_{c}") for c in leaf], F.col("cut.range").alias("at"), F.col("cut.taken").alias("taken"))
    split = placed.join(cut, [placed[c].eqNullSafe(cut[f"c_{c}"]) for c in leaf], "left").drop(*[f"c_{c}" for c in leaf])
    sure = split.where("at is null or range <> at").withColumn("in", (F.coalesce(F.col("range") < F.col("at"), F.lit(False)) & (F.col("rest") > 0)).cast("int"))
    order = Window.partitionBy(*leaf).orderBy("order", "doc_id")
    edge = split.where("range = at").withColumn("in", ((F.col("taken") + F.sum("tokens").over(order) <= F.col("rest")) & (F.col("rest") > 0)).cast("int"))
    both = sure.unionByName(edge)
    return both.select("doc_id", *leaf, "tokens", (F.coalesce("epochs", F.lit(0)) + F.col("in")).alias("uses"))
