"""Combining sources to target shares of all tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cinderloom.llm.sampling import bucket_of, draw
from cinderloom.session import ensure_checkpoint_dir

#: The tree's levels from the root down.
LEAF = ["domain", "lang", "source"]


def water_fill(nodes: DataFrame, parent: list[str], weight: str, supply: str, budget: str) -> Column:
    """Each node's share of its parent's ``budget``: by weight, at most its supply.

    What nodes can't fill goes to their siblings by weight. Nodes fill up in order of supply per unit of
    weight, so the full ones come first, and two running sums give the level of the rest.
    """
    w, s = F.col(weight), F.col(supply)
    siblings = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = siblings.orderBy(F.when(w > 0, s / w).otherwise(F.lit(float("inf"))), *[c for c in nodes.columns if c in LEAF])
    before = F.coalesce(F.sum(s).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(w).over(order.rowsBetween(0, W.unboundedFollowing))
    full = (w > 0) & (s * rest <= (F.col(budget) - before) * w)
    left = F.col(budget) - F.sum(F.when(full, s).otherwise(0.0)).over(siblings)
    level = left / F.nullif(F.sum(F.when(full, 0.0).otherwise(w)).over(siblings), F.lit(0.0))
    return F.when(full, s).otherwise(F.greatest(F.lit(0.0), F.coalesce(level * w, F.lit(0.0))))


def leaf_budgets(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Token budgets of the leaves of the tree domain, language, source: ``LEAF, tokens, max_repeats, weight, budget``.

    A source's target share is spread over its leaves by their tokens, and weights add up towards the root.
    Budgets go down the tree, at most a node's tokens times the repeats: what a leaf can't supply is
    filled by the other sources of its language and domain first, then by the domain's other languages,
    then by other domains. A source with tokens to spare so gets its share at least.
    ``total_tokens`` is by default all tokens of the listed sources.
    """
    leaves = documents.groupBy(*LEAF).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    wanted = targets.where("target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    share = F.col("tokens") / F.sum("tokens").over(W.partitionBy("source"))
    leaves = leaves.join(wanted, "source").withColumn("weight", F.col("target_share") * share).withColumn("supply", F.col("tokens") * F.col("max_repeats"))
    leaves = leaves.select(*LEAF, "tokens", "max_repeats", "weight", "supply")
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("tokens").over(W.partitionBy(F.lit(0)))
    parent, above = [], "_total"
    nodes = leaves.withColumn(above, total)
    for depth in (1, 2):
        keys = LEAF[:depth]
        level = nodes.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.sum("supply").alias("supply"), F.max(above).alias("_above"))
        level = level.withColumn(f"_{depth}", water_fill(level, parent, "weight", "supply", "_above")).select(*keys, f"_{depth}")
        nodes, parent, above = nodes.drop(above).join(level, keys), keys, f"_{depth}"
    return nodes.withColumn("budget", water_fill(nodes, parent, "weight", "supply", above)).select(*LEAF, "tokens", "max_repeats", "weight", "budget")


def seeded_prefix(items: DataFrame, keys: list[str], rest: str) -> DataFrame:
    """``items(keys, doc_id, n_tokens, h, rest)`` with ``taken``: 1 for the longest run from the start, in order of ``h``, within ``rest``.

    Prefix sums run over buckets of the order first and within the one bucket where the budget ends,
    so no task sorts a whole group.
    """
    items = items.withColumn("bucket", bucket_of(F.col("h")))
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = (
        items.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
        .withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    )
    inside = W.partitionBy(*keys, "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    placed = items.join(sums, [*keys, "bucket"])
    ends_here = (F.col("before") < F.col(rest)) & (F.col("before") + F.col("in_bucket") > F.col(rest))
    whole = placed.where(~ends_here).withColumn("taken", (F.col("before") + F.col("in_bucket") <= F.col(rest)).cast("long"))
    cut = placed.where(ends_here).withColumn("taken", (F.col("before") + F.sum("n_tokens").over(inside) <= F.col(rest)).cast("long"))
    return whole.unionByName(cut).drop("bucket", "before", "in_bucket")


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11) -> DataFrame:
    """``source, doc_id, n_tokens, repeats`` of the chosen documents of ``documents(doc_id, LEAF, n_tokens)``.

    A leaf's budget is met by whole epochs over its documents and a prefix, in seeded order, of one
    more; no document is used more than ``max_repeats`` times. What the leaves' last documents didn't fit into
    adds up for each source and is spent on a prefix, in another seeded order, of its documents that may be
    used again, so a source with tokens to spare stays below its budget by less than one document.
    Null languages and domains count as ``unknown``; documents without tokens or of sources that aren't
    listed are never chosen; a source listed twice counts with its larger share.
    """
    known = documents.where("n_tokens > 0 and source is not null").select(
        "doc_id", "source", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("domain", F.lit("unknown")).alias("domain"), "n_tokens"
    )
    ensure_checkpoint_dir(documents.sparkSession)
    budgets = _with_epochs(leaf_budgets(known, targets, total_tokens)).checkpoint()
    ordered = known.join(budgets.select(*LEAF, "epochs", "rest", "max_repeats"), LEAF).withColumn("h", draw(F.lit(str(seed)), F.col("epochs"), F.col("doc_id")))
    # Cut here, as the choice is looked at for what is left and again for the second prefix.
    first = seeded_prefix(ordered, LEAF, "rest").select("source", "doc_id", "n_tokens", "max_repeats", (F.col("epochs") + F.col("taken")).alias("uses")).checkpoint()
    spent = first.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("spent"))
    left = (
        budgets.groupBy("source").agg(F.sum("budget").alias("budget")).join(spent, "source")
        .select("source", (F.col("budget") - F.col("spent") + F.lit(1e-6)).alias("left"))
    )
    again = first.where("uses < max_repeats").join(left, "source").withColumn("h", draw(F.lit(f"{seed}+"), F.col("uses"), F.col("doc_id")))
    second = seeded_prefix(again, ["source"], "left").select("source", "doc_id", "n_tokens", (F.col("uses") + F.col("taken")).alias("repeats"))
    done = first.where("uses >= max_repeats").select("source", "doc_id", "n_tokens", F.col("uses").alias("repeats"))
    return second.unionByName(done).where("repeats > 0")


def _with_epochs(budgets: DataFrame) -> DataFrame:
    epochs = F.least(F.floor(F.col("budget") / F.col("tokens") + F.lit(1e-9)).cast("long"), F.col("max_repeats").cast("long"))
    left = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0.0)
    return budgets.withColumn("epochs", epochs).withColumn("rest", left)


def mix_shares(documents: DataFrame, targets: DataFrame, mix: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Every listed source with target and actual share, tokens available, wanted (its share of the total),
    budgeted (with the shortages of others) and chosen, and the deficit against what was wanted."""
    known = documents.where("n_tokens > 0 and source is not null").select(
        "source", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("domain", F.lit("unknown")).alias("domain"), "n_tokens"
    )
    available = known.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    budgets = leaf_budgets(known, targets, total_tokens).groupBy("source").agg(F.sum("budget").alias("budget_tokens"))
    chosen = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("chosen_tokens"), F.max("repeats").alias("most_repeats"))
    both = targets.join(available, "source", "left").join(budgets, "source", "left").join(chosen, "source", "left")
    both = both.fillna(0, ["available_tokens", "budget_tokens", "chosen_tokens", "most_repeats"])
    everything = W.partitionBy(F.lit(0))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("available_tokens").over(everything)
    both = both.withColumn("wanted_tokens", total * F.col("target_share"))
    return both.withColumn("actual_share", F.col("chosen_tokens") / F.nullif(F.sum("chosen_tokens").over(everything), F.lit(0))).withColumn(
        "deficit_tokens", F.greatest(F.lit(0.0), F.col("wanted_tokens") - F.col("chosen_tokens"))
    )
