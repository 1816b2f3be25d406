"""Samples whose categories have target shares, and mixes of sources with token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKETS = 1024


def draw(*parts: Column | str, nth: int = 0) -> Column:
    """A reproducible draw in [0, 2**32) from the parts' MD5; the same in any engine. ``nth`` 0 to 3 are independent."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 8 * nth + 1, 8), 16, 10).cast("long")


def bucket_of(h: Column) -> Column:
    return F.shiftright(h, 22)


def category_key(text: Column) -> Column:
    """Categories compare trimmed, in lower case, with runs of blanks and hyphens as one underscore."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")


def category_candidates(items: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Distinct items of each targeted category: ``plan_id, category, item, pos, bucket, h``.

    ``bucket`` decides on acceptance, ``h``, an independent draw, on what is cut off again.

    ``items(item, pos, field_name, category)``; an item that occurs again counts once, at its first
    ``pos``. Rows with a null item or category count for nothing.
    """
    wanted = targets.select("plan_id", "field_name", category_key(F.col("category")).alias("category")).distinct()
    return (
        items.where("item is not null and category is not null")
        .withColumn("category", category_key(F.col("category")))
        .join(wanted, ["field_name", "category"])
        .groupBy("plan_id", "category", "item")
        .agg(F.min("pos").alias("pos"))
        .withColumn("bucket", bucket_of(draw(F.lit(str(seed)), F.col("plan_id"), F.col("item").cast("string"))))
        .withColumn("h", draw(F.lit(str(seed)), F.col("plan_id"), F.col("item").cast("string"), nth=1))
    )


def _plan_needs(targets: DataFrame) -> DataFrame:
    share = F.ceil(F.round(F.col("sample_size") * F.col("target_share"), 6)).cast("long")
    return targets.select(
        "plan_id",
        category_key(F.col("category")).alias("category"),
        "target_share",
        F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.coalesce(share, F.lit(0))).alias("need"),
    )


def acceptance(candidates: DataFrame, targets: DataFrame, oversample: float = 1.1) -> DataFrame:
    """``plan_id, category, target_share, need, available, accept`` of every target.

    ``accept`` is how many of the BUCKETS of the draw are accepted: the need's ratio to what is observed, a
    little above it. Where the draws of a category happen to fall short even so, all are accepted.
    """
    by_category = W.partitionBy("plan_id", "category")
    needs = _plan_needs(targets)
    share = F.least(F.lit(float(BUCKETS)), F.ceil(F.col("need") / F.col("available") * F.lit(oversample * BUCKETS)) + 1)
    counted = (
        candidates.groupBy("plan_id", "category", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .join(needs.select("plan_id", "category", "need"), ["plan_id", "category"])
        .withColumn("available", F.sum("n").over(by_category))
        .withColumn("accept", share)
        .groupBy("plan_id", "category", "need", "available", "accept")
        .agg(F.sum(F.when(F.col("bucket") < F.col("accept"), F.col("n")).otherwise(0)).alias("accepted"))
        .select("plan_id", "category", "available", F.when(F.col("accepted") >= F.col("need"), F.col("accept")).otherwise(float(BUCKETS)).alias("accept"))
    )
    return needs.join(counted, ["plan_id", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0)))


def proportional_sample(candidates: DataFrame, targets: DataFrame, oversample: float = 1.1) -> DataFrame:
    """The sample: ``plan_id, category, item, pos``; of each target as many as it needs, or all there are.

    Candidates are accepted independently, with a probability a little above the ratio of need to
    observed. Counts are then made exact: the accepted are counted by buckets of a second draw, and the
    bucket where the need is reached is cut by rank, so no task ever sorts a whole category.
    """
    by_category = W.partitionBy("plan_id", "category")
    below = by_category.orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    rates = acceptance(candidates, targets, oversample).select("plan_id", "category", "need", "accept")
    accepted = candidates.join(rates, ["plan_id", "category"]).where("bucket < accept").drop("accept").withColumn("cut", bucket_of(F.col("h")))
    quotas = (
        accepted.groupBy("plan_id", "category", "need", "cut").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
        .where("before < need")
        .select("plan_id", "category", "cut", (F.col("need") - F.col("before")).alias("quota"), "n")
    )
    chosen = accepted.drop("need").join(quotas, ["plan_id", "category", "cut"])
    whole = chosen.where("quota >= n")
    ranked = W.partitionBy("plan_id", "category", "cut").orderBy("h", "item")
    last = chosen.where("quota < n").withColumn("_r", F.row_number().over(ranked)).where("_r <= quota").drop("_r")
    return whole.unionByName(last).select("plan_id", "category", "item", "pos")


def sampling_report(candidates: DataFrame, targets: DataFrame, oversample: float = 1.1) -> DataFrame:
    """Each target with what is available, what the sample took and what it fell short of.

    ``plan_id, category, target_share, need, available, taken, deficit``. A category without
    candidates is reported with zeros; empty targets give an empty report.
    """
    taken = proportional_sample(candidates, targets, oversample).groupBy("plan_id", "category").agg(F.count(F.lit(1)).alias("taken"))
    have = F.coalesce("taken", F.lit(0))
    return (
        acceptance(candidates, targets, oversample)
        .join(taken, ["plan_id", "category"], "left")
        .select(
            "plan_id",
            "category",
            "target_share",
            "need",
            "available",
            have.alias("taken"),
            F.greatest(F.col("need") - have, F.lit(0)).cast("long").alias("deficit"),
        )
    )
