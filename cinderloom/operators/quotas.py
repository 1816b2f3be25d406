"""Exact samples by quota, splits and rebalancing, in a seeded order and without sorting whole groups.

Quotas are made from tables of group counts, which are as small as the number of groups; rows are then cut by
histograms of their draws, so only the one bucket in which a quota ends is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET_BITS = 50


def order_hash(seed: str, *keys: str | Column) -> Column:
    """A reproducible 60-bit draw from MD5; its order is that of the hexadecimal digest's first 15 signs."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def take(items: DataFrame, quotas: DataFrame, keys: list[str], h: str, id_: str, quota: str = "quota") -> DataFrame:
    """The first ``quota`` rows of each group of ``items`` in the order of ``h``, then ``id_``; groups without a quota give none.

    A null key matches a null one. A negative or null quota takes nothing.
    """
    kept = items.columns
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    bucketed = items.withColumn("_bucket", F.shiftright(F.col(h), BUCKET_BITS))
    below = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    cuts = (
        sums.alias("a").join(quotas.select(*keys, F.col(quota).alias("_q")).alias("b"), same("a", "b"))
        .select("a.*", (F.col("_q") - F.col("_before")).alias("_left")).where("_left > 0")
    )
    placed = bucketed.alias("a").join(cuts.alias("b"), [*same("a", "b"), F.col("a._bucket") == F.col("b._bucket")]).select("a.*", "b._n", "b._left")
    ranked = W.partitionBy(*keys, "_bucket").orderBy(h, id_)
    cut = placed.where("_left < _n").withColumn("_r", F.row_number().over(ranked)).where("_r <= _left").select(*kept)
    return placed.where("_left >= _n").select(*kept).unionByName(cut)


def numbered(items: DataFrame, keys: list[str], h: str, id_: str) -> DataFrame:
    """``items`` with ``rn``, their place in their group in the order of ``h``, then ``id_``, from 1; buckets are ranked, not groups."""
    kept = items.columns
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_bucket"]]
    bucketed = items.withColumn("_bucket", F.shiftright(F.col(h), BUCKET_BITS))
    below = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    placed = bucketed.alias("a").join(sums.alias("b"), same).select("a.*", "b._before")
    inside = W.partitionBy(*keys, "_bucket").orderBy(h, id_)
    return placed.withColumn("rn", F.col("_before") + F.row_number().over(inside)).select(*kept, "rn")


def proportional_quotas(counts: DataFrame, parent: list[str], key: str, target: Column) -> DataFrame:
    """``counts(parent, key, n)`` with ``quota``: the target's share by size, half-even rounded, the last key in order takes what is left.

    No more than there is and no less than 0; all of a parent that has no more than its target.
    """
    siblings = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = siblings.orderBy(F.asc_nulls_last(key))
    rows = counts.withColumn("_all", F.sum("n").over(siblings)).withColumn("_t", target.cast("long")).withColumn("_last", F.lead("n").over(order).isNull())
    rows = rows.withColumn("_share", F.least(F.bround(F.col("_t") * F.col("n") / F.col("_all")).cast("long"), F.col("n")))
    others = F.sum(F.when(~F.col("_last"), F.col("_share")).otherwise(0)).over(siblings)
    left = F.greatest(F.lit(0).cast("long"), F.least(F.col("_t") - others, F.col("n")))
    return rows.withColumn("quota", F.when(F.col("_all") <= F.col("_t"), F.col("n")).when(F.col("_last"), left).otherwise(F.col("_share"))).drop("_all", "_t", "_last", "_share")


def even_quotas(counts: DataFrame, parent: list[str], key: str, target: Column) -> DataFrame:
    """``counts`` with ``quota``: equal parts, one more for the largest while a remainder lasts, and what small keys can't use for the largest first."""
    siblings = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = siblings.orderBy(F.desc("n"), F.asc_nulls_last(key))
    t = target.cast("long")
    rows = counts.withColumn("_t", t).withColumn("_g", F.count(F.lit(1)).over(siblings)).withColumn("_i", F.row_number().over(order))
    rows = rows.withColumn("_base", F.least(F.col("n"), F.floor(F.col("_t") / F.col("_g")) + (F.col("_i") <= F.col("_t") % F.col("_g")).cast("long")))
    rows = rows.withColumn("_over", F.col("_t") - F.sum("_base").over(siblings)).withColumn("_free", F.col("n") - F.col("_base"))
    before = F.coalesce(F.sum("_free").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("_free"), F.col("_over") - before))
    return rows.withColumn("quota", F.col("_base") + extra).drop("_t", "_g", "_i", "_base", "_over", "_free")


def small_whole_quotas(counts: DataFrame, parent: list[str], key: str, target: Column) -> DataFrame:
    """``counts`` with ``quota``: keys of no more than an equal part come whole, the others share the rest evenly, the largest first in line for the remainder."""
    siblings = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    rows = counts.withColumn("_t", target.cast("long")).withColumn("_all", F.sum("n").over(siblings))
    rows = rows.withColumn("_small", F.col("n") <= F.floor(F.col("_t") / F.count(F.lit(1)).over(siblings)))
    rows = rows.withColumn("_rest", F.col("_t") - F.sum(F.when(F.col("_small"), F.col("n")).otherwise(0)).over(siblings)).withColumn("_large", F.count_if(~F.col("_small")).over(siblings))
    rank = F.row_number().over(siblings.orderBy(F.col("_small"), F.desc("n"), F.asc_nulls_last(key)))
    share = F.floor(F.col("_rest") / F.col("_large"))
    more = (rank <= F.col("_rest") - share * F.col("_large")).cast("long")
    return rows.withColumn("quota", F.when(F.col("_all") <= F.col("_t"), F.col("n")).when(F.col("_small"), F.col("n")).otherwise(F.least(F.col("n"), share + more))).drop("_t", "_all", "_small", "_rest", "_large")


def cell_quotas(counts: DataFrame, keys: list[str], target: int, seed: str) -> DataFrame:
    """``counts(keys, n)`` with ``quota``: an equal part for every cell, one at least, and the remainder from cells with more, in a seeded order."""
    everything = W.partitionBy(F.lit(0))
    rows = counts.withColumn("_cells", F.count(F.lit(1)).over(everything)).withColumn("_per", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(target) / F.col("_cells")).cast("long")))
    rows = rows.withColumn("_base", F.least("n", "_per")).withColumn("_left", F.lit(target) - F.col("_per") * F.col("_cells")).withColumn("_free", F.col("n") - F.col("_base"))
    order = everything.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(k, F.lit("")) for k in keys]))).rowsBetween(W.unboundedPreceding, -1)
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("_free"), F.col("_left") - F.coalesce(F.sum("_free").over(order), F.lit(0))))
    return rows.withColumn("quota", F.col("_base") + extra).drop("_cells", "_per", "_base", "_left", "_free")


def group_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def interleaved(counts: DataFrame, key: str, batches: str, seed: str, jitter: float = 0.5) -> DataFrame:
    """``key, batch, place`` of every batch of ``counts(key, batches)``: batch i stands at (i + a seeded jitter) over its key's number of batches."""
    each = counts.where(F.col(batches) > 0).select(key, batches, F.explode(F.sequence(F.lit(0).cast("long"), F.col(batches) - 1)).alias("batch"))
    noise = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, "batch")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return each.select(key, "batch", ((F.col("batch") + noise * F.lit(jitter)) / F.col(batches)).alias("place"))
