"""Joins of intervals within an entity that don't pair everything with everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def overlapping(left: DataFrame, right: DataFrame, key: str, width: float = 30.0) -> DataFrame:
    """``a, b, overlap, apart`` of all overlapping pairs of ``left(key, a, s, e)`` and ``right(key, b, s, e)``: rows meet in slices of the time
    line, each pair in the first slice that both cover. ``apart`` is the distance of the midpoints. Spans are finite and not empty."""
    first, last = F.floor(F.col("s") / width).cast("long"), F.floor(F.col("e") / width).cast("long")
    cut = lambda df, n: df.select(key, n, F.col("s").alias(f"s{n}"), F.col("e").alias(f"e{n}"), first.alias(f"f{n}"), F.explode(F.sequence(first, last)).alias("slice"))
    met = cut(left, "a").join(cut(right, "b"), [key, "slice"]).where("slice = greatest(fa, fb) and sa < eb and sb < ea")
    return met.select("a", "b", (F.least("ea", "eb") - F.greatest("sa", "sb")).alias("overlap"), F.abs((F.col("sa") + F.col("ea")) / 2 - (F.col("sb") + F.col("eb")) / 2).alias("apart"))


def nearest(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``a, b, dist``: of ``right`` the row whose start or end lies nearest to that of each row of ``left``, the least ``b`` on ties.

    Only the neighbours in the order of starts and in that of ends come into question, so each side is sorted, not paired.
    """
    found = None
    for end in ("s", "e"):
        sides = left.select(key, F.col("a"), F.lit(None).cast("long").alias("b"), F.col(end).alias("t")).unionByName(right.select(key, F.lit(None).cast("long").alias("a"), "b", F.col(end).alias("t")))
        # Of equal places the least b is met last from before and first from after.
        before = W.partitionBy(key).orderBy("t", F.desc_nulls_last("b")).rowsBetween(W.unboundedPreceding, 0)
        at = F.when(F.col("b").isNotNull(), F.struct("t", "b"))
        after = W.partitionBy(key).orderBy("t", F.asc_nulls_first("b")).rowsBetween(0, W.unboundedFollowing)
        near = sides.withColumns({"x": F.last(at, ignorenulls=True).over(before), "y": F.first(at, ignorenulls=True).over(after)}).where("a is not null")
        each = near.select("a", "t", F.explode(F.array_compact(F.array("x", "y"))).alias("z")).select("a", F.col("z.b").alias("b"), F.abs(F.col("t") - F.col("z.t")).alias("dist"))
        found = each if found is None else found.unionByName(each)
    return found.groupBy("a").agg(F.min(F.struct("dist", "b")).alias("m")).select("a", "m.b", "m.dist")
