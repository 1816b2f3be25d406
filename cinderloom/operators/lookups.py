"""Lookups with fallbacks, checked merges, exclusions through arrays, exact ranks without whole-group sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def unique_rows(build: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """The rows of ``build`` whose key occurs once; with ``strict`` a repeated key is an error when the rows are read."""
    counted = build.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    if strict:
        told = F.concat_ws(" ", F.lit("repeated key:"), *[F.col(k).cast("string") for k in keys])
        return counted.where(F.when(F.col("_n") > 1, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).drop("_n")
    return counted.where("_n = 1").drop("_n")


def last_rows(build: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last in ``order``, by partial aggregation."""
    others = [c for c in build.columns if c not in keys]
    return build.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def index_then_content(probe: DataFrame, build: DataFrame, index: str, content: list[str], target: str) -> DataFrame:
    """``probe`` with ``target`` and ``way``: the build row at the probe's index if its content is the probe's (``index``), else the only
    row of that content (``content``), else none (null)."""
    at = build.select(F.col(index).alias("_i"), F.col(target).alias("_ti"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(content)])
    same = [F.col(index) == F.col("_i"), *[F.col(c) == F.col(f"_c{k}") for k, c in enumerate(content)]]
    only = build.groupBy(*content).agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias("_tc")).where("_n = 1").drop("_n")
    found = probe.join(at, same, "left").join(only, content, "left")
    way = F.when(F.col("_ti").isNotNull(), "index").when(F.col("_tc").isNotNull(), "content")
    return found.select(*probe.columns, F.coalesce("_ti", "_tc").alias(target), way.alias("way"))


def content_then_index(probe: DataFrame, build: DataFrame, index: str, content: list[str], target: str, order: str) -> DataFrame:
    """The same with content first, of whose repeats the last row counts, then the index, taken without a look at the content."""
    last = build.groupBy(*content).agg(F.max_by(target, order).alias("_tc"))
    at = build.select(F.col(index).alias("_i"), F.col(target).alias("_ti"))
    found = probe.join(last, content, "left").join(at, F.col(index) == F.col("_i"), "left")
    way = F.when(F.col("_tc").isNotNull(), "content").when(F.col("_ti").isNotNull(), "index")
    return found.select(*probe.columns, F.coalesce("_tc", "_ti").alias(target), way.alias("way"))


def identity_key(id_: Column, content: list[Column], place: list[Column]) -> Column:
    """``struct<way, key>``: a row's id if it has one, else its content if that is whole, else its place."""
    by_content = F.concat_ws("\u0001", *content)
    whole = content[0].isNotNull()
    for c in content[1:]:
        whole = whole & c.isNotNull()
    has_id = id_.isNotNull() & (F.trim(id_) != "")
    return F.when(has_id, F.struct(F.lit("id").alias("way"), id_.alias("key"))).when(whole, F.struct(F.lit("content").alias("way"), F.sha2(by_content, 256).alias("key"))).otherwise(
        F.struct(F.lit("place").alias("way"), F.concat_ws(":", *place).alias("key"))
    )


def without_bad_elements(rows: DataFrame, key: str, array: str, bad: DataFrame, element: str, reason: str) -> DataFrame:
    """``key, reason`` of every row: null if no element of its array is listed in ``bad(element, reason)``, else the least of the reasons."""
    listed = bad.groupBy(F.col(element).alias("_e")).agg(F.min(reason).alias("_r"))
    hit = rows.select(key, F.explode(array).alias("_e")).join(listed, "_e").groupBy(key).agg(F.min("_r").alias("reason"))
    return rows.select(key).join(hit, key, "left")


def merged_rows(rows: DataFrame, keys: list[str], columns: list[str], strict: bool = False) -> DataFrame:
    """One row per key: each column's only value, nulls aside, and ``conflicts``, the names of columns with several; ``strict`` raises on any."""
    sides = [F.min(c).alias(c) for c in columns] + [F.when(F.min(c) < F.max(c), F.lit(c)).alias(f"_x_{c}") for c in columns]
    out = rows.groupBy(*keys).agg(*sides)
    conflicts = F.concat_ws(",", *[f"_x_{c}" for c in columns])
    out = out.select(*keys, *columns, conflicts.alias("conflicts"))
    if strict:
        out = out.where(F.when(F.col("conflicts") != "", F.raise_error(F.concat(F.lit("conflicting values: "), F.col("conflicts"))).cast("boolean")).otherwise(F.lit(True)))
    return out


def values_at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame, cells: int = 1024) -> DataFrame:
    """``keys, rank, value``: the values at the 0-based places ``ranks(keys, rank)`` of each group in order of ``value``.

    A group is cut into ``cells`` of equal width between its least and largest value; cells are counted, and
    only those that hold a wanted rank are sorted. Nulls and NaN are left out.
    """
    sound = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    same = lambda more: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, *more]]
    span = sound.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(cells))).otherwise(F.lit(0)).cast("long")
    placed = sound.alias("a").join(span.alias("b"), same([])).select("a.*", place.alias("_cell"))
    below = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    wanted = ranks.alias("a").join(counts.alias("b"), same([])).where("a.rank >= b._before and a.rank < b._before + b._n").select("a.*", "b._cell", "b._before")
    inside = placed.alias("a").join(wanted.select(*keys, "_cell", "_before").distinct().alias("b"), same(["_cell"])).select("a.*", "b._before")
    numbered = inside.withColumn("rank", F.col("_before") + F.row_number().over(W.partitionBy(*keys, "_cell").orderBy("_v")) - 1)
    return wanted.select(*keys, "rank").alias("a").join(numbered.alias("b"), same(["rank"])).select("a.*", F.col("b._v").alias("value"))


def interpolated(rows: DataFrame, keys: list[str], value: str, shares: list[float], cells: int = 1024) -> DataFrame:
    """``keys, share, value``: exact percentiles of each group, with linear interpolation between neighbours."""
    sizes = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spots = sizes.select(*keys, "_n", F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share")).withColumn("_at", F.col("share") * (F.col("_n") - 1))
    spots = spots.withColumn("_lo", F.floor("_at")).withColumn("_hi", F.ceil("_at"))
    ranks = spots.select(*keys, F.explode(F.array("_lo", "_hi")).alias("rank")).distinct()
    found = values_at_ranks(rows, keys, value, ranks, cells)
    same = lambda side: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"a.{side}") == F.col("b.rank")]
    low = spots.alias("a").join(found.alias("b"), same("_lo")).select("a.*", F.col("b.value").alias("_x"))
    both = low.alias("a").join(found.alias("b"), same("_hi")).select("a.*", F.col("b.value").alias("_y"))
    return both.select(*keys, "share", (F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_at") - F.col("_lo"))).alias("value"))
