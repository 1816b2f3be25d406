"""References to records that are missing, deleted or loaded later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["video_id", "kind", "id"]


def target_states(targets: DataFrame) -> DataFrame:
    """One row per key of ``targets(video_id, kind, id, is_deleted, loaded_at)``: ``live`` and ``first_live``."""
    gone = F.coalesce(F.col("is_deleted"), F.lit(False))
    return targets.groupBy(*KEY).agg(
        F.max(~gone).alias("live"),
        F.min(F.when(~gone, F.col("loaded_at"))).alias("first_live"),
    )


def reference_periods(refs: DataFrame) -> DataFrame:
    """References per key, table, column and day of loading: ``n`` and the latest and earliest ``loaded_at``.

    Rows with a null in the key are left out.
    """
    whole = refs.where(" and ".join(f"{k} is not null" for k in KEY))
    return whole.groupBy(*KEY, "ref_table", "ref_column", F.to_date("loaded_at").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("first_ref"), F.max("loaded_at").alias("last_ref")
    )


def suspect_periods(periods: DataFrame, targets: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """The rows of ``periods`` that hold orphans, with ``live`` and ``first_live`` of their key.

    Keys that hold more than ``heavy_share`` of all references, of which there can be at most
    ``1 / heavy_share``, are checked against a broadcast of their states; the rest, where no key is
    large, against a shuffled join; then both are united.
    """
    if not 0 < heavy_share <= 1:
        raise ValueError("heavy_share must lie in (0, 1]")
    total = periods.agg(F.sum("n").alias("total"))
    heavy = (
        periods.groupBy(*KEY).agg(F.sum("n").alias("n"))
        .join(F.broadcast(total), F.col("n") > F.lit(heavy_share) * F.col("total"))
        .select(*KEY, F.lit(True).alias("is_heavy"))
    )
    states = target_states(targets)
    heavy_states = F.broadcast(heavy.join(states, KEY, "left"))
    split = periods.join(heavy_states, KEY, "left")
    checked_heavy = split.where("is_heavy").drop("is_heavy")
    checked_rest = split.where("is_heavy is null").drop("is_heavy", "live", "first_live").join(states, KEY, "left")
    return checked_heavy.unionByName(checked_rest).where("live is null or not live or first_live > first_ref")


def orphan_references(refs: DataFrame, targets: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """Orphans among ``refs(ref_table, ref_column, row_id, video_id, kind, id, loaded_at)`` with their ``reason``.

    ``missing``: no target row has the key; ``deleted``: only deleted ones; ``late``: the earliest
    live target was loaded after the referring row. Null load times are never late; a null video, id or
    kind matches nothing, so it is missing without a look. Callers normalise ids and leave out rows that make no reference.

    References are pre-aggregated per key and day, the aggregates checked, and only rows of the keys
    and days that came out are looked at one by one.
    """
    suspects = suspect_periods(reference_periods(refs), targets, heavy_share)
    found = suspects.select(*KEY, "ref_table", "ref_column", "period", "live", "first_live")
    # Periods of null load times meet as well.
    keys = [*KEY, "ref_table", "ref_column"]
    same = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in keys] + [F.to_date("r.loaded_at").eqNullSafe(F.col("s.period"))]
    checked = refs.alias("r").join(found.alias("s"), same).select("r.*", "s.live", "s.first_live")
    reason = (
        F.when(F.col("live").isNull(), "missing")
        .when(~F.col("live"), "deleted")
        .when(F.col("first_live") > F.col("loaded_at"), "late")
    )
    unkeyed = refs.where(" or ".join(f"{k} is null" for k in KEY)).withColumn("reason", F.lit("missing"))
    columns = ["ref_table", "ref_column", "row_id", "loaded_at", "reason"]
    return checked.withColumn("reason", reason).where("reason is not null").select(columns).unionByName(unkeyed.select(columns))


def orphan_counts(refs: DataFrame, targets: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """``ref_table, ref_column, reason, period, n_orphans``, counted from the aggregates.

    Only days on which some references to a key were late and others weren't are counted row by row.
    """
    suspects = suspect_periods(reference_periods(refs), targets, heavy_share)
    whole = F.when(F.col("live").isNull(), "missing").when(~F.col("live"), "deleted").when(F.col("first_live") > F.col("last_ref"), "late")
    # A null load time is never late, so a day-less aggregate holds no late row.
    counted = suspects.withColumn("reason", whole)
    split = counted.where("reason is null").select(*KEY, "ref_table", "ref_column", "period", "first_live")
    rows = refs.alias("r").join(
        split.alias("s"), [F.col(f"r.{k}") == F.col(f"s.{k}") for k in [*KEY, "ref_table", "ref_column"]] + [F.to_date("r.loaded_at") == F.col("s.period"), F.col("s.first_live") > F.col("r.loaded_at")]
    ).select("r.ref_table", "r.ref_column", F.lit("late").alias("reason"), F.col("s.period").alias("period"), F.lit(1).cast("long").alias("n"))
    unkeyed = refs.where(" or ".join(f"{k} is null" for k in KEY)).select("ref_table", "ref_column", F.lit("missing").alias("reason"), F.to_date("loaded_at").alias("period"), F.lit(1).cast("long").alias("n"))
    every = counted.where("reason is not null").select("ref_table", "ref_column", "reason", "period", "n").unionByName(rows).unionByName(unkeyed)
    return every.groupBy("ref_table", "ref_column", "reason", "period").agg(F.sum("n").alias("n_orphans"))
