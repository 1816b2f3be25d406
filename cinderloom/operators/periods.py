"""Merging overlapping intervals into continuous periods, and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def seconds_to_ms(seconds: Column) -> Column:
    """Whole milliseconds of a DOUBLE of seconds; null for null, NaN and infinite values."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9.0e14))
    return F.when(finite, F.round(seconds * F.lit(1000.0)).cast("long"))


def continuous_periods(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    tolerance: int = 0,
    slice_width: int = 60_000,
) -> DataFrame:
    """Periods and gaps of each entity: ``keys..., piece, start, end`` (piece ``period`` or ``gap``).

    ``start`` and ``end`` are whole numbers (say milliseconds). A next start at most ``tolerance``
    after the running maximum end continues the period. Rows with a null bound or ``end < start``
    are ignored; a null key is an entity of its own; repeated and nested intervals fold into one;
    an empty input gives an empty result. Only the named columns are read, so other columns may
    have any name.

    An entity that holds most rows isn't sorted in one task: rows are first reduced to one per
    (entity, start), then the running maximum is taken within slices of ``slice_width`` of the start
    and carried over from slice to slice, so a window sees at most ``slice_width`` rows, or one
    row per slice. The last window runs over period heads; those of one entity lie more than
    ``tolerance`` apart, so the length of the time line bounds them, not the number of rows.
    """
    rows = df.select(
        F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_g"),
        F.col(start).cast("long").alias("_s"),
        F.col(end).cast("long").alias("_e"),
    ).where("_s is not null and _e is not null and _e >= _s")
    points = (
        rows.withColumn("_c", F.floor(F.col("_s") / F.lit(float(slice_width))).cast("long"))
        .groupBy("_g", "_c", "_s")
        .agg(F.max("_e").alias("_e"))
    )
    by_slice = W.partitionBy("_g").orderBy("_c")
    carried = (
        points.groupBy("_g", "_c")
        .agg(F.max("_e").alias("_m"))
        .select(
            "_g",
            "_c",
            F.max("_m").over(by_slice.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"),
            F.max("_m").over(W.partitionBy("_g")).alias("_last"),
        )
    )
    inside = W.partitionBy("_g", "_c").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    heads = (
        points.join(carried, ["_g", "_c"])
        .withColumn("_prev", F.greatest("_carry", F.max("_e").over(inside)))
        .where(F.col("_prev").isNull() | (F.col("_s") > F.col("_prev") + F.lit(tolerance)))
        .select("_g", "_s", "_prev", "_last")
    )
    closed = heads.withColumn(
        "_end", F.coalesce(F.lead("_prev").over(W.partitionBy("_g").orderBy("_s")), F.col("_last"))
    )
    pieces = F.filter(
        F.array(
            F.struct(F.lit("period").alias("piece"), F.col("_s").alias("s"), F.col("_end").alias("e")),
            F.struct(F.lit("gap").alias("piece"), F.col("_prev").alias("s"), F.col("_s").alias("e")),
        ),
        lambda p: p["s"].isNotNull(),
    )
    return closed.select("_g", F.explode(pieces).alias("_p")).select(
        *[F.col(f"_g.k{i}").alias(k) for i, k in enumerate(keys)],
        F.col("_p.piece").alias("piece"),
        F.col("_p.s").alias("start"),
        F.col("_p.e").alias("end"),
    )
