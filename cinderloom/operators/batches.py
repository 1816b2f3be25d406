"""A batch protocol over DataFrames: projections by name, positions, chunks, repeats, reordering, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cinderloom.session import ensure_checkpoint_dir


def select(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that exist, in the order named; others are ignored."""
    return df.select(*[F.col(f"`{n}`") for n in names if n in df.columns])


def pop(df: DataFrame, names: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The named columns and the remaining ones, both with the row key."""
    return select(df, [key, *[n for n in names if n != key]]), df.drop(*[n for n in names if n != key])


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def without_internal(df: DataFrame) -> DataFrame:
    """Columns that begin with an underscore left out."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def flat(df: DataFrame, sep: str = "/") -> DataFrame:
    """Struct fields as columns of their own, named by their path; arrays and maps stay."""

    def walk(kind: T.StructType, col: Column | None, path: list[str]):
        for f in kind.fields:
            here = F.col(f"`{f.name}`") if col is None else col[f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, here, [*path, f.name])
            else:
                yield here.alias(sep.join([*path, f.name]))

    return df.select(*walk(df.schema, None, []))


def nested(df: DataFrame, sep: str = "/") -> DataFrame:
    """The reverse: columns whose names share a path become structs."""
    tree: dict = {}
    for c in df.columns:
        *path, last = c.split(sep)
        node = tree
        for p in path:
            node = node.setdefault(p, {})
        node[last] = F.col(f"`{c}`")

    def built(node) -> Column:
        return F.struct(*[(built(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return df.select(*[(built(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()])


def positions(df: DataFrame, order: Sequence[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with each row's 0-based place in a total order: ranges are sorted apart and moved by the counts of those before."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return ranked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_part", "_r", "_before")


def repeat(df: DataFrame, times: int, position: str, interleave: bool = True) -> DataFrame:
    """Every row ``times`` over, with its new ``position``: copies side by side, or the whole batch again and again."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    if interleave:
        return copies.withColumn(position, F.col(position) * times + F.col("copy"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return copies.join(F.broadcast(total)).withColumn(position, F.col(position) + F.col("copy") * F.col("_total")).drop("_total")


def chunk_of(position: Column, total: Column, chunks: int) -> Column:
    """The chunk of a position when a batch is cut into equal ones; the batch must divide."""
    whole = F.when(total % chunks == 0, position).otherwise(F.raise_error(F.concat(F.lit(f"not a multiple of {chunks}: "), total.cast("string"))).cast("long"))
    return F.floor(whole / (total / chunks)).cast("long")


def padded(df: DataFrame, divisor: int, position: str) -> DataFrame:
    """The batch with its first rows again at the end, round and round, until its size is a multiple of ``divisor``; ``is_pad`` marks them."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    rows = df.join(F.broadcast(total)).withColumn("_short", F.lit(divisor) - 1 - (F.col("_total") - 1) % divisor)
    copies = F.when(F.col(position) < F.col("_short"), F.floor((F.col("_short") - 1 - F.col(position)) / F.col("_total")) + 1).otherwise(0)
    again = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long"))))
    return again.withColumn("is_pad", F.col("_k") > 0).withColumn(position, F.when(F.col("_k") > 0, F.col("_k") * F.col("_total") + F.col(position)).otherwise(F.col(position))).drop("_total", "_short", "_k")


def reordered(df: DataFrame, permutation: DataFrame, position: str) -> DataFrame:
    """Rows at the places ``permutation(position, source)`` names; a source may come more than once."""
    return permutation.withColumnRenamed(position, "_to").join(df, F.col("source") == F.col(position)).drop(position, "source").withColumnRenamed("_to", position)


def inverse(permutation: DataFrame, position: str) -> DataFrame:
    return permutation.select(F.col("source").alias(position), F.col(position).alias("source"))
