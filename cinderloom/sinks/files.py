"""File sinks. Each write is one Spark job over the whole table; folders hold part files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def write_json_lines(df: DataFrame, path: str, append: bool = False, partition_by: Sequence[str] = ()) -> None:
    """One JSON object a line, nulls included; overwrites unless ``append``; a folder per value of ``partition_by``."""
    writer = df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str], digits: int = 4) -> None:
    """The named fields, a missing one empty: fractions with ``digits`` decimals, lists and structs as JSON."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str) -> Column:
        kind = kinds.get(name)
        if kind is None:
            return F.lit(None).cast("string").alias(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(name), "nan").otherwise(F.format_string(f"%.{digits}f", F.col(name).cast("double"))).alias(name)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(name).alias(name)
        return F.col(name).cast("string").alias(name)

    text = [F.when(F.col(n).isNotNull(), cell(n)).alias(n) if n in kinds else cell(n) for n in fields]
    df.select(*text).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_summary(one_row: DataFrame, path: str) -> None:
    """A summary of one row as one JSON document."""
    one_row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def tee(df: DataFrame, decision: Column, path: str) -> None:
    """One pass into a folder per decision, ``decision=keep`` and so on, each of which can be read alone."""
    df.withColumn("decision", decision).write.mode("overwrite").partitionBy("decision").parquet(path)


def retained(checkpoints: DataFrame, keep: int, score: str = "score") -> DataFrame:
    """``step`` rows of ``checkpoints(step, score)`` with ``tracker``: the last ``keep`` by step stay, and the best (``best``, latest on ties) always."""
    latest = F.row_number().over(W.orderBy(F.desc("step")))
    best = F.row_number().over(W.orderBy(F.desc_nulls_last(score), F.desc("step")))
    # As many rows as there are checkpoints.
    ranked = checkpoints.withColumns({"_l": latest, "_b": best})
    return ranked.where((F.col("_l") <= keep) | (F.col("_b") == 1)).select("step", score, F.when(F.col("_b") == 1, "best").when(F.col("_l") == 1, "last").otherwise("kept").alias("tracker"))
