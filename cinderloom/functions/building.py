"""Tasks built from ordered children, as native columns over arrays. Orders are drawn by hashes, so they hold under any input order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_free(spans: Column) -> Column:
    """``array<struct<s, e, ...>>`` in order of start; null if two overlap or one is empty."""
    ordered = F.array_sort(spans)
    clash = F.exists(F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda a, b: F.coalesce(b["s"] < a["e"], F.lit(False))), lambda x: x)
    empty = F.exists(ordered, lambda a: ~F.coalesce(a["s"] < a["e"], F.lit(False)))
    return F.when(~clash & ~empty, ordered)


def hash_permutation(n: Column, seed: Column) -> Column:
    """``1..n`` in the order of their seeded MD5; turned by one place where that is the identity; null below 2."""
    drawn = F.transform(F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.md5(F.concat_ws(":", seed, i.cast("string"))).alias("h"), i.alias("i")))), lambda x: x["i"])
    same = F.to_json(drawn) == F.to_json(F.array_sort(drawn))
    turned = F.concat(F.slice(drawn, 2, F.greatest(n - 1, F.lit(0))), F.slice(drawn, 1, 1))
    return F.when(n >= 2, F.when(same, turned).otherwise(drawn))


def permuted(items: Column, permutation: Column) -> Column:
    return F.transform(permutation, lambda i: F.element_at(items, i))


def inverse_permutation(permutation: Column) -> Column:
    """Where each of ``1..n`` went, from 1."""
    return F.transform(F.sequence(F.lit(1), F.size(permutation)), lambda i: F.array_position(permutation, i).cast("int"))


def events_text(spans: Column) -> Column:
    """``<events>[[s, e], ...]</events>`` with one decimal."""
    pair = F.transform(spans, lambda x: F.format_string("[%.1f, %.1f]", x["s"], x["e"]))
    return F.concat(F.lit("<events>["), F.array_join(pair, ", "), F.lit("]</events>"))


def lettered(options: Column) -> Column:
    """``A. x`` lines."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(". "), x)), "\n")
