"""Text and file sources: JSON lines strict or permissive, JSON arrays and documents, folders, splits, names as columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad_line"


def _with_place(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"))


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str, strict: bool = True, place: bool = False) -> DataFrame:
    """Rows of JSON-line files, folders or globs; blank lines are skipped.

    ``strict``: a line that isn't a JSON object is an error that names its file. Otherwise such lines come as rows of
    nulls with the line in ``_bad_line``, for the caller to count or drop. ``place`` adds ``_file``.
    """
    lines = _with_place(spark.read.text(paths if isinstance(paths, str) else list(paths))).where(F.trim("value") != "")
    wide = f"{schema}, {BAD} string"
    parsed = lines.select("_file", "value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    bad = ~F.coalesce(F.trim("value").startswith("{"), F.lit(False)) | F.col(f"r.{BAD}").isNotNull()
    names = T.StructType.fromDDL(schema).names if hasattr(T.StructType, "fromDDL") else [f.split()[0] for f in schema.split(", ")]
    kept = [F.col(f"r.`{n}`").alias(n) for n in names] + ([F.col("_file")] if place else [])
    if strict:
        told = F.concat(F.lit("not a JSON object in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 80))
        return parsed.where(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).select(*kept)
    return parsed.select(*kept, F.when(bad, F.col("value")).alias(BAD))


def json_documents(spark: SparkSession, paths: str | Sequence[str], schema: str, keep: Column | None = None) -> DataFrame:
    """One JSON document, or an array of them, a file. Files that can't be read as such are left out; ``keep`` filters the rest."""
    wide = f"{schema}, {BAD} string"
    read = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(paths if isinstance(paths, str) else list(paths))
    names = [c for c in read.columns if c != BAD]
    sound = read.where(F.col(BAD).isNull()).select(*names)
    return sound if keep is None else sound.where(keep)


def split_address(address: str) -> tuple[str, str | None]:
    """``path@split`` as path and split; without a split the second is null. An ``@`` inside a folder's name stays."""
    path, at, split = address.rpartition("@")
    return (path, split) if at and path and "/" not in split and split else (address, None)


def addressed(spark: SparkSession, address: str) -> DataFrame:
    """The table at ``path@split`` by its extension: the split is a file ``split.*`` in the folder, or a value of a column ``split``."""
    path, split = split_address(address)
    kind = next((k for k in ("parquet", "csv", "jsonl", "json", "orc") if path.rstrip("/").endswith(f".{k}")), "parquet")
    reader = spark.read.option("header", True).option("inferSchema", True).option("escape", '"') if kind == "csv" else spark.read
    df = reader.format("json" if kind in ("json", "jsonl") else kind).load(path)
    return df if split is None else df.where(F.col("split") == split) if "split" in df.columns else reader.format(kind).load(f"{path}/{split}.{kind}")


def listed(*groups: Sequence[str]) -> list[str]:
    """Paths of several lists, each once, where it came first."""
    return list(dict.fromkeys(p for g in groups for p in g))


def name_columns(df: DataFrame, patterns: Mapping[str, str], file: str = "_file") -> DataFrame:
    """``df`` with columns drawn from its files' names: the first group of each pattern, null where it doesn't occur; numbers as such."""
    for name, pattern in patterns.items():
        found = F.nullif(F.regexp_extract(file, pattern, 1), F.lit(""))
        df = df.withColumn(name, found.try_cast("long") if r"(\d+)" in pattern else found)
    return df


def in_step_range(paths: Sequence[str], low: int, high: int, pattern: str = r"step_0*(\d+)") -> list[str]:
    """The paths whose step lies in the range, both bounds inclusive, so that no other file is opened."""
    return [p for p in paths if (m := re.search(pattern, p)) and low <= int(m[1]) <= high]


def preferring_frames(paths: Sequence[str], present: Sequence[str]) -> list[str]:
    """Each ``x.jsonl`` as its sibling ``x_frames.jsonl`` where that is present."""
    there = set(present)
    return [s if (s := re.sub(r"\.jsonl$", "_frames.jsonl", p)) in there else p for p in paths]


def frame_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """``frame_dir, n_frames, first_frame, last_frame`` of a listing of numbered frame files; other files don't count."""
    pattern = r"^(.*)/(\d+)\.(?:jpg|jpeg|png|webp)$"
    numbered = files.select(F.regexp_extract(path, pattern, 1).alias("frame_dir"), F.regexp_extract(path, pattern, 2).try_cast("long").alias("k")).where("k is not null")
    return numbered.groupBy("frame_dir").agg(F.countDistinct("k").alias("n_frames"), F.min("k").alias("first_frame"), F.max("k").alias("last_frame"))


def merged_config(defaults: Mapping, given: Mapping, overrides: Mapping) -> dict:
    """Settings of two levels: the file's over the defaults', an override over both only where it isn't the default itself."""
    out = {k: dict(v) if isinstance(v, Mapping) else v for k, v in defaults.items()}
    for k, v in given.items():
        out[k] = {**out[k], **v} if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    for path, v in overrides.items():
        node, base, (*above, last) = out, defaults, path.split(".")
        for a in above:
            node, base = node.setdefault(a, {}), base.get(a, {})
        if last not in base or base[last] != v:
            node[last] = v
    return out
