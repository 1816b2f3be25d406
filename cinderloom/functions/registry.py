"""User functions by name: scorers of a batch or of one reply, and advantage estimators."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FIELDS = ["response", "response_length", "ground_truth", "data_type", "problem_type", "problem", "problem_id"]
SCORE = "struct<overall:double,format:double,accuracy:double,extra:map<string,double>>"
ESTIMATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def load(address: str) -> Callable:
    """The function of ``path.py:name``."""
    path, _, name = address.rpartition(":")
    spec = importlib.util.spec_from_file_location("user_scorer", path)
    if not path or spec is None or spec.loader is None:
        raise ValueError(f"not a path and a function: {address!r}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, name)


def scored(df: DataFrame, function: Callable, batch: bool = True) -> DataFrame:
    """``df`` with ``score``, a SCORE, by a user's function of dictionaries with the FIELDS that ``df`` has.

    In the batch contract it gets a list of them, an Arrow batch at a time, and gives as many; in the other, one
    at a time. ``overall`` is needed, ``format`` and ``accuracy`` are 0 if missing, other numbers go to ``extra``. A
    reply on which it fails scores 0; if a whole batch fails, its replies are tried one by one.
    """
    names = [f for f in FIELDS if f in df.columns]

    @F.pandas_udf(SCORE)
    def run(*columns: pd.Series) -> pd.DataFrame:
        rows = [dict(zip(names, r)) for r in zip(*columns)]

        def one(r):
            try:
                return function([r])[0] if batch else function(r)
            except Exception:  # noqa: BLE001
                return None

        def shaped(s):
            s = dict(s or {})
            known = [float(s.pop(k, 0.0) or 0.0) for k in ("overall", "format", "accuracy")]
            return (*known, {k: float(v) for k, v in s.items() if isinstance(v, (int, float))})

        try:
            found = function(rows) if batch else [one(r) for r in rows]
            if len(found) != len(rows):
                raise ValueError("as many scores as replies are needed")
        except Exception:  # noqa: BLE001
            found = [one(r) for r in rows]
        return pd.DataFrame([shaped(s) for s in found], columns=["overall", "format", "accuracy", "extra"])

    return df.withColumn("score", run(*[F.col(n) for n in names]))


def estimator(name: str):
    """Registers a function of ``rows(row_id, uid, reward, ...)`` that adds ``advantage``."""

    def register(function: Callable[[DataFrame], DataFrame]):
        if name in ESTIMATORS:
            raise ValueError(f"{name} is taken")
        ESTIMATORS[name] = function
        return function

    return register


def advantages(name: str, rows: DataFrame) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; there are {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name](rows)


def _groups(rows: DataFrame) -> tuple[DataFrame, Column, Column]:
    group = W.partitionBy("uid")
    return rows.withColumn("_n", F.count(F.lit(1)).over(group)).where("_n > 1"), F.avg("reward").over(group), F.sum("reward").over(group)


@estimator("grpo")
def _grpo(rows: DataFrame) -> DataFrame:
    kept, mean, _ = _groups(rows)
    return kept.withColumn("advantage", (F.col("reward") - mean) / (F.stddev_samp("reward").over(W.partitionBy("uid")) + F.lit(1e-6))).drop("_n")


@estimator("rloo")
def _rloo(rows: DataFrame) -> DataFrame:
    kept, _, total = _groups(rows)
    return kept.withColumn("advantage", F.col("reward") - (total - F.col("reward")) / (F.col("_n") - 1)).drop("_n")


@estimator("centred")
def _centred(rows: DataFrame) -> DataFrame:
    kept, mean, _ = _groups(rows)
    return kept.withColumn("advantage", F.col("reward") - mean).drop("_n")
