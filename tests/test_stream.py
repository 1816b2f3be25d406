"""Windowed counts of a stream against those of the whole table."""

import os

from pyspark.sql import functions as F

from cinderloom.streaming.windows import windowed_counts


def test_every_row_counts(spark, tmp_path):
    days = [[1, 1, 2, 20, 21], [3, 22, 1, None], [22, 2, 30]]  # open windows at the end, and rows far behind the newest
    for k, batch in enumerate(days):
        rows = [(f"2025-03-{d:02d} 05:00:00" if d else None, "a" if d != 22 else None, [1.0, None, float("nan"), 0.5][i % 4]) for i, d in enumerate(batch)]
        df = spark.createDataFrame(rows, "t string, problem_type string, reward double").selectExpr("cast(t as timestamp_ntz) as logged_at", "problem_type", "reward")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/rollouts.parquet")
        for name in os.listdir(f"{tmp_path}/rollouts.parquet"):
            if name.endswith(".parquet") and os.path.getmtime(p := f"{tmp_path}/rollouts.parquet/{name}") > 10**9 + 10:
                os.utime(p, (10**9 + k, 10**9 + k))
    whole = spark.read.parquet(f"{tmp_path}/rollouts.parquet").where("logged_at is not null")
    want = whole.groupBy(F.date_trunc("day", F.col("logged_at").cast("timestamp")).alias("w"), "problem_type").agg(F.count(F.lit(1)), F.avg(F.nanvl("reward", F.lit(None).cast("double"))))
    for size in (None, 1):
        got = windowed_counts(spark, f"{tmp_path}/rollouts.parquet", files_per_batch=size)
        assert got.columns == ["window_start", "problem_type", "n", "mean_reward"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
