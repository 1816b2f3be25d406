"""Windowed counts over a stream of rollout files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.session import ensure_checkpoint_dir


def windowed_counts(spark: SparkSession, path: str, width: str = "1 day", late: str = "2 days", files_per_batch: int | None = None) -> DataFrame:
    """Rows and mean reward per window of ``logged_at`` and problem type, from one availableNow run.

    Each micro-batch is summed up by window, and its sums are written under its batch number, so a
    batch that runs again replaces its own. Sums of windows that lay ``late`` behind the
    newest time of earlier batches go to a late table; the closing aggregate adds both up, so every
    row with a time counts, in open windows too. The tables and the checkpoint lie in the shared folder.
    """
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # A stream reads a folder; a single file is named through its parent by a glob.
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    rows = source.parquet(path if not path.endswith(".parquet") else path.replace(".parquet", ".parquet*"))
    rows = rows.select(F.col("logged_at").cast("timestamp").alias("at"), "problem_type", F.nanvl("reward", F.lit(None).cast("double")).alias("reward"))
    sums = "window_start timestamp, window_end timestamp, problem_type string, newest timestamp, n long, n_rewards long, reward double"
    tables = {"on_time": f"{base}/on_time", "late": f"{base}/late"}
    for folder in tables.values():
        spark.createDataFrame([], sums).write.parquet(f"{folder}/batch=-1")
    newest = None

    def add(batch: DataFrame, number: int) -> None:
        nonlocal newest
        found = (
            batch.groupBy(F.window("at", width).alias("w"), "problem_type")
            .agg(F.max("at").alias("newest"), F.count(F.lit(1)).alias("n"), F.count("reward").alias("n_rewards"), F.sum("reward").alias("reward"))
            .select("w.start", "w.end", "problem_type", "newest", "n", "n_rewards", "reward")
            .toDF("window_start", "window_end", "problem_type", "newest", "n", "n_rewards", "reward")
            .persist()
        )
        closed = F.lit(False) if newest is None else F.col("window_end") <= F.lit(newest) - F.expr(f"interval {late}")
        for name, part in (("on_time", ~closed), ("late", closed)):
            found.where(part).write.mode("overwrite").parquet(f"{tables[name]}/batch={number}")
        latest = found.agg(F.max("newest")).first()[0]
        newest = max((t for t in (newest, latest) if t is not None), default=None)
        found.unpersist()

    query = rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.schema(sums).parquet(tables["on_time"]).unionByName(spark.read.schema(sums).parquet(tables["late"]))
    return every.groupBy("window_start", "problem_type").agg(F.sum("n").alias("n"), (F.sum("reward") / F.sum("n_rewards")).alias("mean_reward"))
