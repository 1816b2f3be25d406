"""Streams with state of their own: moving moments per task, and rows taken once however often they arrive.

State lies in the shared folder under the number of its micro-batch, so a batch that runs again starts
from the state before it and replaces its own result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.session import ensure_checkpoint_dir

_STATE = "task string, m1 double, m2 double"


def _source(spark: SparkSession, path: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A stream reads a folder; a single file is named through its parent by a glob.
    return reader.parquet(path if not path.endswith(".parquet") else path.replace(".parquet", ".parquet*"))


def moving_moments(spark: SparkSession, path: str, task: Column, decay: float, least: float, where: str, files_per_batch: int | None = None) -> DataFrame:
    """``task, step, std`` of a stream of rollout files: each micro-batch's steps, in order, move the task's first and second moments on.

    A step that arrives in two batches moves them twice. The state is one row per task.
    """
    base = f"{ensure_checkpoint_dir(spark)}/moments-{uuid.uuid4().hex}"
    spark.createDataFrame([], _STATE).write.parquet(f"{base}/state/-1")
    rows = _source(spark, path, files_per_batch).where(where).select(task.alias("task"), "step", "reward").where("task is not null")
    item = "array<struct<step:int,m1:double,m2:double>>"

    def add(batch: DataFrame, number: int) -> None:
        per = batch.groupBy("task", "step").agg(F.avg("reward").alias("m1"), F.avg(F.col("reward") * F.col("reward")).alias("m2"))
        series = per.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("step", "m1", "m2"))).alias("l"))
        old = spark.read.schema(_STATE).parquet(f"{base}/state/{number - 1}").select("task", F.struct(F.lit(None).cast("int").alias("step"), "m1", "m2").alias("old"))

        def move(acc: Column, x: Column) -> Column:
            last = F.coalesce(F.get(acc, F.size(acc) - 1), F.col("old"))
            new = lambda c: F.when(last.isNull(), x[c]).otherwise(F.lit(decay) * last[c] + F.lit(1 - decay) * x[c])
            return F.concat(acc, F.array(F.struct(x["step"].alias("step"), new("m1").alias("m1"), new("m2").alias("m2"))))

        moved = series.join(old, "task", "full").select("task", "old", F.aggregate(F.coalesce("l", F.expr(f"cast(array() as {item})")), F.expr(f"cast(array() as {item})"), move).alias("f")).persist()
        moved.select("task", F.explode("f").alias("x")).select("task", "x.*").write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        last = F.coalesce(F.get("f", F.size("f") - 1), F.col("old"))
        moved.select("task", last.alias("x")).select("task", "x.m1", "x.m2").write.mode("overwrite").parquet(f"{base}/state/{number}")
        moved.unpersist()

    rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("task string, step int, m1 double, m2 double").parquet(f"{base}/out")
    spread = F.greatest(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0)), F.lit(least * least))
    return out.select("task", "step", F.sqrt(spread).alias("std"))


def taken_once(spark: SparkSession, path: str, key: list[str], order: str, runs: int = 1, files_per_batch: int | None = None) -> DataFrame:
    """The first row by ``order`` of every key of a stream, however often files bring it: each micro-batch leaves out keys that the sink
    holds from earlier ones. ``runs`` starts the stream anew that many times over the same sink, as after a lost checkpoint."""
    base = f"{ensure_checkpoint_dir(spark)}/once-{uuid.uuid4().hex}"
    rows = _source(spark, path, files_per_batch)
    kept = [*key, order]
    spark.createDataFrame([], rows.select(*kept).schema).write.parquet(f"{base}/sink/run=0/batch=-1")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    for run in range(1, runs + 1):

        def add(batch: DataFrame, number: int, run: int = run) -> None:
            sink = spark.read.schema(f"{kinds}, run int, batch long").parquet(f"{base}/sink").where(f"run < {run} or (run = {run} and batch < {number})")
            same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
            firsts = batch.groupBy(*key).agg(F.min(order).alias(order)).alias("a").join(sink.select(*key).alias("b"), same, "left_anti")
            firsts.select(*kept).write.mode("overwrite").parquet(f"{base}/sink/run={run}/batch={number}")

        rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/progress-{run}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{kinds}, run int, batch long").parquet(f"{base}/sink").select(*kept)
