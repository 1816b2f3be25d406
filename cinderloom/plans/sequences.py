"""Queries of recurrences, matchings, batching and streaming over rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.operators import sequences as S
from cinderloom.plans.catalog import r9
from cinderloom.sources.tables import table
from cinderloom.streaming.windows import windowed_counts

_OK = "reward is not null and not isnan(reward) and uid is not null"


def _round(x):
    return F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def _unfolded(df: DataFrame, key: str, value: str) -> DataFrame:
    zipped = F.arrays_zip(F.col("ids").alias("i"), F.col("ys").alias("y"))
    return df.select(*[c for c in df.columns if c not in ("ids", "xs", "ys")], F.explode(zipped).alias("z")).select(
        *[c for c in df.columns if c not in ("ids", "xs", "ys")], F.col("z.i").alias(key), _round(F.col("z.y")).alias(value)
    )


def discounted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.ordered_values(table(spark, sf_dir, "rollouts").where(_OK), ["uid"], "row_id", "reward")
    return _unfolded(rows.withColumn("ys", S.discounted(F.col("xs"), 0.9)), "row_id", "ret").drop("uid")


def ema_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "rollouts").where(_OK).groupBy("problem_type", "step").agg(F.avg("reward").alias("m"))
    rows = S.ordered_values(means, ["problem_type"], "step", "m")
    return _unfolded(rows.withColumn("ys", S.smoothed(F.col("xs"), 0.9)), "step", "ema")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rollouts").where("temporal_segments is not null").select(
        "row_id", S.sound_segments(F.col("temporal_segments.predicted")).alias("p"), S.sound_segments(F.col("temporal_segments.ground_truth")).alias("g")
    )


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("row_id", F.size("p").cast("long").alias("n_before"), F.size(S.suppressed(F.col("p"))).cast("long").alias("n_after"))


def dp_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _segments(spark, sf_dir)
    return df.select("row_id", _round(S.f1_of(S.ordered_match(F.col("p"), F.col("g")), F.size("p"), F.size("g"))).alias("f1"))


def f1_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _segments(spark, sf_dir).withColumn("p", S.suppressed(F.col("p")))
    return df.select("row_id", _round(S.f1_of(S.best_assignment_sum(F.col("p"), F.col("g")), F.size("p"), F.size("g"))).alias("f1"))


def length_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training groups of one step split into four parts of near-equal response length."""
    return S.length_balanced(table(spark, sf_dir, "rollouts"), ["phase", "step"], "row_id", "response_length", 4)


def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and mean reward per day and task, late rows and open days included."""
    counts = windowed_counts(spark, f"{sf_dir}/rollouts.parquet")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "problem_type", "n", _round(F.col("mean_reward")).alias("mean_reward"))


_T = f"t as (select row_id, uid, reward, row_number() over (partition by uid order by row_id) as rn from rollouts where {_OK})"
_M = f"m as (select problem_type, step, avg(reward) as x, row_number() over (partition by problem_type order by step) - 1 as k from rollouts where {_OK} group by problem_type, step)"
QUERIES = {f.__name__: f for f in (discounted_return, ema_smooth, nms, dp_f1, f1_iou, length_balanced, stream_windowed_counts)}
SQL = {
    "stream_windowed_counts": f"select strftime(logged_at, '%Y-%m-%d') as day, problem_type, count(*) as n, {r9('avg(case when not isnan(reward) then reward end)')} as mean_reward from rollouts where logged_at is not null group by 1, 2",
    "discounted_return": f"with {_T} select a.row_id, {r9('sum(b.reward * pow(0.9e0, b.rn - a.rn))')} as ret from t a join t b on a.uid = b.uid and b.rn >= a.rn group by a.row_id",
    "ema_smooth": f"with {_M} select a.problem_type, a.step, {r9('sum(b.x * pow(0.9e0, a.k - b.k) * (case when b.k = 0 then 1e0 else 0.1e0 end))')} as ema from m a join m b on a.problem_type = b.problem_type and b.k <= a.k group by a.problem_type, a.step",
}
