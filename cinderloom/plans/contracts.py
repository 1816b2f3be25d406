"""Queries of user functions by contract, estimators by name, stateful streams and refilling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.functions import registry as R
from cinderloom.operators import batches as N
from cinderloom.plans.catalog import r9
from cinderloom.plans.intervals import _TASK, task_family
from cinderloom.sources.tables import table
from cinderloom.streaming.stateful import moving_moments, taken_once

_OK = "reward is not null and not isnan(reward) and uid is not null"


def _nine(x):
    return F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def _by_length(inputs: list[dict]) -> list[dict]:
    out = []
    for x in inputs:
        n = len(x["response"])  # a null reply fails the batch, and then itself alone
        out.append({"overall": min(1.0, n / 200), "accuracy": 1.0 if n else 0.0, "n_chars": n})
    return out


def custom_scores(spark: SparkSession, sf_dir: str):
    """A user's scorer under both contracts."""
    rows = table(spark, sf_dir, "rollouts").select("row_id", "response")
    both = R.scored(R.scored(rows, _by_length).withColumnRenamed("score", "a"), lambda x: _by_length([x])[0], batch=False)
    return both.select("row_id", _nine(F.col("a.overall")).alias("overall"), F.col("a.extra")["n_chars"].alias("n_chars"), (F.to_json("a") == F.to_json("score")).alias("same"))


def estimators(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "rollouts").where(_OK).select("row_id", "uid", "reward")
    each = [R.advantages(n, rows).select(F.lit(n).alias("name"), "row_id", _nine(F.col("advantage")).alias("advantage")) for n in ("grpo", "rloo", "centred")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def refilled_groups(spark: SparkSession, sf_dir: str):
    """Groups of medium mean taken step by step until there are 64."""
    g = table(spark, sf_dir, "rollouts").where(_OK).groupBy("uid").agg(F.min("step").alias("step"), F.avg("reward").alias("m")).where("m > 0.1 and m < 0.9")
    return N.positions(g.select("uid", "step"), [F.col("step"), F.col("uid")]).where("position < 64").select("uid", "step", "position")


def stream_ema(spark: SparkSession, sf_dir: str):
    std = moving_moments(spark, f"{sf_dir}/rollouts.parquet", task_family(F.col("problem_type")), 0.9, 1e-3, _OK + " and step is not null")
    return std.select("task", "step", _nine(F.col("std")).alias("std"))


def stream_once(spark: SparkSession, sf_dir: str):
    """Log lines that were appended again count once, also when the stream starts anew over the same sink."""
    return taken_once(spark, f"{sf_dir}/rollouts.parquet", ["uid", "prompt", "response"], "row_id", runs=2).select("row_id")


QUERIES = {f.__name__: f for f in (custom_scores, estimators, refilled_groups, stream_ema, stream_once)}
_G = f"ok as (select row_id, uid, step, reward, problem_type from rollouts where {_OK})"
SQL = {
    "custom_scores": f"select row_id, {r9('least(1e0, coalesce(length(response), 0) / 200e0)')} as overall, cast(length(response) as double) as n_chars, true as same from rollouts",
    "estimators": f"""with {_G}, g as (select *, count(*) over w as n, avg(reward) over w as m, sum(reward) over w as t, stddev_samp(reward) over w as sd from ok window w as (partition by uid))
select 'grpo' as name, row_id, {r9('(reward - m) / (sd + 1e-6)')} as advantage from g where n > 1 union all select 'rloo', row_id, {r9('reward - (t - reward) / (n - 1)')} from g where n > 1 union all select 'centred', row_id, {r9('reward - m')} from g where n > 1""",
    "refilled_groups": f"with {_G} select uid, step, p as position from (select uid, step, row_number() over (order by step nulls first, uid) - 1 as p from (select uid, min(step) as step from ok group by uid having avg(reward) > 0.1 and avg(reward) < 0.9) a) b where p < 64",
    "stream_ema": f"""with {_G}, t as (select {_TASK} as task, step, reward from ok where step is not null and problem_type is not null), s as (select task, step, avg(reward) as m1, avg(reward * reward) as m2, row_number() over (partition by task order by step) as k from t group by task, step),
m as (select a.task, a.step, sum(b.m1 * pow(0.9e0, a.k - b.k) * case when b.k = 1 then 1e0 else 0.1e0 end) as m1, sum(b.m2 * pow(0.9e0, a.k - b.k) * case when b.k = 1 then 1e0 else 0.1e0 end) as m2 from s a join s b on a.task = b.task and b.k <= a.k group by all) select task, step, {r9('sqrt(greatest(greatest(m2 - m1 * m1, 0), 1e-6))')} as std from m""",
    "stream_once": "select min(row_id) as row_id from rollouts group by uid, prompt, response",
}
