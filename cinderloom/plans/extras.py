"""Queries of interval joins, schema unification, text patches, control series and lookups of single groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cinderloom.functions import building as B
from cinderloom.functions import parsing as P
from cinderloom.operators import batches as N
from cinderloom.operators import sequences as S
from cinderloom.operators import spans as X
from cinderloom.plans.building import _children
from cinderloom.plans.catalog import r9
from cinderloom.sinks import files as K
from cinderloom.plans.files import _folder
from cinderloom.sources.tables import table

_SOUND = "not coalesce(is_deleted, false) and not isnan(start_time) and not isnan(end_time) and start_time >= 0 and start_time < end_time and end_time < 1e6"
_OK = "reward is not null and not isnan(reward) and uid is not null"


def _nine(x):
    return F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def _spans(spark: SparkSession, sf_dir: str, name: str, alias: str) -> DataFrame:
    """The latest sound row of each node."""
    rows = table(spark, sf_dir, name).where(_SOUND)
    kept = ["start_time", "end_time", "row_id"] + (["parent_phase_id"] if name == "hier_events" else [])
    last = rows.groupBy("video_id", F.lower(F.trim("id")).alias("id")).agg(F.max_by(F.struct(*kept), F.struct("loaded_at", "row_id")).alias("r"))
    return last.select("video_id", "id", F.col("r.row_id").alias(alias), F.col("r.start_time").alias("s"), F.col("r.end_time").alias("e"), *[F.lower(F.trim("r.parent_phase_id")).alias("pid") for _ in kept[3:]])


def overlap_best(spark: SparkSession, sf_dir: str):
    """Each event's phase of largest overlap, the nearer midpoint on ties."""
    pairs = X.overlapping(_spans(spark, sf_dir, "hier_events", "a"), _spans(spark, sf_dir, "phases", "b"), "video_id")
    best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "apart", "b")).alias("m"))
    return best.select(F.col("a").alias("row_id"), F.col("m.b").alias("phase_row"), _nine(-F.col("m.o")).alias("overlap"))


def nearest(spark: SparkSession, sf_dir: str):
    """For events whose phase isn't there, the phase with the nearest start or end."""
    e, p = _spans(spark, sf_dir, "hier_events", "a"), _spans(spark, sf_dir, "phases", "b")
    orphans = e.join(p.select("video_id", F.col("id").alias("pid")), ["video_id", "pid"], "left_anti")
    return X.nearest(orphans, p, "video_id").select(F.col("a").alias("row_id"), F.col("b").alias("phase_row"), _nine(F.col("dist")).alias("dist"))


def unified_records(spark: SparkSession, sf_dir: str):
    """Documents and records in one shape, tagged by where they come from, missing types filled."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("prompt"), "domain_l1")
    m = F.try_parse_json("metadata")
    r = table(spark, sf_dir, "records").select(F.concat(F.lit("r"), F.col("pos").cast("string")).alias("id"), "prompt", F.try_variant_get(m, "$.domain_l1", "string").alias("domain_l1"), "problem_type")
    both = d.withColumn("mix_source", F.lit("documents")).unionByName(r.withColumn("mix_source", F.lit("records")), allowMissingColumns=True)
    kind = F.coalesce(F.nullif(F.trim("problem_type"), F.lit("")), F.lit("text"))
    return both.groupBy("mix_source", kind.alias("problem_type"), F.coalesce("domain_l1", F.lit("unknown")).alias("domain_l1")).agg(F.count(F.lit(1)).alias("n"), F.count("prompt").alias("n_prompts"))


def patched_texts(spark: SparkSession, sf_dir: str):
    """Ordered replacements in prompts, cut for a preview."""
    text = P.given(F.col("prompt"))
    for old, new in (("<video>", "[clip] "), ("Options:", "Choices:"), ("[clip] \n", "[clip]\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "records").select("pos", F.md5(text).alias("h"), F.substring(text, 1, 180).alias("preview"))


def kl_coefficients(spark: SparkSession, sf_dir: str):
    """An adaptive coefficient over the steps: moved by how far a step's divergence is off its target, within a fifth."""
    per = table(spark, sf_dir, "rollouts").where(_OK).groupBy("step").agg(F.stddev_pop("reward").alias("kl"), F.count(F.lit(1)).alias("n"))
    # One row per step.
    series = per.where("step is not null").agg(F.array_sort(F.collect_list(F.struct("step", "kl", "n"))).alias("l"))

    def move(acc, x):
        error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), x["kl"] / F.lit(0.3) - 1))
        last = F.coalesce(F.get(acc, F.size(acc) - 1)["c"], F.lit(0.01))
        return F.concat(acc, F.array(F.struct(x["step"].alias("step"), (last * (1 + error * x["n"] / F.lit(10000.0))).alias("c"))))

    folded = series.select(F.explode(F.aggregate("l", F.expr("cast(array() as array<struct<step:int,c:double>>)"), move)).alias("x"))
    return folded.select("x.step", (F.floor(F.col("x.c") * F.lit(1e12) + F.lit(0.5)) / F.lit(1e12)).alias("coefficient"))


def whitened_rewards(spark: SparkSession, sf_dir: str):
    ok = table(spark, sf_dir, "rollouts").where(_OK).select("row_id", "reward")
    stats = ok.agg(F.avg("reward").alias("m"), F.var_samp("reward").alias("v"))
    return ok.join(F.broadcast(stats)).select("row_id", _nine((F.col("reward") - F.col("m")) / F.sqrt(F.col("v") + F.lit(1e-8))).alias("white"))


def throughput(spark: SparkSession, sf_dir: str):
    """Characters per second of each day's log, from its first to its last line."""
    r = table(spark, sf_dir, "rollouts").where("logged_at is not null").select(F.to_date("logged_at").cast("string").alias("day"), F.unix_seconds(F.col("logged_at").cast("timestamp")).alias("t"), F.coalesce("response_length", F.lit(0)).alias("n"))
    return r.groupBy("day").agg(F.sum("n").cast("long").alias("total"), (F.max("t") - F.min("t")).alias("seconds")).withColumn("per_second", _nine(F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds"))))


def micro_batches(spark: SparkSession, sf_dir: str):
    """Each step's replies in as many balanced parts as its tokens need at 3000 a part, the heaviest part first by squared lengths."""
    r = table(spark, sf_dir, "rollouts").where("phase = 'train' and step is not null").select("step", "row_id", F.coalesce("response_length", F.lit(0)).alias("n"))
    return S.budgeted_batches(r, ["step"], "row_id", "n", 3000)


def order_questions(spark: SparkSession, sf_dir: str):
    """Which list tells a phase's events in order, A or B: the true order stands first or second by a hash."""
    rows = _children(spark, sf_dir).withColumn("kids", B.overlap_free(F.col("kids"))).where("size(kids) between 2 and 6")
    texts = F.transform("kids", lambda k: F.coalesce(k["text"], F.lit("")))
    rows = rows.withColumn("fwd", P.numbered_list(texts)).withColumn("rev", P.numbered_list(F.reverse(texts))).where("fwd <> rev")
    first = F.substring(F.md5(F.concat_ws(":", F.lit("ab"), "ann_id", "phase_id")), 1, 1) < "8"
    prompt = F.concat(F.lit("A:\n"), F.when(first, F.col("fwd")).otherwise(F.col("rev")), F.lit("\nB:\n"), F.when(first, F.col("rev")).otherwise(F.col("fwd")))
    return rows.select("ann_id", "phase_id", F.md5(prompt).alias("h"), F.when(first, "A").otherwise("B").alias("answer")).distinct()


def event_manifest(spark: SparkSession, sf_dir: str):
    """Phases with two or more events that don't overlap, in whole seconds, with the document's clip."""
    rows = _children(spark, sf_dir).withColumn("kids", B.overlap_free(F.col("kids"))).where("size(kids) >= 2")
    keys = table(spark, sf_dir, "annotations").select("ann_id", "clip_key", "domain_l1")
    return rows.join(keys, "ann_id").select("clip_key", "domain_l1", "phase_id", F.floor(F.col("kids")[0]["s"]).alias("s"), F.ceil(F.array_max(F.transform("kids", lambda k: k["e"]))).alias("e"), F.size("kids").cast("long").alias("n")).distinct()


def mixed_order(spark: SparkSession, sf_dir: str):
    """Two files put together and shuffled by a seed."""
    r = table(spark, sf_dir, "records").where("data_file in ('data/mixed/train_a.jsonl', 'data/tg/train.jsonl')").select("pos", F.md5(F.concat(F.lit("m1:"), F.col("pos").cast("string"))).alias("h"))
    return N.positions(r, [F.col("h"), F.col("pos")]).select("pos", "position")


def group_detail(spark: SparkSession, sf_dir: str, uid: str | None = None):
    """One group's attempts, best first, with the letter and the digits they answer; by default the first group by name."""
    r = table(spark, sf_dir, "rollouts").where("uid is not null")
    one = r.where(F.col("uid") == uid) if uid is not None else r.join(F.broadcast(r.agg(F.min("uid").alias("uid"))), "uid")
    from cinderloom.plans.rewards import _last_answer

    place = F.row_number().over(W.orderBy(F.desc_nulls_last(F.nanvl("reward", F.lit(None).cast("double"))), "row_id"))
    return one.select("row_id", place.cast("long").alias("place"), F.substring("response", 1, 500).alias("preview"), F.size(F.regexp_extract_all(F.coalesce(_last_answer(F.col("response")), F.lit("")), F.lit("[0-9]"), F.lit(0))).cast("long").alias("n_digits"))


def filtered_limit(spark: SparkSession, sf_dir: str):
    """The first 30 validation rows of one task that were rewarded."""
    r = table(spark, sf_dir, "rollouts").where("phase = 'val' and problem_type = 'llava_mcq' and reward > 0 and not isnan(reward)")
    return r.orderBy("row_id").limit(30).select("row_id", "step")


def logged_metrics(spark: SparkSession, sf_dir: str):
    """Metrics of each step as nested JSON lines, and read back flat."""
    at = _folder(spark)
    s = table(spark, sf_dir, "rollouts").where(_OK + " and step is not null").groupBy("step").agg(_nine(F.avg("reward")).alias("reward/overall"), F.count(F.lit(1)).alias("data/n"))
    K.write_json_lines(N.nested(s), at)
    return N.flat(spark.read.schema(N.nested(s).schema).json(at)).select("step", F.col("`reward/overall`").alias("reward_overall"), F.col("`data/n`").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        overlap_best, nearest, unified_records, patched_texts, kl_coefficients, whitened_rewards, throughput, micro_batches, order_questions, event_manifest, mixed_order, group_detail, filtered_limit, logged_metrics,
    )
}

_OKS = f"ok as (select * from rollouts where {_OK})"
_NODES = "ev as (select * from (select *, row_number() over (partition by video_id, lower(trim(id)) order by loaded_at desc, row_id desc) as rn from hier_events where {0}) t where rn = 1), ph as (select * from (select *, row_number() over (partition by video_id, lower(trim(id)) order by loaded_at desc, row_id desc) as rn from phases where {0}) t where rn = 1)".format(_SOUND)
_K = """p as (select ann_id, i, clip_key, domain_l1, level2.events as ev, p.phase_id as phase_id from (select ann_id, clip_key, domain_l1, level2, unnest(level1.macro_phases) as p, unnest(range(len(level1.macro_phases))) as i from annotations where level1.macro_phases is not null and level2.events is not null) a where p.phase_id is not null),
k0 as (select ann_id, i, clip_key, domain_l1, phase_id, e.start_time as s, e.end_time as e, trim(coalesce(e.instruction, '')) as text, row_number() over (partition by ann_id, i order by e.start_time, e.end_time, e.event_id, e.instruction) as j from (select *, unnest(ev) as e from p) b where e.parent_phase_id = phase_id and e.start_time < e.end_time),
k1 as (select *, lag(e) over (partition by ann_id, i order by j) as pe from k0), k as (select * from (select *, bool_or(coalesce(s < pe, false)) over (partition by ann_id, i) as clash, count(*) over (partition by ann_id, i) as n from k1) t where not clash and n >= 2)"""
SQL = {
    "overlap_best": f"""with {_NODES}, x as (select e.row_id, p.row_id as phase_row, least(e.end_time, p.end_time) - greatest(e.start_time, p.start_time) as o, abs((e.start_time + e.end_time) / 2e0 - (p.start_time + p.end_time) / 2e0) as d from ev e join ph p on e.video_id = p.video_id and e.start_time < p.end_time and p.start_time < e.end_time)
select row_id, phase_row, {r9('o')} as overlap from (select *, row_number() over (partition by row_id order by o desc, d, phase_row) as k from x) t where k = 1""",
    "nearest": f"""with {_NODES}, o as (select e.* from ev e where not exists (select 1 from ph p where p.video_id = e.video_id and lower(trim(p.id)) = lower(trim(e.parent_phase_id)))), x as (select o.row_id, p.row_id as phase_row, least(abs(o.start_time - p.start_time), abs(o.end_time - p.end_time)) as d from o join ph p on o.video_id = p.video_id)
select row_id, phase_row, {r9('d')} as dist from (select *, row_number() over (partition by row_id order by d, phase_row) as k from x) t where k = 1""",
    "unified_records": """with u as (select 'documents' as mix_source, 'text' as problem_type, coalesce(domain_l1, 'unknown') as domain_l1, text as prompt from documents
union all select 'records', coalesce(nullif(trim(problem_type), ''), 'text'), coalesce(case when json_valid(metadata) then metadata::json->>'$.domain_l1' end, 'unknown'), prompt from records) select mix_source, problem_type, domain_l1, count(*) as n, count(prompt) as n_prompts from u group by all""",
    "patched_texts": "select pos, md5(t) as h, left(t, 180) as preview from (select pos, replace(replace(replace(coalesce(prompt, ''), '<video>', '[clip] '), 'Options:', 'Choices:'), '[clip] ' || chr(10), '[clip]' || chr(10)) as t from records) a",
    "kl_coefficients": f"with {_OKS}, s as (select step, stddev_pop(reward) as kl, count(*) as n from ok where step is not null group by step) select step, floor(0.01e0 * exp(sum(ln(1 + greatest(-0.2e0, least(0.2e0, kl / 0.3e0 - 1)) * n / 10000e0)) over (order by step)) * 1e12 + 0.5e0) / 1e12 as coefficient from s",
    "whitened_rewards": f"with {_OKS} select row_id, {r9('(reward - avg(reward) over ()) / sqrt(var_samp(reward) over () + 1e-8)')} as white from ok",
    "throughput": f"with r as (select strftime(logged_at, '%Y-%m-%d') as day, cast(floor(epoch(logged_at)) as bigint) as t, coalesce(response_length, 0) as n from rollouts where logged_at is not null), g as (select day, cast(sum(n) as bigint) as total, max(t) - min(t) as seconds from r group by day) select day, total, seconds, {r9('case when seconds > 0 then total * 1e0 / seconds end')} as per_second from g",
    "order_questions": f"""with {_K}, g as (select ann_id, i, phase_id, array_to_string(list_transform(list(text order by j) filter (text <> ''), lambda x, q: concat(q, '. ', x)), chr(10)) as fwd, array_to_string(list_transform(list(text order by j desc) filter (text <> ''), lambda x, q: concat(q, '. ', x)), chr(10)) as rev from k where n <= 6 group by all),
f as (select *, left(md5('ab:' || ann_id || ':' || phase_id), 1) < '8' as a from g where fwd <> rev) select distinct ann_id, phase_id, md5('A:' || chr(10) || case when a then fwd else rev end || chr(10) || 'B:' || chr(10) || case when a then rev else fwd end) as h, case when a then 'A' else 'B' end as answer from f""",
    "event_manifest": f"with {_K} select distinct clip_key, domain_l1, phase_id, cast(floor(min(s)) as bigint) as s, cast(ceil(max(e)) as bigint) as e, count(*) as n from k group by ann_id, i, clip_key, domain_l1, phase_id",
    "mixed_order": "select pos, row_number() over (order by md5('m1:' || pos), pos) - 1 as position from records where data_file in ('data/mixed/train_a.jsonl', 'data/tg/train.jsonl')",
    "group_detail": r"select row_id, row_number() over (order by case when isnan(reward) then null else reward end desc nulls last, row_id) as place, left(response, 500) as preview, len(regexp_extract_all(coalesce(regexp_extract(response, '(?is)^.*<answer>\s*(.*?)\s*</answer>', 1), ''), '[0-9]')) as n_digits from rollouts where uid = (select min(uid) from rollouts)",
    "filtered_limit": "select row_id, step from rollouts where phase = 'val' and problem_type = 'llava_mcq' and reward > 0 and not isnan(reward) order by row_id limit 30",
    "logged_metrics": f"with {_OKS} select step, {r9('avg(reward)')} as reward_overall, count(*) as n from ok where step is not null group by step",
}
