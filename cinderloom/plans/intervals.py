"""Queries of interval scores, frame choice and token arithmetic, with oracles written on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.functions import intervals as I
from cinderloom.functions import parsing as P
from cinderloom.functions import tokens as T
from cinderloom.operators import sequences as S
from cinderloom.plans.catalog import r9
from cinderloom.plans.rewards import choice_letters, grounding_scores, sort_scores
from cinderloom.sources.tables import table

POLICY = "0:60:2.0,60:180:1.0,180:inf:0.5"
_SOUND = "not coalesce(is_deleted, false) and start_time >= 0 and start_time < end_time and end_time < 1e6"


def _nine(x: Column) -> Column:
    return F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rollouts").where("temporal_segments is not null").select(
        "row_id", S.sound_segments(F.col("temporal_segments.predicted")).alias("p"), S.sound_segments(F.col("temporal_segments.ground_truth")).alias("g")
    )


def segment_scores(spark: SparkSession, sf_dir: str):
    """Count, coverage and positional scores of every segmentation rollout."""
    df = _both(spark, sf_dir)
    return df.select(
        "row_id", _nine(I.count_reward(F.size("p"), F.size("g"))).alias("r_num"), _nine(I.coverage_iou(F.col("p"), F.col("g"))).alias("r_global"), _nine(I.local_ngiou(F.col("p"), F.col("g"))).alias("r_local")
    )


def f1_ngiou(spark: SparkSession, sf_dir: str):
    df = _both(spark, sf_dir)
    return df.select("row_id", _nine(S.f1_of(S.best_assignment_sum(F.col("p"), F.col("g"), True, 1.0), F.size("p"), F.size("g"))).alias("f1"))


def pairwise_iou(spark: SparkSession, sf_dir: str):
    """IoU of every predicted with every true segment of a rollout; bounded by one response's segments."""
    pairs = _both(spark, sf_dir).select("row_id", F.posexplode("p").alias("i", "a"), "g").select("row_id", "i", "a", F.posexplode("g").alias("j", "b"))
    return pairs.select("row_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _nine(S.iou(F.col("a"), F.col("b"))).alias("iou"))


def _dp_rewards(rows: DataFrame) -> DataFrame:
    parts = lambda c: F.transform(P.segments(F.col(c)), lambda x: F.array(x["s"], x["e"]))
    df = rows.select("row_id", parts("response").alias("p"), parts("ground_truth").alias("g"), P.is_hacked(F.col("response")).alias("hacked"))
    return df.select("row_id", S.suppressed(F.col("p")).alias("p"), "g", (F.col("hacked") | (F.size("p") == 0) | (F.size("g") == 0)).alias("void"))


def segmentation_rewards(spark: SparkSession, sf_dir: str):
    """Both segmentation rewards after suppression: count with ordered matching, coverage with positions; 0 for broken or hacked replies."""
    df = _dp_rewards(table(spark, sf_dir, "rollouts").where("problem_type = 'temporal_seg'"))
    p, g = F.col("p"), F.col("g")
    dp = (I.count_reward(F.size(p), F.size(g)) + S.f1_of(S.ordered_match(p, g), F.size(p), F.size(g))) / 2
    match = (I.coverage_iou(p, g) + I.local_ngiou(p, g)) / 2
    return df.select("row_id", _nine(F.when(F.col("void"), 0.0).otherwise(dp)).alias("dp_reward"), _nine(F.when(F.col("void"), 0.0).otherwise(match)).alias("match_reward"))


def mixed_rewards(spark: SparkSession, sf_dir: str):
    """One reward for every rollout, by its type, else by the shape of its truth: a letter, events, digits, or a plain choice."""
    rows = table(spark, sf_dir, "rollouts").select("row_id", "problem_id", "problem_type", "response", "ground_truth")
    truth, kind = P.given(F.col("ground_truth")), P.given(F.col("problem_type"))
    known = kind.isin("temporal_grounding", "event_logic_sort", "sort", "llava_mcq", "event_logic_predict_next", "event_logic_fill_blank") | kind.startswith("seg_aot_")
    shaped = F.when(truth.rlike(r"^\s*[A-Z]\s*$"), "choice").when(truth.contains("<events>"), "seg").when(F.trim(truth).rlike(r"^\d+$"), "sort").otherwise("choice")
    way = F.when(kind == "temporal_grounding", "grounding").when(kind.isin("event_logic_sort", "sort"), "sort").when(known, "choice").otherwise(shaped)
    rows = rows.withColumn("way", way)
    choice = choice_letters(rows.where("way = 'choice'").withColumn("problem_type", F.lit("llava_mcq"))).select("row_id", F.col("is_match").cast("double").alias("reward"))
    sort = sort_scores(rows.where("way = 'sort'").withColumn("problem_type", F.lit("sort"))).select("row_id", "reward")
    grounding = grounding_scores(rows.where("way = 'grounding'"), spark.createDataFrame([], "problem_id string, duration double")).select("row_id", "reward")
    seg = _dp_rewards(rows.where("way = 'seg'"))
    f1 = S.f1_of(S.best_assignment_sum(F.col("p"), F.col("g")), F.size("p"), F.size("g"))
    seg = seg.select("row_id", _nine(F.when(F.col("void"), 0.0).otherwise(f1)).alias("reward"))
    return choice.unionByName(sort).unionByName(grounding).unionByName(seg)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hier_events").where(_SOUND)


def frame_spans(spark: SparkSession, sf_dir: str):
    rows = _events(spark, sf_dir).select("row_id", I.frame_span(F.col("start_time"), F.col("end_time"), F.lit(2.0)).alias("f"))
    return rows.select("row_id", "f.first", "f.last")


def frame_choice(spark: SparkSession, sf_dir: str):
    """Eight frames at most of every clip, evenly spread, and the clip's frames thinned from 2 to 0.8 a second."""
    rows = table(spark, sf_dir, "annotations").where("n_frames is not null")
    even = I.uniform_indices(F.col("n_frames"), F.lit(8))
    thin = I.strided_indices(F.col("n_frames"), F.lit(2.0), F.lit(0.8))
    return rows.select("ann_id", F.array_join(F.transform(even, lambda x: x.cast("string")), ",").alias("even"), F.size(thin).cast("long").alias("n_thin"), F.array_max(thin).alias("last_thin"))


def frame_rates(spark: SparkSession, sf_dir: str):
    """The rate of every clip by the duration policy, by a shared budget of 256 frames, and the effective one."""
    d = F.col("clip_duration_sec")
    rows = table(spark, sf_dir, "annotations")
    return rows.select("ann_id", I.policy_fps(d, I.parse_policy(POLICY)).alias("by_policy"), _nine(F.when(d > 0, I.shared_fps(d, 2.0, 1.0, 256, 0.25))).alias("shared"), _nine(F.when((d > 0) & (F.col("n_frames") > 0), F.col("n_frames") / d)).alias("effective"))


def record_rates(spark: SparkSession, sf_dir: str):
    """A record's frame rate and duration: the first positive value among the places it may stand in."""
    m = F.try_parse_json("metadata")
    at = lambda path: F.try_variant_get(m, path, "double")
    positive = lambda *xs: F.coalesce(*[F.when(x > 0, x) for x in xs])
    clip = P.clip_parts(F.try_variant_get(m, "$.clip_key", "string"))
    rows = table(spark, sf_dir, "records")
    return rows.select("pos", positive(at("$.video_fps_override"), at("$.offline_frame_extraction.effective_fps"), F.lit(2.0)).alias("fps"), positive(at("$.duration"), at("$.clip_duration_sec"), clip["end_sec"] - clip["start_sec"]).alias("duration"))


def clip_bounds(spark: SparkSession, sf_dir: str):
    """Padded clips around events, at most 40 s long, within a clip of 300 s."""
    rows = _events(spark, sf_dir).where("end_time <= 300")
    b = I.padded_bounds(F.floor("start_time").cast("long"), F.ceil("end_time").cast("long"), 5, 40, F.lit(300))
    return rows.select("row_id", b.alias("b")).select("row_id", "b.s", "b.e")


def children_in_parents(spark: SparkSession, sf_dir: str):
    """Actions cut to their event and counted from its start; what is shorter than a second is dropped, the rest numbered anew."""
    e = _events(spark, sf_dir).select("video_id", F.lower(F.trim("id")).alias("eid"), F.col("row_id").alias("event_row"), F.col("start_time").alias("ps"), F.col("end_time").alias("pe"))
    a = table(spark, sf_dir, "actions").where(_SOUND).select("video_id", F.lower(F.trim("parent_event_id")).alias("eid"), "row_id", "start_time", "end_time")
    cut = a.join(e, ["video_id", "eid"]).select("event_row", "row_id", (F.greatest("start_time", "ps") - F.col("ps")).alias("s"), (F.least("end_time", "pe") - F.col("ps")).alias("e"))
    # The smallest of a group's starts first; groups are the actions of one event.
    from pyspark.sql.window import Window as W

    rank = F.row_number().over(W.partitionBy("event_row").orderBy("s", "e", "row_id"))
    return cut.where("e - s >= 1").select("event_row", "row_id", _nine(F.col("s")).alias("s"), _nine(F.col("e")).alias("e"), rank.cast("long").alias("k"))


def zero_based_phases(spark: SparkSession, sf_dir: str):
    spans = F.transform(F.filter("level2.events", lambda x: x.isNotNull()), lambda x: F.array(x["start_time"], x["end_time"]))
    rows = table(spark, sf_dir, "annotations").where("level2.events is not null").withColumn("ev", spans)
    phases = rows.select("ann_id", "ev", F.posexplode("level1.macro_phases").alias("k", "p")).where("p is not null")
    cut = I.zero_based(F.col("ev"), F.col("p.start_time"), F.col("p.end_time"))
    return phases.select("ann_id", F.col("k").cast("long").alias("k"), F.size(cut).cast("long").alias("n_events"), _nine(I.total_length(cut)).alias("covered"))


def clip_windows(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "annotations").where("clip_duration_sec is not null")
    w = rows.select("ann_id", F.explode(I.sliding_windows(F.floor("clip_duration_sec").cast("long"))).alias("w"))
    return w.select("ann_id", F.col("w")[0].alias("s"), F.col("w")[1].alias("e"))


def frame_hits(spark: SparkSession, sf_dir: str):
    """How many phases of a document cover each of its seconds."""
    phases = table(spark, sf_dir, "annotations").select("ann_id", F.explode("level1.macro_phases").alias("p")).where("p.start_time >= 0 and p.start_time < p.end_time")
    second = F.explode(F.sequence(F.floor("p.start_time").cast("long"), F.ceil("p.end_time").cast("long") - 1)).alias("second")
    return phases.select("ann_id", second).groupBy("ann_id", "second").agg(F.count(F.lit(1)).alias("n"))


def boundary_spans(spark: SparkSession, sf_dir: str):
    starts = F.transform(F.filter("level1.macro_phases", lambda x: x.isNotNull() & x["start_time"].isNotNull()), lambda x: x["start_time"])
    rows = table(spark, sf_dir, "annotations").where("level1.macro_phases is not null and clip_duration_sec > 0")
    spans = rows.select("ann_id", F.posexplode(I.boundary_segments(starts, F.col("clip_duration_sec"))).alias("k", "s"))
    return spans.select("ann_id", F.col("k").cast("long").alias("k"), F.col("s")[0].alias("s"), F.col("s")[1].alias("e"))


def frame_budgets(spark: SparkSession, sf_dir: str):
    """For budgets of 16, 64 and 256 frames: mean effective rate, share of clips thinned, and share below one frame in two seconds."""
    rows = table(spark, sf_dir, "annotations").where("clip_duration_sec > 0").select("domain_l1", F.col("clip_duration_sec").alias("d"), F.explode(F.array(*[F.lit(b) for b in (16, 64, 256)])).alias("budget"))
    rate = F.least(F.lit(2.0), F.col("budget") / F.col("d"))
    return rows.groupBy("budget").agg(F.count(F.lit(1)).alias("n"), _nine(F.avg(rate)).alias("mean_fps"), _nine(F.avg((rate < 2).cast("double"))).alias("thinned"), _nine(F.avg((rate < 0.5).cast("double"))).alias("sparse"))


def frame_numbers(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "phases").where(_SOUND)
    return rows.select("row_id", I.second_to_frame(F.col("start_time"), F.lit(2.0), F.lit(400)).alias("frame"))


# Token arrays: the vectors' quarters stand for log-probabilities, reference ones, rewards and values.
def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.transform(F.slice("embedding", 16 * k + 1, 16), lambda x: x.cast("double"))
    minus = lambda c: F.transform(c, lambda x: -F.abs(x))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i <= F.col("vec_id") % 16).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", minus(part(0)).alias("p"), minus(part(1)).alias("q"), part(2).alias("r"), part(3).alias("v"), mask.alias("m"))


def masked_stats(spark: SparkSession, sf_dir: str):
    r, v, m = F.col("r"), F.col("v"), F.col("m")
    white = T.whitened(r, m)
    return _tokens(spark, sf_dir).select("vec_id", _nine(T.masked_mean(r, m)).alias("mean"), _nine(T.masked_var(r, m)).alias("var"), _nine(white[0]).alias("white"), _nine(T.explained_variance(r, v, m)).alias("explained"))


def token_returns(spark: SparkSession, sf_dir: str):
    df = _tokens(spark, sf_dir)
    adv = T.gae(F.col("r"), F.col("v"), 0.99, 0.95)
    rows = df.select("vec_id", F.posexplode(F.arrays_zip(T.masked_returns(F.col("r"), F.col("m"), 0.9).alias("y"), adv.alias("a"))).alias("k", "z"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), _nine(F.col("z.y")).alias("ret"), _nine(F.col("z.a")).alias("gae"))


def kl_estimates(spark: SparkSession, sf_dir: str):
    p, q, m = F.col("p"), F.col("q"), F.col("m")
    kinds = [_nine(T.masked_mean(T.kl(p, q, k), m)).alias(f"{k}") for k in ("kl", "abs", "mse", "low_var_kl")]
    return _tokens(spark, sf_dir).select("vec_id", *kinds)


def policy_losses(spark: SparkSession, sf_dir: str):
    """Clipped policy and value losses averaged over tokens and over sequences, with the clipped shares."""
    losses = T.clipped_losses(F.transform("p", lambda x: x * 5), F.transform("q", lambda x: x * 5), F.col("label") % 3 - F.lit(1.0))
    df = _tokens(spark, sf_dir).withColumn("l", losses).withColumn("vl", T.value_losses(F.col("v"), F.col("r"), F.col("q"), 0.05))
    n = T._sum(F.transform("m", lambda m: m.cast("double")))
    total = lambda f, c: T.masked_sum(F.transform(c, f), F.col("m"))
    rows = df.select("label", n.alias("n"), total(lambda x: x["loss"], "l").alias("loss"), total(lambda x: x["clipped"], "l").alias("clipped"), total(lambda x: x["lower"], "l").alias("lower"), total(lambda x: x, "vl").alias("vl"))
    return rows.groupBy("label").agg(
        _nine(F.sum("loss") / F.sum("n")).alias("token_loss"), _nine(F.avg(F.col("loss") / F.col("n"))).alias("seq_loss"), _nine(F.sum("clipped") / F.sum("n")).alias("clipped"),
        _nine(F.sum("lower") / F.sum("n")).alias("lower"), _nine(F.sum("vl") / F.sum("n")).alias("value_loss"),
    )


def token_shapes(spark: SparkSession, sf_dir: str):
    """Masks up to an end sign, padding, truncation and the place of an outcome's score, on the labels of the vectors."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: (i * (F.col("label") + 3) % 7).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"))
    mask = T.eos_mask(F.col("ids"), 5)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    score = T.at_last_valid(F.lit(1.0), mask)
    return rows.select(
        "vec_id", text(mask).alias("mask"), text(T.padded(F.slice("ids", 1, 3), 5, F.lit(0), True)).alias("left"), text(T.padded(F.slice("ids", 1, 3), 5, F.lit(0))).alias("right"),
        text(T.truncated(F.col("ids"), 4)).alias("head"), text(T.truncated(F.col("ids"), 4, "left")).alias("tail"), F.array_position(score, 1.0).alias("scored"),
    )


def ema_moments(rows: DataFrame, decay: float, least: float) -> DataFrame:
    """``task, step, std`` of ``rows(task, step, reward)``: moving first and second moments over each task's steps in order.

    The first step starts them; a step's own batch is counted before its deviation is read. A task's
    steps, one pair of numbers each, are folded in one array.
    """
    per = rows.groupBy("task", "step").agg(F.avg("reward").alias("m1"), F.avg(F.col("reward") * F.col("reward")).alias("m2"))
    series = per.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("step", "m1", "m2"))).alias("l"))
    item = "array<struct<step:int,m1:double,m2:double>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        moved = lambda c: F.when(last.isNull(), x[c]).otherwise(F.lit(decay) * last[c] + F.lit(1 - decay) * x[c])
        return F.concat(acc, F.array(F.struct(x["step"].alias("step"), moved("m1").alias("m1"), moved("m2").alias("m2"))))

    folded = series.select("task", F.explode(F.aggregate("l", F.expr(f"cast(array() as {item})"), add)).alias("x"))
    spread = F.greatest(F.greatest(F.col("x.m2") - F.col("x.m1") * F.col("x.m1"), F.lit(0.0)), F.lit(least * least))
    return folded.select("task", "x.step", F.sqrt(spread).alias("std"))


def task_family(kind: Column) -> Column:
    """Tasks that share a reward share their moments."""
    return (
        F.when(kind == "temporal_grounding", "tg").when(kind.startswith("temporal_seg"), "seg").when(kind.contains("sort") & ~kind.startswith("seg_aot_"), "sort")
        .when(kind.startswith("event_logic_") | kind.startswith("seg_aot_") | (kind == "llava_mcq"), "mcq").otherwise(kind)
    )


def ema_grpo(spark: SparkSession, sf_dir: str):
    """Rewards less their group's mean over the task's moving deviation; a group with any value beyond 5 goes by its own deviation. Groups of one give none."""
    from pyspark.sql.window import Window as W

    ok = table(spark, sf_dir, "rollouts").where("reward is not null and not isnan(reward) and uid is not null and problem_type is not null and step is not null")
    ok = ok.select("row_id", "uid", "step", task_family(F.col("problem_type")).alias("task"), "reward")
    stds = ema_moments(ok, 0.9, 1e-3)
    group = W.partitionBy("uid", "step", "task")
    rows = ok.withColumns({"c": F.col("reward") - F.avg("reward").over(group), "n": F.count(F.lit(1)).over(group), "own": F.stddev_pop("reward").over(group)}).where("n > 1").join(stds, ["task", "step"])
    scaled = F.col("c") / (F.col("std") + F.lit(1e-6))
    worst = F.max(F.abs(scaled)).over(group)
    return rows.select("row_id", F.when(worst > 5, F.col("c") / (F.col("own") + F.lit(1e-6))).otherwise(scaled).alias("a")).select("row_id", _nine(F.col("a")).alias("advantage"))


QUERIES = {
    f.__name__: f
    for f in (
        segment_scores, f1_ngiou, pairwise_iou, segmentation_rewards, mixed_rewards, frame_spans, frame_choice, frame_rates, record_rates, clip_bounds, children_in_parents, zero_based_phases, clip_windows,
        frame_hits, boundary_spans, frame_budgets, frame_numbers, masked_stats, token_returns, kl_estimates, policy_losses, token_shapes, ema_grpo,
    )
}

_VALID = "list_filter({}, lambda s: len(s) = 2 and s[1] >= 0 and s[1] < s[2] and not isnan(s[2]))"
_SEGS = f"b as (select row_id, {_VALID.format('temporal_segments.predicted')} as p, {_VALID.format('temporal_segments.ground_truth')} as g from rollouts where temporal_segments is not null)"
_UNION = """{n}0 as (select row_id, unnest({n})[1] as s, unnest({n})[2] as e from b), {n}1 as (select *, max(e) over (partition by row_id order by s, e rows between unbounded preceding and 1 preceding) as pe from {n}0),
{n}2 as (select row_id, s, e, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by row_id order by s, e rows unbounded preceding) as k from {n}1), {n}3 as (select row_id, k, min(s) as s, max(e) as e from {n}2 group by all)"""
_NGIOU = "(greatest(0, least(x[2], y[2]) - greatest(x[1], y[1])) / (x[2] - x[1] + y[2] - y[1] - greatest(0, least(x[2], y[2]) - greatest(x[1], y[1]))) - (greatest(x[2], y[2]) - least(x[1], y[1]) - (x[2] - x[1] + y[2] - y[1] - greatest(0, least(x[2], y[2]) - greatest(x[1], y[1])))) / (greatest(x[2], y[2]) - least(x[1], y[1])) + 1) / 2"
_TOK = """t as (select vec_id, label, i, -abs(embedding[i]::double) as p, -abs(embedding[i + 16]::double) as q, embedding[i + 32]::double as r, embedding[i + 48]::double as v, case when i - 1 <= vec_id % 16 then 1 else 0 end as m from embeddings, range(1, 17) as x(i))"""
_TASK = "case when problem_type = 'temporal_grounding' then 'tg' when starts_with(problem_type, 'temporal_seg') then 'seg' when contains(problem_type, 'sort') and not starts_with(problem_type, 'seg_aot_') then 'sort' when starts_with(problem_type, 'event_logic_') or starts_with(problem_type, 'seg_aot_') or problem_type = 'llava_mcq' then 'mcq' else problem_type end"
_LIVE = "not coalesce(is_deleted, false) and not isnan(start_time) and not isnan(end_time) and start_time >= 0 and start_time < end_time and end_time < 1e6"
_PH = "(select ann_id, clip_duration_sec, level2.events as ev, unnest(level1.macro_phases) as p, unnest(range(len(level1.macro_phases))) as k from annotations)"
SQL = {
    "segment_scores": f"""with {_SEGS}, {_UNION.format(n='p')}, {_UNION.format(n='g')},
i as (select p3.row_id, sum(greatest(0, least(p3.e, g3.e) - greatest(p3.s, g3.s))) as x from p3 join g3 on p3.row_id = g3.row_id group by all), lp as (select row_id, sum(e - s) as x from p3 group by all), lg as (select row_id, sum(e - s) as x from g3 group by all),
pr as (select row_id, list_sort(p)[j] as x, list_sort(g)[j] as y from (select *, unnest(range(1, least(len(p), len(g)) + 1)) as j from b) a), l as (select row_id, sum({_NGIOU}) as x from pr group by all)
select b.row_id, {r9('case when len(g) > 0 then exp(-abs(len(p) - len(g)) / least(len(g), 3)) else 0e0 end')} as r_num, {r9('case when coalesce(lp.x, 0) + coalesce(lg.x, 0) > 0 then coalesce(i.x, 0) / (coalesce(lp.x, 0) + coalesce(lg.x, 0) - coalesce(i.x, 0)) else 0e0 end')} as r_global,
{r9('case when greatest(len(p), len(g)) > 0 then coalesce(l.x, 0) / greatest(len(p), len(g)) else 0e0 end')} as r_local from b left join i on b.row_id = i.row_id left join lp on b.row_id = lp.row_id left join lg on b.row_id = lg.row_id left join l on b.row_id = l.row_id""",
    "pairwise_iou": f"with {_SEGS} select row_id, i - 1 as i, j - 1 as j, {r9('greatest(0, least(p[i][2], g[j][2]) - greatest(p[i][1], g[j][1])) / (p[i][2] - p[i][1] + g[j][2] - g[j][1] - greatest(0, least(p[i][2], g[j][2]) - greatest(p[i][1], g[j][1])))')} as iou from (select *, unnest(range(1, len(g) + 1)) as j from (select *, unnest(range(1, len(p) + 1)) as i from b) a) c",
    "frame_spans": f"select row_id, cast(greatest(0, ceil(start_time * 2 - 1e-6)) as bigint) as first, cast(greatest(greatest(0, ceil(start_time * 2 - 1e-6)), ceil(end_time * 2 - 1e-6) - 1) as bigint) as last from hier_events where {_LIVE}",
    "frame_choice": """select ann_id, case when n_frames <= 0 then '' when n_frames <= 8 then coalesce((select string_agg(i, ',' order by i) from range(0, n_frames) as x(i)), '') else (select string_agg(distinct cast(round_even(i * (n_frames - 1) / 7e0, 0) as bigint), ',' order by cast(round_even(i * (n_frames - 1) / 7e0, 0) as bigint)) from range(0, 8) as x(i)) end as even,
case when n_frames <= 0 then 0 else (select count(distinct least(n_frames - 1, cast(round_even(i * 2.5e0, 0) as bigint))) from range(0, cast(greatest(1, ceil(n_frames / 2.5e0 - 1e-9)) as bigint)) as x(i)) end as n_thin, (select max(least(n_frames - 1, cast(round_even(i * 2.5e0, 0) as bigint))) from range(0, cast(greatest(1, ceil(n_frames / 2.5e0 - 1e-9)) as bigint)) as x(i)) as last_thin from annotations where n_frames is not null""",
    "frame_rates": f"""select ann_id, case when clip_duration_sec between 0 and 60 then 2.0e0 when clip_duration_sec between 60 and 180 then 1.0e0 when clip_duration_sec >= 180 then 0.5e0 end as by_policy,
{r9('case when clip_duration_sec > 0 then case when clip_duration_sec <= 128 then 2e0 when clip_duration_sec <= 256 then 1e0 else greatest(0.25e0, 256e0 / clip_duration_sec) end end')} as shared, {r9('case when clip_duration_sec > 0 and n_frames > 0 then n_frames / clip_duration_sec end')} as effective from annotations""",
    "record_rates": rf"""with j as (select pos, case when json_valid(metadata) then metadata::json end as m from records), x as (select pos, try_cast(m->>'$.video_fps_override' as double) as a, try_cast(m->>'$.offline_frame_extraction.effective_fps' as double) as b, try_cast(m->>'$.duration' as double) as c, try_cast(m->>'$.clip_duration_sec' as double) as d, lower(trim(m->>'$.clip_key')) as k from j)
select pos, coalesce(case when a > 0 then a end, case when b > 0 then b end, 2e0) as fps, coalesce(case when c > 0 then c end, case when d > 0 then d end, case when x > 0 then x end) as duration from (select *, try_cast(nullif(regexp_extract(k, '^(.+)[_-](\d+(?:\.\d+)?)[_-](\d+(?:\.\d+)?)$', 3), '') as double) - try_cast(nullif(regexp_extract(k, '^(.+)[_-](\d+(?:\.\d+)?)[_-](\d+(?:\.\d+)?)$', 2), '') as double) as x from x) y""",
    "clip_bounds": f"""with a as (select row_id, cast(floor(start_time) as bigint) as es, cast(ceil(end_time) as bigint) as ee from hier_events where {_LIVE} and end_time <= 300), b as (select *, greatest(0, es - 5) as s, least(300, ee + 5) as e from a),
c as (select *, greatest(0, e - s - 40) as o, s + least(greatest(0, e - s - 40) // 2, es - s) as n from b) select row_id, case when o > 0 then n else s end as s, case when o > 0 then n + 40 else e end as e from c""",
    "children_in_parents": f"""with e as (select video_id, lower(trim(id)) as eid, row_id as event_row, start_time as ps, end_time as pe from hier_events where {_LIVE}), c as (select event_row, a.row_id, greatest(start_time, ps) - ps as s, least(end_time, pe) - ps as e from actions a join e on a.video_id = e.video_id and lower(trim(parent_event_id)) = eid where {_LIVE})
select event_row, row_id, {r9('s')} as s, {r9('e')} as e, row_number() over (partition by event_row order by s, e, row_id) as k from c where e - s >= 1""",
    "zero_based_phases": f"""with p as (select * from {_PH} x where p is not null and ev is not null), c as (select ann_id, k, greatest(e.start_time, p.start_time) - p.start_time as s, least(e.end_time, p.end_time) - p.start_time as f from (select ann_id, k, p, unnest(list_filter(ev, lambda z: z is not null)) as e from p) y)
select p.ann_id, k, coalesce(n, 0) as n_events, {r9('coalesce(t, 0e0)')} as covered from p left join (select ann_id, k, count(*) as n, sum(f - s) as t from c where s < f group by all) d using (ann_id, k)""",
    "clip_windows": """with w as (select ann_id, d, s, least(s + 128, d) as e from (select ann_id, cast(floor(clip_duration_sec) as bigint) as d, unnest(range(0, cast(floor(clip_duration_sec) as bigint), 64)) as s from annotations where clip_duration_sec is not null) a)
select ann_id, s, e from w where e - s >= 32 and (s = 0 or s - 64 + 128 < d)""",
    "frame_hits": f"select ann_id, second, count(*) as n from (select ann_id, unnest(range(cast(floor(p.start_time) as bigint), cast(ceil(p.end_time) as bigint))) as second from {_PH} x where p.start_time >= 0 and p.start_time < p.end_time) a group by all",
    "boundary_spans": f"""with c as (select ann_id, p.start_time as x, clip_duration_sec as d from {_PH} a where clip_duration_sec > 0 and p.start_time > 0 and p.start_time < clip_duration_sec union select ann_id, 0e0, clip_duration_sec from annotations where clip_duration_sec > 0 and level1.macro_phases is not null)
select ann_id, row_number() over (partition by ann_id order by s) - 1 as k, s, e from (select ann_id, x as s, coalesce(lead(x) over (partition by ann_id order by x), d) as e from c) t where s < e""",
    "frame_budgets": f"""select budget, count(*) as n, {r9('avg(r)')} as mean_fps, {r9('avg(case when r < 2 then 1e0 else 0e0 end)')} as thinned, {r9('avg(case when r < 0.5 then 1e0 else 0e0 end)')} as sparse from (select b as budget, least(2e0, b / clip_duration_sec) as r from annotations, (values (16), (64), (256)) as v(b) where clip_duration_sec > 0) t group by all""",
    "frame_numbers": f"select row_id, least(400, greatest(1, cast(round_even(start_time * 2, 0) as bigint) + 1)) as frame from phases where {_LIVE}",
    "masked_stats": f"""with {_TOK}, a as (select vec_id, sum(m) as n, sum(r * m) / (sum(m) + 1e-8) as mu, sum((r - v) * m) / (sum(m) + 1e-8) as nu, max(case when i = 1 then r end) as r0 from t group by all),
b as (select a.vec_id, n, mu, r0, case when n > 1 then sum((r - mu) * (r - mu) * m) / (n + 1e-8) * n / (n - 1) end as var, case when n > 1 then sum((r - v - nu) * (r - v - nu) * m) / (n + 1e-8) * n / (n - 1) end as rest from a join t using (vec_id) group by vec_id, n, mu, nu, r0)
select vec_id, {r9('mu')} as mean, {r9('var')} as var, {r9('(r0 - mu) / sqrt(var + 1e-8)')} as white, {r9('1 - rest / (var + 1e-5)')} as explained from b""",
    "token_returns": f"""with {_TOK}, d as (select vec_id, i, r, m, r + 0.99e0 * coalesce(lead(v) over (partition by vec_id order by i), 0) - v as x from t)
select a.vec_id, a.i - 1 as k, {r9('sum(case when b.i = a.i or b.m = 1 then b.r * pow(0.9e0, b.i - a.i) else 0 end)')} as ret, {r9('sum(b.x * pow(0.99e0 * 0.95e0, b.i - a.i))')} as gae from d a join d b on a.vec_id = b.vec_id and b.i >= a.i group by all""",
    "kl_estimates": f"""with {_TOK} select vec_id, {r9('sum((p - q) * m) / (sum(m) + 1e-8)')} as kl, {r9('sum(abs(p - q) * m) / (sum(m) + 1e-8)')} as abs, {r9('sum((p - q) * (p - q) / 2 * m) / (sum(m) + 1e-8)')} as mse, {r9('sum((exp(q - p) - (q - p) - 1) * m) / (sum(m) + 1e-8)')} as low_var_kl from t group by all""",
    "policy_losses": f"""with {_TOK}, x as (select *, label % 3 - 1e0 as a, exp((p - q) * 5) as ratio from t), y as (select *, greatest(-a * ratio, -a * least(1.2e0, greatest(0.8e0, ratio))) as up, greatest((v - r) * (v - r), (least(q + 0.05e0, greatest(q - 0.05e0, v)) - r) * (least(q + 0.05e0, greatest(q - 0.05e0, v)) - r)) / 2 as vl from x),
z as (select label, vec_id, sum(m) as n, sum(m * case when a < 0 then least(up, -a * 3) else up end) as loss, sum(case when m = 1 and -a * ratio < -a * least(1.2e0, greatest(0.8e0, ratio)) then 1 else 0 end) as c, sum(case when m = 1 and a < 0 and up > -a * 3 then 1 else 0 end) as l, sum(m * vl) as vl from y group by all)
select label, {r9('sum(loss) / sum(n)')} as token_loss, {r9('avg(loss / n)')} as seq_loss, {r9('sum(c) / sum(n)')} as clipped, {r9('sum(l) / sum(n)')} as lower, {r9('sum(vl) / sum(n)')} as value_loss from z group by all""",
    "token_shapes": """with a as (select vec_id, i, i * (label + 3) % 7 as x from embeddings, range(1, 13) as r(i)), e as (select vec_id, min(case when x = 5 then i end) as f from a group by all)
select a.vec_id, string_agg(case when f is null or i <= f then 1 else 0 end, ',' order by i) as mask, '0,0,' || string_agg(case when i <= 3 then x end, ',' order by i) as left, string_agg(case when i <= 3 then x end, ',' order by i) || ',0,0' as right,
string_agg(case when i <= 4 then x end, ',' order by i) as head, string_agg(case when i > 8 then x end, ',' order by i) as tail, coalesce(max(f), 12) as scored from a join e using (vec_id) group by all""",
    "ema_grpo": f"""with ok as (select row_id, uid, step, {_TASK} as task, reward from rollouts where reward is not null and not isnan(reward) and uid is not null and problem_type is not null and step is not null),
s as (select task, step, avg(reward) as m1, avg(reward * reward) as m2, row_number() over (partition by task order by step) as k from ok group by task, step),
m as (select a.task, a.step, sum(b.m1 * pow(0.9e0, a.k - b.k) * case when b.k = 1 then 1e0 else 0.1e0 end) as m1, sum(b.m2 * pow(0.9e0, a.k - b.k) * case when b.k = 1 then 1e0 else 0.1e0 end) as m2 from s a join s b on a.task = b.task and b.k <= a.k group by all),
r as (select ok.*, reward - avg(reward) over g as c, count(*) over g as n, stddev_pop(reward) over g as own from ok window g as (partition by uid, step, task)),
x as (select row_id, uid, r.step, r.task, c, own, c / (sqrt(greatest(greatest(m2 - m1 * m1, 0), 1e-6)) + 1e-6) as z from r join m on r.task = m.task and r.step = m.step where n > 1)
select row_id, {r9('case when max(abs(z)) over (partition by uid, step, task) > 5 then c / (own + 1e-6) else z end')} as advantage from x""",
}
