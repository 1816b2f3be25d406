"""Queries of lookups, filters and summaries over several tables, with oracles written on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cinderloom.functions import parsing as P
from cinderloom.operators import lookups as L
from cinderloom.plans.catalog import r9
from cinderloom.sources.tables import table

_SOUND = "not coalesce(is_deleted, false) and start_time >= 0 and start_time < end_time and end_time < 1e6"


def _nine(x: Column) -> Column:
    return F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def _ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rollouts").where("reward is not null and not isnan(reward) and uid is not null")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").withColumn("m", F.try_parse_json("metadata"))


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Report rows, whose number serves as an index that may point elsewhere, and the input they are about."""
    probe = table(spark, sf_dir, "rollouts").select("row_id", F.col("row_id").alias("pos"), "prompt", F.col("ground_truth").alias("answer"))
    return probe, table(spark, sf_dir, "records").select("pos", "prompt", "answer", F.col("pos").alias("found"))


def fallback_lookup(spark: SparkSession, sf_dir: str):
    return L.index_then_content(*_reports(spark, sf_dir), "pos", ["prompt", "answer"], "found").select("row_id", "found", "way")


def fallback_lookup_content_first(spark: SparkSession, sf_dir: str):
    return L.content_then_index(*_reports(spark, sf_dir), "pos", ["prompt", "answer"], "found", "found").select("row_id", "found", "way")


def identity_cascade(spark: SparkSession, sf_dir: str):
    rows = _meta(spark, sf_dir).select("pos", L.identity_key(F.try_variant_get("m", "$.id", "string"), [F.col("prompt"), F.col("answer")], [F.col("data_file"), F.col("pos").cast("string")]).alias("k"))
    return rows.groupBy("k.way", "k.key").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def content_join(spark: SparkSession, sf_dir: str):
    """How often each rollout's content occurs among the records; counted before the join, so repeats don't multiply."""
    counts = table(spark, sf_dir, "records").groupBy("prompt", "answer").agg(F.count(F.lit(1)).alias("n_records"))
    rows = table(spark, sf_dir, "rollouts").select("row_id", "prompt", F.col("ground_truth").alias("answer"))
    return rows.join(counts, ["prompt", "answer"]).select("row_id", "n_records")


def held_out(spark: SparkSession, sf_dir: str):
    """Training records whose prompt is in no validation file."""
    r = table(spark, sf_dir, "records")
    val = r.where("data_file like '%/val%'").select("prompt")
    return r.where("data_file like '%train%'").join(val, "prompt", "left_anti").select("pos", "data_file")


def array_anti(spark: SparkSession, sf_dir: str):
    """Every rollout with the reason to drop it: a video of which some annotation has a broken level."""
    broken = table(spark, sf_dir, "annotations").select("video_path", F.when(F.col("level1._parse_error"), "level1").when(F.col("level2._parse_error"), "level2").when(F.col("level3._parse_error"), "level3").alias("why")).where("why is not null")
    return L.without_bad_elements(table(spark, sf_dir, "rollouts"), "row_id", "video_paths", broken, "video_path", "why")


def parent_child(spark: SparkSession, sf_dir: str):
    """Each phase with its events in order of time; a phase's own events are few."""
    e = table(spark, sf_dir, "hier_events").where(_SOUND).select("video_id", F.lower(F.trim("parent_phase_id")).alias("pid"), F.struct("start_time", "end_time", "row_id").alias("x"))
    kids = e.groupBy("video_id", "pid").agg(F.array_sort(F.collect_list("x")).alias("l"))
    p = table(spark, sf_dir, "phases").where(_SOUND).select("row_id", "video_id", F.lower(F.trim("id")).alias("pid"))
    return p.join(kids, ["video_id", "pid"]).select("row_id", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x["row_id"].cast("string")), ",").alias("children"))


def enriched_documents(spark: SparkSession, sf_dir: str):
    """A document's second-level domain by its clip's latest annotation, else its own first-level domain."""
    a = table(spark, sf_dir, "annotations").where("clip_key is not null").groupBy(F.lower(F.trim("clip_key")).alias("k")).agg(F.max_by("domain_l2", F.struct("annotated_at", "ann_id")).alias("d2"))
    d = table(spark, sf_dir, "documents").withColumn("k", F.lower(F.trim("clip_key")))
    return d.join(a, "k", "left").select("doc_id", F.coalesce("d2", "domain_l1", F.lit("uncategorized")).alias("domain"))


def setting_alignment(spark: SparkSession, sf_dir: str):
    """Per video the settings it was run under, and whether one is missing."""
    rows = table(spark, sf_dir, "rollouts").select(F.col("video_paths")[0].alias("video"), "phase").where("video is not null")
    seen = rows.groupBy("video").agg(F.count_if(F.col("phase") == "train").alias("n_train"), F.count_if(F.col("phase") == "val").alias("n_val"))
    return seen.withColumn("is_complete", (F.col("n_train") > 0) & (F.col("n_val") > 0))


def checked_merge(spark: SparkSession, sf_dir: str):
    """One row per source video, nulls filled from its other rows, columns in conflict named."""
    return L.merged_rows(table(spark, sf_dir, "annotations").where("source_video_path is not null"), ["source_video_path"], ["clip_key", "clip_duration_sec"])


def resolved_items(spark: SparkSession, sf_dir: str):
    """Ordered ids of records as rows of the clip's annotated events."""
    ids = _meta(spark, sf_dir).select("pos", F.lower(F.trim(F.try_variant_get("m", "$.clip_key", "string"))).alias("clip"), F.posexplode(F.try_variant_get("m", "$.ordered_ids", "array<string>")).alias("k", "id"))
    ids = ids.select("pos", "clip", F.col("k").cast("long").alias("k"), P.item_id(F.col("id")).alias("i")).select("pos", "clip", "k", "i.kind", F.col("i.parent").alias("num"))
    ann = table(spark, sf_dir, "annotations").select(F.lower(F.trim("clip_key")).alias("clip"), "ann_id", F.explode("level2.events").alias("e")).where("e is not null")
    events = ann.groupBy("clip", F.col("e.event_id").alias("num")).agg(F.max_by("e.instruction", "ann_id").alias("instruction"))
    return ids.where("kind = 'event'").join(events, ["clip", "num"], "left").select("pos", "k", "num", "instruction")


def unique_clips(spark: SparkSession, sf_dir: str):
    return L.unique_rows(table(spark, sf_dir, "annotations").where("clip_key is not null"), ["clip_key"]).select("clip_key", "ann_id")


def screened_clips(spark: SparkSession, sf_dir: str):
    """Clips with their latest screening decision, and those still without one."""
    s = table(spark, sf_dir, "documents").where("source = 'screen_reason' and clip_key is not null").select("clip_key", "doc_id", P.screen_reply(F.col("text"))["decision"].alias("decision")).where("decision is not null")
    s = s.groupBy("clip_key").agg(F.max_by("decision", "doc_id").alias("decision"))
    return table(spark, sf_dir, "annotations").select("ann_id", "clip_key").join(s, "clip_key", "left").select("ann_id", F.coalesce("decision", F.lit("remaining")).alias("decision"))


def column_union(spark: SparkSession, sf_dir: str):
    """Two halves of a table put side by side by row; a column in both must agree."""
    r = table(spark, sf_dir, "records")
    left, right = r.select("pos", "prompt", "problem_type"), r.select("pos", "answer", F.col("problem_type").alias("_pt"))
    both = left.join(right, "pos").where(F.when(F.col("problem_type").eqNullSafe(F.col("_pt")), F.lit(True)).otherwise(F.raise_error(F.lit("column problem_type differs")).cast("boolean")))
    return both.groupBy("problem_type").agg(F.count("prompt").alias("n_prompts"), F.count("answer").alias("n_answers"))


def attempt_groups(spark: SparkSession, sf_dir: str):
    """A group's rewards in order of arrival, the best first place, and the mean after each; groups are one prompt's few attempts."""
    g = _ok(spark, sf_dir).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("row_id", "reward"))).alias("l"))
    rewards = F.transform("l", lambda x: x["reward"])
    best = F.array_position(rewards, F.array_max(rewards))
    half = F.aggregate(F.slice(rewards, 1, F.ceil(F.size("l") / 2).cast("int")), F.lit(0.0), lambda a, x: a + x) / F.ceil(F.size("l") / 2)
    by_reward = F.array_sort(F.transform("l", lambda x: F.struct((-x["reward"]).alias("r"), x["row_id"].alias("id"))))
    return g.select("uid", F.size("l").cast("long").alias("n"), best.alias("best_place"), _nine(half).alias("mean_of_first_half"), F.array_join(F.transform(by_reward, lambda x: x["id"].cast("string")), ",").alias("by_reward"))


def diversity_histogram(spark: SparkSession, sf_dir: str):
    """Groups of each task by their number of different replies, white space and case aside."""
    said = F.lower(P.one_line(F.col("response")))
    g = table(spark, sf_dir, "rollouts").where("uid is not null").groupBy("problem_type", "uid").agg(F.countDistinct(said).alias("n_unique"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("problem_type", "n_unique").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if((F.col("n_unique") == 1) & (F.col("n") > 1)).alias("n_all_same"))


def success_histogram(spark: SparkSession, sf_dir: str):
    g = _ok(spark, sf_dir).groupBy("problem_type", "uid").agg(F.count_if(F.col("reward") >= 0.5).alias("n_success"))
    return g.groupBy("problem_type", "n_success").agg(F.count(F.lit(1)).alias("n_groups"))


def reward_percentiles(spark: SparkSession, sf_dir: str):
    """All deciles of the rewards of each task, exactly, without a sort of a whole task."""
    return L.interpolated(_ok(spark, sf_dir), ["problem_type"], "reward", [0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9]).select("problem_type", "share", _nine(F.col("value")).alias("value"))


def upper_medians(spark: SparkSession, sf_dir: str):
    """The value at place n // 2 of each source's document lengths."""
    d = table(spark, sf_dir, "documents").where("n_chars is not null")
    ranks = d.groupBy("source").agg(F.floor(F.count(F.lit(1)) / 2).alias("rank"))
    return L.values_at_ranks(d, ["source"], "n_chars", ranks).select("source", F.col("value").cast("long").alias("median"))


def asof_last(spark: SparkSession, sf_dir: str):
    """For every step the last validation mean at or before it."""
    ok = _ok(spark, sf_dir)
    val = ok.where("phase = 'val'").groupBy("step").agg(F.avg("reward").alias("v"))
    # One row per step, so the window sees as many rows as there are steps.
    steps = table(spark, sf_dir, "rollouts").select("step").distinct().join(val, "step", "left")
    return steps.select("step", _nine(F.last("v", ignorenulls=True).over(W.orderBy("step").rowsBetween(W.unboundedPreceding, 0))).alias("last_val"))


def dataset_averages(spark: SparkSession, sf_dir: str):
    d = F.coalesce(*[F.when(F.try_variant_get("m", f"$.{n}", "double") > 0, F.try_variant_get("m", f"$.{n}", "double")) for n in ("duration", "clip_duration_sec")])
    rows = _meta(spark, sf_dir).select("problem_type", F.lower(F.trim(F.try_variant_get("m", "$.domain_l1", "string"))).alias("l1"), d.alias("d"), F.size(F.try_variant_get("m", "$.ordered_ids", "array<string>")).alias("ids"))
    return rows.where("problem_type is not null and l1 is not null").groupingSets([["problem_type"], ["l1"], []], "problem_type", "l1").agg(
        F.count(F.lit(1)).alias("n"), _nine(F.avg("d")).alias("mean_duration"), F.sum(F.when(F.col("ids") > 0, F.col("ids")).otherwise(0)).cast("long").alias("n_ids")
    )


def dense_metrics(spark: SparkSession, sf_dir: str):
    """Mean reward of three tasks by step, 0 where a step lacks the task."""
    tasks = ["llava_mcq", "temporal_grounding", "ocr"]
    wide = _ok(spark, sf_dir).groupBy("step").pivot("problem_type", tasks).agg(F.avg("reward"))
    return wide.select("step", *[_nine(F.coalesce(F.col(t), F.lit(0.0))).alias(t) for t in tasks])


def pool_summary(spark: SparkSession, sf_dir: str):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("clip_key").alias("n_clips"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), (F.floor(F.avg("n_chars") * 10 + F.lit(0.5)) / 10).alias("mean_chars"))


def clip_list(spark: SparkSession, sf_dir: str):
    """Per document how many phases, events and actions it has, and neighbouring phases that overlap."""
    n = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0)).cast("long")
    spans = F.array_sort(F.transform(F.filter("level1.macro_phases", lambda x: x.isNotNull() & (x["start_time"] < x["end_time"])), lambda x: F.struct(x["start_time"].alias("s"), x["end_time"].alias("e"))))
    rows = table(spark, sf_dir, "annotations").withColumn("sp", spans)
    clash = F.filter(F.zip_with("sp", F.slice("sp", 2, F.size("sp")), lambda a, b: b["s"] < a["e"]), lambda x: x)
    return rows.select("ann_id", n("level1.macro_phases").alias("n_l1"), n("level2.events").alias("n_l2"), n("level3.grounding_results").alias("n_l3"), F.when(F.col("sp").isNull(), 0).otherwise(F.size(clash)).cast("long").alias("n_overlaps"))


def length_summary(spark: SparkSession, sf_dir: str):
    """Prompt and response lengths per step: mean, least, most, share at the most; and characters per row."""
    r = table(spark, sf_dir, "rollouts").withColumn("pl", F.length("prompt"))
    rows = r.where("step is not null").groupBy("step").agg(
        _nine(F.avg("pl")).alias("mean_prompt"), F.min("pl").cast("long").alias("min_prompt"), F.max("pl").cast("long").alias("max_prompt"), _nine(F.avg("response_length")).alias("mean_response"),
        F.max("response_length").cast("long").alias("max_response"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("pl", F.lit(0)) + F.coalesce("response_length", F.lit(0))).cast("long").alias("total"),
    )
    clipped = r.select("step", "response_length").join(rows.select("step", "max_response"), "step").groupBy("step").agg(F.avg((F.col("response_length") == F.col("max_response")).cast("double")).alias("c"))
    return rows.join(clipped, "step").withColumn("clip_ratio", _nine(F.col("c"))).drop("c")


def nested_exists(spark: SparkSession, sf_dir: str):
    """Clips of 20 to 400 seconds with at least two events of two seconds or more."""
    long_events = F.size(F.filter("level2.events", lambda e: F.coalesce(e["end_time"] - e["start_time"] >= 2, F.lit(False))))
    return table(spark, sf_dir, "annotations").where(F.col("clip_duration_sec").between(20, 400)).select("ann_id", long_events.cast("long").alias("n_long")).where("n_long >= 2")


def nested_predicates(spark: SparkSession, sf_dir: str):
    """Records by predicates on metadata, each of which holds only where the field is given."""
    level, count, topology = F.try_variant_get("m", "$.level", "int"), F.try_variant_get("m", "$.output_count", "int"), F.try_variant_get("m", "$.topology", "string")
    keep = F.coalesce(level.isin(1, 2), F.lit(True)) & F.coalesce(count >= 2, F.lit(True)) & F.coalesce(topology != "flat", F.lit(True))
    return _meta(spark, sf_dir).where("m is not null").where(keep).select("pos", level.alias("level"), count.alias("output_count"))


def overlong(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "rollouts").groupBy("problem_type").agg(F.count_if(F.col("response_length") <= 200).alias("kept"), F.count_if(F.col("response_length") > 200).alias("overlong"))


def iou_range(spark: SparkSession, sf_dir: str):
    """Groups whose mean reward lies within [0.2, 0.8], with the mean on each of their rows; a range as text is read as numbers."""
    ok = _ok(spark, sf_dir).where("problem_type = 'temporal_grounding'")
    low, high = (F.lit(x).try_cast("double") for x in ("0.2", "0.8"))
    means = ok.groupBy("uid").agg(F.avg("reward").alias("m")).where(F.col("m").between(low, high))
    return ok.join(means, "uid").select("row_id", _nine(F.col("m")).alias("mean_reward"))


def order_stages(spark: SparkSession, sf_dir: str):
    """How many phases pass each stage: present, in order distinguishable, confident, with two to eight events."""
    a = table(spark, sf_dir, "annotations").withColumn("ev", F.coalesce("level2.events", F.array()))
    p = a.select("ann_id", "ev", F.explode("level1.macro_phases").alias("p")).where("p is not null")
    kids = F.size(F.filter("ev", lambda e: F.coalesce(e["parent_phase_id"] == F.col("p.phase_id"), F.lit(False))))
    one, two, three = F.coalesce(F.col("p._order_distinguishable"), F.lit(False)), F.coalesce(F.col("p._order_confidence") >= 0.3, F.lit(False)), kids.between(2, 8)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(one).alias("distinguishable"), F.count_if(one & two).alias("confident"), F.count_if(one & two & three).alias("sized"))


def contiguous_ids(spark: SparkSession, sf_dir: str):
    """Whether a record's ordered ids are of one kind and without holes, and whether their order differs from its reverse."""
    ids = F.try_variant_get("m", "$.ordered_ids", "array<string>")
    rows = _meta(spark, sf_dir).select("pos", F.transform(ids, lambda x: P.item_id(x)).alias("l")).where("size(l) > 0")
    nums, kinds = F.transform("l", lambda x: x["parent"]), F.array_distinct(F.transform("l", lambda x: F.coalesce(x["kind"], F.lit("?"))))
    whole = ~F.exists(nums, lambda x: x.isNull()) & (F.array_max(nums) - F.array_min(nums) + 1 == F.size("l")) & (F.size(F.array_distinct(nums)) == F.size("l"))
    return rows.select("pos", (F.size(kinds) == 1).alias("one_kind"), whole.alias("contiguous"), ((F.size("l") >= 2) & (F.to_json(nums) != F.to_json(F.reverse(nums)))).alias("directed"))


def normalised_labels(spark: SparkSession, sf_dir: str):
    """Domains as one of those known, else ``other``; confidence within [0, 1]; short clips lose theirs."""
    known = ["procedural", "physical", "lifestyle", "entertainment", "narrative", "educational"]
    name = F.regexp_replace(F.lower(F.trim("domain_l1")), r"[\s-]+", "_")
    rows = table(spark, sf_dir, "annotations")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("level1.macro_phases")[0]["_order_confidence"], F.lit(0.5))))
    short = F.coalesce(F.col("clip_duration_sec") < 15, F.lit(False))
    return rows.select("ann_id", F.when(short, "other").when(name.isin(known), name).otherwise("other").alias("domain"), _nine(F.when(short, F.least(conf, F.lit(0.3))).otherwise(conf)).alias("confidence"))


def alerts(spark: SparkSession, sf_dir: str):
    """Steps with a verdict and the reasons for it."""
    s = _ok(spark, sf_dir).groupBy("step").agg(F.avg("reward").alias("m"), F.stddev_pop("reward").alias("sd"), F.count(F.lit(1)).alias("n"))
    # One row per step.
    prev = F.lag("m").over(W.orderBy("step"))
    rows = s.withColumn("p", prev)
    reasons = F.concat_ws("; ", F.when(F.col("m") < 0.3, "low mean"), F.when(F.col("sd") > 0.4, "wide spread"), F.when(F.col("m") < F.col("p") - 0.1, "falling"), F.when(F.col("n") < 10, "few rows"))
    return rows.select("step", F.when(reasons == "", "ok").when(reasons.contains(";"), "alert").otherwise("watch").alias("verdict"), reasons.alias("reasons"))


def rounded_dedup(spark: SparkSession, sf_dir: str):
    """Actions once per video, parent, label and times to two decimals, the first row staying."""
    key = [F.col("video_id"), F.lower(F.trim("parent_event_id")).alias("p"), F.col("label"), F.floor(F.col("start_time") * 100 + F.lit(0.5)).alias("s"), F.floor(F.col("end_time") * 100 + F.lit(0.5)).alias("e")]
    return table(spark, sf_dir, "actions").where(_SOUND).groupBy(*key).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n")).select("row_id", "n")


def recovered_rows(spark: SparkSession, sf_dir: str):
    """Prompts of records without any rollout, as stub rows beside the number found for the others."""
    found = table(spark, sf_dir, "rollouts").groupBy("prompt").agg(F.count(F.lit(1)).alias("n"))
    asked = table(spark, sf_dir, "records").select("prompt").where("prompt is not null").distinct()
    return asked.join(found, "prompt", "left").select(F.md5("prompt").alias("h"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "lost").otherwise("found").alias("state"))


def base_and_selected(spark: SparkSession, sf_dir: str):
    """The records of one file and those of another whose content isn't among them."""
    r = table(spark, sf_dir, "records")
    base, more = r.where("data_file = 'data/mixed/train_a.jsonl'").select("pos", "prompt", "answer"), r.where("data_file = 'data/mixed/train_b.jsonl'").select("pos", "prompt", "answer")
    firsts = more.groupBy("prompt", "answer").agg(F.min("pos").alias("pos"))
    here = [firsts.prompt.eqNullSafe(base.prompt), firsts.answer.eqNullSafe(base.answer)]
    return base.select("pos", F.lit("base").alias("origin")).unionByName(firsts.join(base, here, "left_anti").select("pos", F.lit("selected").alias("origin")))


def distinct_options(spark: SparkSession, sf_dir: str):
    """Options of a prompt that differ, case and white space aside."""
    texts = F.transform(F.map_values(P.options(F.col("prompt"))), lambda x: F.lower(P.one_line(x)))
    return table(spark, sf_dir, "records").select("pos", F.size(texts).cast("long").alias("n"), F.size(F.array_distinct(texts)).cast("long").alias("n_distinct")).where("n > 0")


def page_with_total(spark: SparkSession, sf_dir: str):
    r = table(spark, sf_dir, "rollouts").where("phase = 'val'")
    total = r.agg(F.count(F.lit(1)).alias("total"))
    return r.orderBy(F.desc("step"), "row_id").offset(20).limit(20).select("row_id", "step").join(F.broadcast(total))


QUERIES = {
    f.__name__: f
    for f in (
        fallback_lookup, fallback_lookup_content_first, identity_cascade, content_join, held_out, array_anti, parent_child, enriched_documents, setting_alignment, checked_merge, resolved_items, unique_clips,
        screened_clips, column_union, attempt_groups, diversity_histogram, success_histogram, reward_percentiles, upper_medians, asof_last, dataset_averages, dense_metrics, pool_summary, clip_list, length_summary,
        nested_exists, nested_predicates, overlong, iou_range, order_stages, contiguous_ids, normalised_labels, alerts, rounded_dedup, recovered_rows, base_and_selected, distinct_options, page_with_total,
    )
}

_OK = "ok as (select * from rollouts where reward is not null and not isnan(reward) and uid is not null)"
_J = "j as (select *, case when json_valid(metadata) then metadata::json end as m from records)"
_LIVE = "not coalesce(is_deleted, false) and not isnan(start_time) and not isnan(end_time) and start_time >= 0 and start_time < end_time and end_time < 1e6"
_LINE = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))"
_IDS = r"ids as (select pos, lower(trim(m->>'$.clip_key')) as clip, unnest(json_extract_string(m, '$.ordered_ids[*]')) as id, unnest(range(len(json_extract_string(m, '$.ordered_ids[*]')))) as k from j), num as (select *, regexp_matches(id, '(?i)^\s*(phase|event|action)\s+(\d+)(\.\d+)?\s*$') as x, lower(regexp_extract(id, '([A-Za-z]+)', 1)) as kind, try_cast(regexp_extract(id, '(\d+)', 1) as int) as num from ids)"
_MARKS = r"(?m)^\s*\(?([A-H])[.)]\s*(.*?)\s*$"
SQL = {
    "fallback_lookup": """with c as (select prompt, answer, min(pos) as pos from records where prompt is not null and answer is not null group by all having count(*) = 1)
select o.row_id, coalesce(i.pos, c.pos) as found, case when i.pos is not null then 'index' when c.pos is not null then 'content' end as way from rollouts o left join records i on o.row_id = i.pos and o.prompt = i.prompt and o.ground_truth = i.answer left join c on o.prompt = c.prompt and o.ground_truth = c.answer""",
    "fallback_lookup_content_first": """with c as (select prompt, answer, max(pos) as pos from records group by all)
select o.row_id, coalesce(c.pos, i.pos) as found, case when c.pos is not null then 'content' when i.pos is not null then 'index' end as way from rollouts o left join c on o.prompt = c.prompt and o.ground_truth = c.answer left join records i on o.row_id = i.pos""",
    "identity_cascade": f"with {_J}, k as (select pos, case when trim(m->>'$.id') <> '' then 'id' when prompt is not null and answer is not null then 'content' else 'place' end as way, case when trim(m->>'$.id') <> '' then m->>'$.id' when prompt is not null and answer is not null then sha256(prompt || chr(1) || answer) else data_file || ':' || pos end as key from j) select way, key, count(*) as n, min(pos) as first_pos from k group by all",
    "content_join": "select row_id, count(*) as n_records from rollouts o join records r on o.prompt = r.prompt and o.ground_truth = r.answer group by row_id",
    "held_out": "select pos, data_file from records r where data_file like '%train%' and not exists (select 1 from records v where v.data_file like '%/val%' and v.prompt = r.prompt)",
    "array_anti": """with b as (select video_path, min(case when level1._parse_error then 'level1' when level2._parse_error then 'level2' when level3._parse_error then 'level3' end) as why from annotations where level1._parse_error or level2._parse_error or level3._parse_error group by all)
select row_id, (select min(why) from b where list_contains(video_paths, video_path)) as reason from rollouts""",
    "parent_child": f"select p.row_id, count(*) as n, string_agg(e.row_id, ',' order by e.start_time, e.end_time, e.row_id) as children from (select * from phases where {_LIVE}) p join (select * from hier_events where {_LIVE}) e on p.video_id = e.video_id and lower(trim(p.id)) = lower(trim(e.parent_phase_id)) group by p.row_id",
    "enriched_documents": "with a as (select lower(trim(clip_key)) as k, domain_l2, row_number() over (partition by lower(trim(clip_key)) order by domain_l2 is null, annotated_at desc nulls last, ann_id desc) as r, row_number() over (partition by lower(trim(clip_key)) order by annotated_at desc nulls last, ann_id desc) as q from annotations where clip_key is not null) select doc_id, coalesce(a.domain_l2, domain_l1, 'uncategorized') as domain from documents d left join a on lower(trim(d.clip_key)) = a.k and q = 1",
    "setting_alignment": "select video_paths[1] as video, count(*) filter (phase = 'train') as n_train, count(*) filter (phase = 'val') as n_val, n_train > 0 and n_val > 0 as is_complete from rollouts where video_paths[1] is not null group by 1",
    "checked_merge": "select source_video_path, min(clip_key) as clip_key, min(clip_duration_sec) as clip_duration_sec, array_to_string(list_filter([case when count(distinct clip_key) > 1 then 'clip_key' end, case when count(distinct clip_duration_sec) > 1 then 'clip_duration_sec' end], lambda x: x is not null), ',') as conflicts from annotations where source_video_path is not null group by all",
    "resolved_items": f"with {_J}, {_IDS}, e as (select clip, e.event_id as num, arg_max(e.instruction, ann_id) as instruction from (select lower(trim(clip_key)) as clip, ann_id, unnest(level2.events) as e from annotations) a where e is not null group by all) select pos, k, n.num, instruction from num n left join e on n.clip = e.clip and n.num = e.num where x and kind = 'event'",
    "unique_clips": "select clip_key, min(ann_id) as ann_id from annotations where clip_key is not null group by all having count(*) = 1",
    "screened_clips": r"with s as (select clip_key, doc_id, nullif(lower(trim(regexp_extract(coalesce(text, ''), '(?im)^DECISION:[ \t]*([^\n]*)$', 1))), '') as d from documents where source = 'screen_reason' and clip_key is not null), l as (select clip_key, arg_max(d, doc_id) as d from s where d is not null group by all) select ann_id, coalesce(d, 'remaining') as decision from annotations a left join l on a.clip_key = l.clip_key",
    "column_union": "select problem_type, count(prompt) as n_prompts, count(answer) as n_answers from records group by all",
    "attempt_groups": f"""with {_OK}, r as (select *, row_number() over (partition by uid order by row_id) as k, count(*) over (partition by uid) as n from ok), b as (select uid, max(reward) as hi from ok group by uid)
select r.uid, count(*) as n, min(case when reward = hi then k end) as best_place, {r9('avg(case when k <= (n + 1) // 2 then reward end)')} as mean_of_first_half, string_agg(row_id, ',' order by reward desc, row_id) as by_reward from r join b on r.uid = b.uid group by r.uid""",
    "diversity_histogram": f"select problem_type, u as n_unique, count(*) as n_groups, count(*) filter (u = 1 and n > 1) as n_all_same from (select problem_type, uid, count(distinct {_LINE.format('response')}) as u, count(*) as n from rollouts where uid is not null group by all) t group by all",
    "success_histogram": f"with {_OK} select problem_type, s as n_success, count(*) as n_groups from (select problem_type, uid, count(*) filter (reward >= 0.5) as s from ok group by all) t group by all",
    "reward_percentiles": f"with {_OK}, s as (select problem_type, list_sort(list(reward)) as l from ok group by all), q as (select *, unnest([0.1e0, 0.2e0, 0.25e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.75e0, 0.8e0, 0.9e0]) as share from s), p as (select *, share * (len(l) - 1) as a from q) select problem_type, share, {r9('l[cast(floor(a) as bigint) + 1] + (l[cast(ceil(a) as bigint) + 1] - l[cast(floor(a) as bigint) + 1]) * (a - floor(a))')} as value from p",
    "upper_medians": "select source, list_sort(list(n_chars))[count(*) // 2 + 1] as median from documents where n_chars is not null group by all",
    "asof_last": f"with {_OK}, v as (select step, avg(reward) as m from ok where phase = 'val' group by step), s as (select distinct step from rollouts) select s.step, {r9('v.m')} as last_val from s asof left join v on s.step >= v.step",
    "dataset_averages": f"""with {_J}, r as (select problem_type, lower(trim(m->>'$.domain_l1')) as l1, coalesce(case when try_cast(m->>'$.duration' as double) > 0 then try_cast(m->>'$.duration' as double) end, case when try_cast(m->>'$.clip_duration_sec' as double) > 0 then try_cast(m->>'$.clip_duration_sec' as double) end) as d, coalesce(json_array_length(m, '$.ordered_ids'), 0) as ids from j)
select problem_type, l1, count(*) as n, {r9('avg(d)')} as mean_duration, cast(sum(ids) as bigint) as n_ids from r where problem_type is not null and l1 is not null group by grouping sets ((problem_type), (l1), ())""",
    "dense_metrics": f"with {_OK} select step, {r9('''coalesce(avg(reward) filter (problem_type = 'llava_mcq'), 0)''')} as llava_mcq, {r9('''coalesce(avg(reward) filter (problem_type = 'temporal_grounding'), 0)''')} as temporal_grounding, {r9('''coalesce(avg(reward) filter (problem_type = 'ocr'), 0)''')} as ocr from ok group by step",
    "pool_summary": "select source, count(*) as n, count(distinct clip_key) as n_clips, min(n_chars) as least, max(n_chars) as most, floor(avg(n_chars) * 10 + 0.5) / 10 as mean_chars from documents group by all",
    "clip_list": """with p as (select ann_id, x.start_time as s, x.end_time as e from (select ann_id, unnest(level1.macro_phases) as x from annotations) a where x.start_time < x.end_time), o as (select ann_id, count(*) filter (s < pe) as c from (select *, lag(e) over (partition by ann_id order by s, e) as pe from p) t group by all)
select a.ann_id, coalesce(len(list_filter(level1.macro_phases, lambda x: x is not null)), 0) as n_l1, coalesce(len(list_filter(level2.events, lambda x: x is not null)), 0) as n_l2, coalesce(len(list_filter(level3.grounding_results, lambda x: x is not null)), 0) as n_l3, coalesce(c, 0) as n_overlaps from annotations a left join o using (ann_id)""",
    "length_summary": f"""with r as (select step, length(prompt) as pl, response_length as rl, max(response_length) over (partition by step) as hi from rollouts where step is not null)
select step, {r9('avg(pl)')} as mean_prompt, min(pl) as min_prompt, max(pl) as max_prompt, {r9('avg(rl)')} as mean_response, max(rl) as max_response, count(*) as n, cast(sum(coalesce(pl, 0) + coalesce(rl, 0)) as bigint) as total, {r9('avg(cast(rl = hi as int))')} as clip_ratio from r group by step""",
    "nested_exists": "select ann_id, n_long from (select ann_id, len(list_filter(level2.events, lambda e: e.end_time - e.start_time >= 2)) as n_long from annotations where clip_duration_sec between 20 and 400) t where n_long >= 2",
    "nested_predicates": f"with {_J}, v as (select pos, try_cast(m->>'$.level' as int) as level, try_cast(m->>'$.output_count' as int) as output_count, m->>'$.topology' as t from j where m is not null) select pos, level, output_count from v where coalesce(level in (1, 2), true) and coalesce(output_count >= 2, true) and coalesce(t <> 'flat', true)",
    "overlong": "select problem_type, count(*) filter (response_length <= 200) as kept, count(*) filter (response_length > 200) as overlong from rollouts group by all",
    "iou_range": f"with {_OK}, m as (select uid, avg(reward) as m from ok where problem_type = 'temporal_grounding' group by uid having avg(reward) between 0.2e0 and 0.8e0) select row_id, {r9('m.m')} as mean_reward from ok join m on ok.uid = m.uid where problem_type = 'temporal_grounding'",
    "order_stages": """with p as (select ann_id, level2.events as ev, unnest(level1.macro_phases) as p from annotations), q as (select coalesce(p._order_distinguishable, false) as a, coalesce(p._order_confidence >= 0.3, false) as b, coalesce(len(list_filter(ev, lambda e: e.parent_phase_id = p.phase_id)), 0) between 2 and 8 as c from p where p is not null)
select count(*) as n, count(*) filter (a) as distinguishable, count(*) filter (a and b) as confident, count(*) filter (a and b and c) as sized from q""",
    "contiguous_ids": f"with {_J}, {_IDS}, v as (select pos, k, case when x then kind else '?' end as kind, case when x then num end as num from num) select pos, count(distinct kind) = 1 as one_kind, count(num) = count(*) and max(num) - min(num) + 1 = count(*) and count(distinct num) = count(*) as contiguous, count(*) >= 2 and list(num order by k) is distinct from list(num order by k desc) as directed from v group by pos",
    "normalised_labels": rf"""with a as (select ann_id, regexp_replace(lower(trim(domain_l1)), '[\s-]+', '_', 'g') as d, greatest(0e0, least(1e0, coalesce(level1.macro_phases[1]._order_confidence, 0.5))) as c, coalesce(clip_duration_sec < 15, false) as s from annotations)
select ann_id, case when s then 'other' when d in ('procedural', 'physical', 'lifestyle', 'entertainment', 'narrative', 'educational') then d else 'other' end as domain, {r9('case when s then least(c, 0.3e0) else c end')} as confidence from a""",
    "alerts": f"""with {_OK}, s as (select step, avg(reward) as m, stddev_pop(reward) as sd, count(*) as n from ok group by step), p as (select *, lag(m) over (order by step) as p from s), r as (select step, array_to_string(list_filter([case when m < 0.3 then 'low mean' end, case when sd > 0.4 then 'wide spread' end, case when m < p - 0.1 then 'falling' end, case when n < 10 then 'few rows' end], lambda x: x is not null), '; ') as reasons from p)
select step, case when reasons = '' then 'ok' when contains(reasons, ';') then 'alert' else 'watch' end as verdict, reasons from r""",
    "rounded_dedup": f"select min(row_id) as row_id, count(*) as n from actions where {_LIVE} group by video_id, lower(trim(parent_event_id)), label, floor(start_time * 100 + 0.5), floor(end_time * 100 + 0.5)",
    "recovered_rows": "select md5(prompt) as h, (select count(*) from rollouts o where o.prompt = r.prompt) as n, case when (select count(*) from rollouts o where o.prompt = r.prompt) = 0 then 'lost' else 'found' end as state from (select distinct prompt from records where prompt is not null) r",
    "base_and_selected": """with b as (select pos, prompt, answer from records where data_file = 'data/mixed/train_a.jsonl'), s as (select prompt, answer, min(pos) as pos from records where data_file = 'data/mixed/train_b.jsonl' group by all)
select pos, 'base' as origin from b union all select pos, 'selected' from s where not exists (select 1 from b where b.prompt is not distinct from s.prompt and b.answer is not distinct from s.answer)""",
    "distinct_options": rf"""with o as (select pos, unnest(regexp_extract_all(coalesce(prompt, ''), '{_MARKS}', 1)) as k, unnest(regexp_extract_all(coalesce(prompt, ''), '{_MARKS}', 2)) as v, unnest(range(len(regexp_extract_all(coalesce(prompt, ''), '{_MARKS}', 1)))) as i from records), l as (select pos, k, arg_max(v, i) as v from o group by all) select pos, count(*) as n, count(distinct {_LINE.format('v')}) as n_distinct from l group by pos""",
    "page_with_total": "select row_id, step, (select count(*) from rollouts where phase = 'val') as total from rollouts where phase = 'val' order by step desc, row_id limit 20 offset 20",
}
