"""Queries of the parsing functions over whole tables, with oracles written on their own."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cinderloom.functions import parsing as P
from cinderloom.plans.catalog import pair_sql
from cinderloom.plans.rewards import time_pair
from cinderloom.sources.tables import table


def parse_segments(spark: SparkSession, sf_dir: str):
    """Valid segments of the first <events> block of every response."""
    rows = table(spark, sf_dir, "rollouts").select("row_id", F.explode(P.segments(F.col("response"))).alias("p"))
    return rows.select("row_id", "p.k", "p.s", "p.e")


def parse_anywhere(spark: SparkSession, sf_dir: str):
    """Valid segments anywhere in a ground truth or prompt-side text of a rollout, within the truth's longest time where known."""
    longest = F.col("temporal_segments.max_t")
    rows = table(spark, sf_dir, "rollouts").select("row_id", F.explode(P.segments(F.col("response"), False, longest)).alias("p"))
    return rows.select("row_id", "p.k", "p.s", "p.e")


def time_pairs(spark: SparkSession, sf_dir: str):
    """The single time pair of every grounding rollout's response and truth, by the cascade of wordings."""
    rows = table(spark, sf_dir, "rollouts").where("problem_type = 'temporal_grounding'")
    pair = rows.select("row_id", time_pair(P.given(F.col("response"))).alias("p"), time_pair(P.given(F.col("ground_truth"))).alias("g"))
    return pair.select("row_id", "p.s", "p.e", F.col("g.s").alias("gs"), F.col("g.e").alias("ge"))


def hacked_replies(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "rollouts").groupBy("problem_type", P.is_hacked(F.col("response")).alias("hacked"), P.has_events(F.col("response")).alias("has_events")).agg(F.count(F.lit(1)).alias("n"))


def screen_replies(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "documents").where("source = 'screen_reason'")
    return rows.select("doc_id", P.screen_reply(F.col("text")).alias("r")).select("doc_id", "r.*")


def embedded_objects(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "documents").select("doc_id", P.embedded_json(F.col("text")).alias("found")).where("found is not null")
    return rows.select("doc_id", F.length("found").cast("long").alias("n_chars"))


def clip_names(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "documents").where("clip_key is not null")
    return rows.select("doc_id", P.clip_parts(F.col("clip_key")).alias("c")).select("doc_id", "c.*")


def seconds_texts(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "actions").where("not isnan(start_time) and abs(start_time) < 1e9")
    return rows.select("row_id", P.seconds_text(F.floor(F.col("start_time") * 100 + F.lit(0.5)) / 100).alias("text"), P.clock_text(F.col("start_time")).alias("clock"))


def step_names(spark: SparkSession, sf_dir: str):
    """Step folders written and read back, and the clip a rollout's video names."""
    rows = table(spark, sf_dir, "rollouts").withColumn("name", F.concat(F.lit("step_"), F.lpad(F.col("step").cast("string"), 6, "0")))
    return rows.select("row_id", "name", F.regexp_extract("name", r"step_0*([0-9]+)$", 1).cast("int").alias("step"), P.stem(F.col("video_paths")[0]).alias("clip"))


def clean_lines(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "documents").select("doc_id", P.one_line(F.col("text")).alias("line"))
    return rows.select("doc_id", F.substring(F.md5("line"), 1, 12).alias("h"), F.length("line").cast("long").alias("n"), F.substring("line", 1, 180).alias("preview"))


def missing_steps(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "records").where("problem_type = 'event_logic_fill_blank'")
    return rows.select("pos", P.missing_step(F.col("prompt")).alias("place"), F.size(P.steps_of(F.col("prompt"))).cast("long").alias("n_steps"))


def option_maps(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "records").select("pos", F.explode(P.options(F.col("prompt"))).alias("letter", "option"))
    return rows


def swapped_prompts(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "records").where("problem_type = 'seg_aot_event_dir_binary'")
    swapped = P.options(P.swapped_options(F.col("prompt")))
    return rows.select("pos", swapped["A"].alias("a"), swapped["B"].alias("b"), F.when(F.col("answer") == "A", "B").when(F.col("answer") == "B", "A").otherwise(F.col("answer")).alias("answer"))


def item_ids(spark: SparkSession, sf_dir: str):
    """Ids of the ordered items of records, resolved to kind and numbers."""
    ids = F.try_variant_get(F.try_parse_json("metadata"), "$.ordered_ids", "array<string>")
    rows = table(spark, sf_dir, "records").select("pos", F.posexplode(ids).alias("k", "id"))
    return rows.select("pos", F.col("k").cast("long").alias("k"), P.item_id(F.col("id")).alias("i")).select("pos", "k", "i.*")


def numbered_lists(spark: SparkSession, sf_dir: str):
    names = F.transform("level1.macro_phases", lambda p: p["phase_name"])
    rows = table(spark, sf_dir, "annotations").where("level1.macro_phases is not null")
    return rows.select("ann_id", P.numbered_list(F.filter(names, lambda n: n.isNotNull())).alias("list"))


def thoughts_split(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "rollouts").select("row_id", P.thought_and_rest(F.col("response")).alias("t"))
    return rows.select("row_id", F.length("t.thought").cast("long").alias("n_thought"), F.length("t.rest").cast("long").alias("n_rest"))


def prompt_parts(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "records").select("pos", F.posexplode(P.content_parts(F.col("prompt"))).alias("k", "p"))
    return rows.select("pos", F.col("k").cast("long").alias("k"), "p.type", "p.text")


def prompt_rewrites(spark: SparkSession, sf_dir: str):
    """Prompts without their closing instruction and media mark, with the one instruction of their type instead."""
    closing = r"(?i)\n\s*(?:please (?:provide|answer)|answer with|think first|keep the answer|give the|reason between|reply with|return )[^\n]*\s*$"
    bare = F.regexp_replace(F.regexp_replace(P.given(F.col("prompt")), closing, ""), r"<video>\s*", "")
    told = F.when(F.col("problem_type") == "llava_mcq", "\nAnswer with the letter only.").otherwise("")
    return table(spark, sf_dir, "records").select("pos", F.md5(F.concat(bare, told)).alias("h"))


def whole_clips(spark: SparkSession, sf_dir: str):
    """Names of the clips cut from each annotated video, by template."""
    rows = table(spark, sf_dir, "phases").where("not coalesce(is_deleted, false) and start_time >= 0 and start_time < end_time and end_time < 1e9")
    return rows.select("row_id", F.format_string("%s_L2_%s_%d_%d.mp4", "video_id", F.lower(F.trim("id")), F.floor("start_time").cast("long"), F.ceil("end_time").cast("long")).alias("name"))


_SEG = r"\[\s*([0-9]*\.?[0-9]+)\s*,\s*([0-9]*\.?[0-9]+)\s*\]"


def _segments_sql(block: str, extra: str = "true", cols: str = "") -> str:
    return f"""with b as (select row_id, {block} as b{cols} from rollouts),
z as (select *, unnest(regexp_extract_all(b, '{_SEG}', 1)) as x, unnest(regexp_extract_all(b, '{_SEG}', 2)) as y, unnest(range(1, len(regexp_extract_all(b, '{_SEG}', 1)) + 1)) as k from b)
select row_id, cast(k as int) as k, cast(x as double) as s, cast(y as double) as e from z where cast(x as double) < cast(y as double) and {extra}"""


_R, _G = "coalesce(response, '')", "coalesce(ground_truth, '')"
_VALUE = r"trim(regexp_extract(coalesce(text, ''), '(?im)^{}:[ \t]*([^\n]*)$', 1))"
_SCORE = "least(5, cast(nullif(regexp_extract({}, '^([0-9]{{1,4}})', 1), '') as int))"
_DOMAINS = "('procedural', 'physical', 'lifestyle', 'entertainment', 'narrative', 'educational', 'other')"
_COUNT = "len(regexp_extract_all(coalesce(response, ''), '{}')) > 1"
_HACK = "(" + " or ".join(_COUNT.format(t) for t in ("<answer>", "</answer>", "<events>", "</events>")) + r" or regexp_matches(coalesce(response, ''), '\[[0-9]+-[0-9]+\]'))"
_STEPS = r"list_transform(string_split(regexp_extract(coalesce(prompt, ''), ':\s*([^\n?]*)\.', 1), ';'), lambda x: trim(x))"
_MARKS = r"(?m)^\s*\(?([A-H])[.)]\s*(.*?)\s*$"
_OPTIONS = rf"""o as (select pos, k, v from (select pos, k, v, row_number() over (partition by pos, k order by i desc) as r from
(select pos, unnest(regexp_extract_all(p, '{_MARKS}', 1)) as k, unnest(regexp_extract_all(p, '{_MARKS}', 2)) as v, unnest(range(len(regexp_extract_all(p, '{_MARKS}', 1)))) as i from q) a) b where r = 1)"""
_CLIP = r"^(.+)[_-](\d+(?:\.\d+)?)[_-](\d+(?:\.\d+)?)$"
_CLOSING = r"(?i)\n\s*(?:please (?:provide|answer)|answer with|think first|keep the answer|give the|reason between|reply with|return )[^\n]*\s*$"

QUERIES = {
    f.__name__: f
    for f in (
        parse_segments, parse_anywhere, time_pairs, hacked_replies, screen_replies, embedded_objects, clip_names, seconds_texts, step_names, clean_lines,
        missing_steps, option_maps, swapped_prompts, item_ids, numbered_lists, thoughts_split, prompt_parts, prompt_rewrites, whole_clips,
    )
}
SQL = {
    "parse_segments": _segments_sql(f"regexp_extract({_R}, '(?s)<events>(.*?)</events>', 1)"),
    "parse_anywhere": _segments_sql(_R, "coalesce(cast(y as double) <= m + 1e-6, true)", ", temporal_segments.max_t as m"),
    "time_pairs": f"select row_id, {pair_sql(_R, 1)} as s, {pair_sql(_R, 2)} as e, {pair_sql(_G, 1)} as gs, {pair_sql(_G, 2)} as ge from rollouts where problem_type = 'temporal_grounding'",
    "hacked_replies": f"select problem_type, {_HACK} as hacked, regexp_matches({_R}, '(?s)<events>.*?</events>') as has_events, count(*) as n from rollouts group by all",
    "screen_replies": f"""select doc_id, {_SCORE.format(_VALUE.format('L1_SCORE'))} as l1_score, {_SCORE.format(_VALUE.format('L2_SCORE'))} as l2_score, nullif(lower({_VALUE.format('DOMAIN_L1')}), '') as domain,
coalesce(lower({_VALUE.format('DOMAIN_L1')}) in {_DOMAINS}, false) as known_domain, nullif(lower({_VALUE.format('DECISION')}), '') as decision from documents where source = 'screen_reason'""",
    "embedded_objects": r"""select doc_id, cast(length(f) as bigint) as n_chars from (select doc_id, coalesce(nullif(regexp_extract(coalesce(text, ''), '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1), ''), nullif(regexp_extract(coalesce(text, ''), '(\{(?:[^{}\n]|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*\})', 1), '')) as f from documents) t
where f is not null and json_valid(f)""",
    "clip_names": f"""select doc_id, case when m then regexp_extract(k, '{_CLIP}', 1) end as video, case when m then cast(regexp_extract(k, '{_CLIP}', 2) as double) end as start_sec,
case when m then cast(regexp_extract(k, '{_CLIP}', 3) as double) end as end_sec from (select doc_id, lower(trim(clip_key)) as k, regexp_matches(lower(trim(clip_key)), '{_CLIP}') as m from documents where clip_key is not null) t""",
    "seconds_texts": r"""select row_id, regexp_replace(printf('%.2f', floor(start_time * 100 + 0.5) / 100), '\.?0+$', '') as text, printf('%02d:%02d', cast(floor(greatest(start_time, 0)) as bigint) // 60, cast(floor(greatest(start_time, 0)) as bigint) % 60) as clock
from actions where not isnan(start_time) and abs(start_time) < 1e9""",
    "step_names": r"select row_id, printf('step_%06d', step) as name, step, regexp_replace(regexp_extract(video_paths[1], '([^/]*)$', 1), '\.[^.]*$', '') as clip from rollouts",
    "clean_lines": r"select doc_id, left(md5(l), 12) as h, cast(length(l) as bigint) as n, left(l, 180) as preview from (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as l from documents) t",
    "missing_steps": rf"select pos, nullif(cast(coalesce(list_position(list_transform({_STEPS}, lambda x: regexp_matches(x, '^(?:_{{2,}}|\[MISSING\])$')), true), 0) as bigint), 0) as place, cast(len({_STEPS}) as bigint) as n_steps from records where problem_type = 'event_logic_fill_blank'",
    "option_maps": f"with q as (select pos, coalesce(prompt, '') as p from records), {_OPTIONS} select pos, k as letter, v as option from o",
    "swapped_prompts": f"""with q as (select pos, coalesce(prompt, '') as p, answer from records where problem_type = 'seg_aot_event_dir_binary'), {_OPTIONS}
select q.pos, max(case when k = 'B' then v end) as a, max(case when k = 'A' then v end) as b, case when answer = 'A' then 'B' when answer = 'B' then 'A' else answer end as answer from q left join o on q.pos = o.pos group by q.pos, answer""",
    "item_ids": r"""with j as (select pos, metadata::json as m from records where json_valid(metadata)), i as (select pos, unnest(json_extract_string(m, '$.ordered_ids[*]')) as id, unnest(range(len(json_extract_string(m, '$.ordered_ids[*]')))) as k from j)
select pos, k, case when x then lower(regexp_extract(id, '(?i)^\s*(phase|event|action)', 1)) end as kind, case when x then cast(regexp_extract(id, '(\d+)', 1) as int) end as parent, case when x then cast(nullif(regexp_extract(id, '\d+\.(\d+)', 1), '') as int) end as child
from (select *, regexp_matches(id, '(?i)^\s*(phase|event|action)\s+(\d+)(?:\.(\d+))?\s*$') as x from i) t""",
    "numbered_lists": """with p as (select ann_id, list_filter(list_transform(level1.macro_phases, lambda p: trim(p.phase_name)), lambda n: n is not null and n <> '') as l from annotations where level1.macro_phases is not null)
select ann_id, array_to_string(list_transform(l, lambda x, i: concat(i, '. ', x)), chr(10)) as list from p""",
    "thoughts_split": r"""select row_id, case when x then length(regexp_replace(regexp_extract(t, '(?s)<think>(.*?)</think>(.*)', 1), '^\s+|\s+$', '', 'g')) end as n_thought, length(regexp_replace(case when x then regexp_extract(t, '(?s)<think>(.*?)</think>(.*)', 2) else t end, '^\s+|\s+$', '', 'g')) as n_rest
from (select row_id, coalesce(response, '') as t, regexp_matches(coalesce(response, ''), '(?s)<think>(.*?)</think>(.*)') as x from rollouts) a""",
    "prompt_parts": r"""with s as (select pos, unnest(string_split(replace(replace(p, '<video>', chr(1) || 'video' || chr(2)), '<image>', chr(1) || 'image' || chr(2)), chr(1))) as piece, unnest(range(len(string_split(replace(replace(p, '<video>', chr(1)), '<image>', chr(1)), chr(1))))) as i from (select pos, coalesce(prompt, '') as p from records) a),
u as (select pos, i, 0 as h, string_split(piece, chr(2))[1] as type, null as text from s where contains(piece, chr(2)) union all select pos, i, 1, 'text', trim(string_split(piece, chr(2))[-1]) from s)
select pos, cast(row_number() over (partition by pos order by i, h) - 1 as bigint) as k, type, text from u where text is null or text <> ''""",
    "prompt_rewrites": rf"select pos, md5(regexp_replace(regexp_replace(coalesce(prompt, ''), '{_CLOSING}', ''), '<video>\s*', '', 'g') || case when problem_type = 'llava_mcq' then chr(10) || 'Answer with the letter only.' else '' end) as h from records",
    "whole_clips": "select row_id, printf('%s_L2_%s_%d_%d.mp4', video_id, lower(trim(id)), cast(floor(start_time) as bigint), cast(ceil(end_time) as bigint)) as name from phases where not coalesce(is_deleted, false) and start_time >= 0 and start_time < end_time and end_time < 1e9",
}
