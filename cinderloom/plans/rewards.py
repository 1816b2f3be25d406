"""Answers parsed from whole responses and the rewards they earn; every rollout of the task has its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.plans.catalog import pair_sql, r9
from cinderloom.sources.tables import table

#: Task types scored by an option's letter, beside all those that begin with ``seg_aot_``.
CHOICE_TYPES = ["llava_mcq", "event_logic_predict_next", "event_logic_fill_blank"]


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null if it is empty or missing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _last_answer(text: Column) -> Column:
    return _last(text, r"(?iU)<answer>\s*([\s\S]*?)\s*</answer>")


def choice_letters(rollouts: DataFrame) -> DataFrame:
    """``row_id, problem_type, letter, mcq_letter, has_tag, is_match`` of all choice rollouts.

    ``letter`` is the last standalone letter of the last <answer>, else of the whole text. ``mcq_letter``
    goes by the screening order: a letter alone in a tag, "answer is X", a leading letter, the only A-E.
    A null response has no letter and no match.
    """
    standalone = r"(?iU)\b([A-Z])\b"
    only = F.regexp_extract_all("_text", F.lit(r"(?U)\b([A-E])\b"), F.lit(1))
    rows = rollouts.where(F.col("problem_type").isin(CHOICE_TYPES) | F.col("problem_type").startswith("seg_aot_"))
    rows = rows.select("row_id", "problem_type", _given("response").alias("_text"), _given("ground_truth").alias("_truth"))
    rows = rows.withColumn("_tag", _last_answer(F.col("_text")))
    return rows.select(
        "row_id",
        "problem_type",
        F.upper(F.coalesce(_last(F.col("_tag"), standalone), _last(F.col("_text"), standalone))).alias("letter"),
        F.upper(
            F.coalesce(
                _first(F.col("_text"), r"(?iU)<answer>\s*([A-Za-z])\s*</answer>"),
                _first(F.col("_text"), r"(?iU)(?:answer|option)\s+(?:is|:)\s*([A-Za-z])"),
                _first(F.col("_text"), r"(?U)^\s*([A-Za-z])[\s.):]"),
                F.when(F.size(only) == 1, only[0]),
            )
        ).alias("mcq_letter"),
        F.col("_tag").isNotNull().cast("int").alias("has_tag"),
        F.upper(F.regexp_replace("_truth", r"(?U)^\s+|\s+$", "")).alias("_truth"),
    ).select("row_id", "problem_type", "letter", "mcq_letter", "has_tag", F.coalesce((F.col("letter") == F.col("_truth")).cast("int"), F.lit(0)).alias("is_match"))


def choice_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice_letters(table(spark, sf_dir, "rollouts"))


_NUMBER = r"([0-9]*\.?[0-9]+)"
#: The wordings of a time pair outside tags, in the order they are tried.
_RANGES = [
    rf"(?isU)The\s+event(?:\s+['\"“].*?['\"”])?\s+happens\s+in\s+(?:the\s+)?{_NUMBER}\s*-\s*{_NUMBER}\s*seconds?",
    rf"(?iU){_NUMBER}\s*-\s*{_NUMBER}\s*seconds?",
    r"(?iU)([0-9]+\.?[0-9]*)\s+(?:to|and)\s+([0-9]+\.?[0-9]*)",
]


def _pair(text: Column, pattern: str) -> Column:
    """Start and end of the pattern's first match; null unless 0 <= start < end."""
    start, end = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))
    return F.when((start >= 0) & (start < end), F.struct(start.alias("s"), end.alias("e")))


def time_pair(text: Column) -> Column:
    """A single time pair as ``struct<s, e>``: free wordings in the whole text, then in the first
    <answer>, then the first segment of <events>; an invalid pair lets the next be tried."""
    answer = F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1)
    events = F.regexp_extract(text, r"(?s)<events>(.*?)</events>", 1)
    tried = [_pair(t, p) for t in (text, answer) for p in _RANGES]
    return F.coalesce(*tried, _pair(events, rf"(?U)\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\]"))


def grounding_scores(rollouts: DataFrame, durations: DataFrame) -> DataFrame:
    """``row_id, s, e, gs, ge, iou, penalty, reward`` of all temporal_grounding rollouts.

    ``reward`` is the IoU times the end points' distance penalty over ``durations(problem_id,
    duration)``; 1 without a positive duration. No valid pair on either side, repeated tags or a ``[1-2]`` give 0.
    """
    rows = rollouts.where("problem_type = 'temporal_grounding'")
    rows = rows.select("row_id", "problem_id", _given("response").alias("_text"), _given("ground_truth").alias("_truth"))
    tags = [F.regexp_count("_text", F.lit(tag)) > 1 for tag in ("<answer>", "</answer>", "<events>", "</events>")]
    hacked = tags[0] | tags[1] | tags[2] | tags[3] | F.col("_text").rlike(r"\[[0-9]+-[0-9]+\]")
    rows = rows.select("row_id", "problem_id", hacked.alias("_hacked"), time_pair(F.col("_text")).alias("_p"), time_pair(F.col("_truth")).alias("_g"))
    rows = rows.select("row_id", "problem_id", "_hacked", "_p.s", "_p.e", F.col("_g.s").alias("gs"), F.col("_g.e").alias("ge")).join(durations, "problem_id", "left")
    iou = "case when s is null or gs is null then 0e0 else greatest(0e0, least(e, ge) - greatest(s, gs)) / (greatest(e, ge) - least(s, gs)) end"
    rows = rows.withColumn("iou", F.expr(iou)).withColumn(
        "penalty", F.expr("case when duration > 0 and s is not null and gs is not null then greatest(0e0, (1e0 - abs(gs - s) / duration) * (1e0 - abs(ge - e) / duration)) else 1e0 end")
    )
    reward = F.expr(f"case when _hacked then 0e0 else {r9('iou * penalty')} end")
    return rows.select("row_id", "s", "e", "gs", "ge", F.expr(r9("iou")).alias("iou"), F.expr(r9("penalty")).alias("penalty"), reward.alias("reward"))


def grounding_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations are metadata.duration of the grounding records with the rollout's problem_id; the longest if they differ."""
    meta = table(spark, sf_dir, "records").where("problem_type = 'temporal_grounding'").select(F.try_parse_json("metadata").alias("m"))
    durations = meta.select(F.try_variant_get("m", "$.id", "string").alias("problem_id"), F.try_variant_get("m", "$.duration", "double").alias("duration"))
    durations = durations.where("problem_id is not null and duration > 0").groupBy("problem_id").agg(F.max("duration").alias("duration"))
    return grounding_scores(table(spark, sf_dir, "rollouts"), durations)


def sort_scores(rollouts: DataFrame) -> DataFrame:
    """``row_id, n, n_right, reward`` of all sorting rollouts, ``reward`` being the jigsaw displacement.

    Digits of the last <answer> are cut or filled up with the missing elements to the truth's length;
    an unknown element costs n - 1. Less than two digits on either side give 0.
    """
    rows = rollouts.where("problem_type in ('event_logic_sort', 'sort')")
    rows = rows.select("row_id", *[F.regexp_extract_all(t, F.lit("[0-9]"), F.lit(0)).alias(n) for t, n in ((_given("ground_truth"), "g"), (F.coalesce(_last_answer(_given("response")), F.lit("")), "_p"))])
    missing = "filter(g, x -> not array_contains(_p, x))"
    rows = rows.withColumn("n", F.size("g").cast("long")).withColumn("p", F.expr(f"slice(concat(_p, slice({missing}, 1, greatest(size(g) - size(_p), 0))), 1, size(g))"))
    # A repeated element of the truth counts at its last place.
    cost = "aggregate(transform(p, (x, i) -> case when array_contains(g, x) then abs(i - (size(g) - array_position(reverse(g), x))) else cast(size(g) - 1 as bigint) end), 0L, (a, x) -> a + x)"
    reward = f"case when size(g) < 2 or size(_p) < 2 then 0e0 when p = g then 1e0 else greatest(0e0, 1e0 - {cost} / floor(size(g) * size(g) / 2)) end"
    right = "case when size(_p) < 2 then 0L else cast(size(filter(zip_with(p, g, (x, y) -> x = y), z -> z)) as bigint) end"
    return rows.select("row_id", "n", F.expr(right).alias("n_right"), F.expr(r9(reward)).alias("reward"))


def jigsaw_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_scores(table(spark, sf_dir, "rollouts"))


QUERIES = {f.__name__: f for f in (choice_answers, grounding_reward, jigsaw_displacement)}

_W = r"[^\p{L}\p{M}\p{N}_]"
_ALONE = rf"(?s)^(?:.*{_W})?([A-Za-z])(?:{_W}.*)?$"
_TAG = r"nullif(regexp_extract({t}, '(?is)^.*<answer>\s*(.*?)\s*</answer>', 1), '')"
_HAS = r"regexp_matches({t}, '(?is)<answer>\s*(.*?)\s*</answer>')"
_FIRST = "nullif(regexp_extract(t, '{}', 1), '')"
_PAIRS = {(side, k): pair_sql(f"coalesce({side}, '')", k) for side in ("response", "ground_truth") for k in (1, 2)}
_TWICE = " or ".join(f"len(regexp_extract_all(coalesce(response, ''), '{tag}')) > 1" for tag in ("<answer>", "</answer>", "<events>", "</events>"))
SQL = {
    "choice_answers": rf"""with r as (select row_id, problem_type, coalesce(response, '') as t, upper(regexp_replace(coalesce(ground_truth, ''), '^\s+|\s+$', '', 'g')) as g from rollouts where problem_type in ('llava_mcq', 'event_logic_predict_next', 'event_logic_fill_blank') or starts_with(problem_type, 'seg_aot_')),
l as (select *, case when {_HAS.format(t="t")} then 1 else 0 end as has_tag, {_TAG.format(t="t")} as tag, regexp_extract_all(' ' || regexp_replace(t, '{_W}+', '  ', 'g') || ' ', ' ([A-E]) ', 1) as lone from r),
f as (select *, upper(coalesce(nullif(regexp_extract(tag, '{_ALONE}', 1), ''), nullif(regexp_extract(t, '{_ALONE}', 1), ''))) as letter,
upper(coalesce({_FIRST.format(r"(?i)<answer>\s*([A-Za-z])\s*</answer>")}, {_FIRST.format(r"(?i)(?:answer|option)\s+(?:is|:)\s*([A-Za-z])")}, {_FIRST.format(r"^\s*([A-Za-z])[\s.):]")}, case when len(lone) = 1 then lone[1] end)) as mcq_letter from l)
select row_id, problem_type, letter, mcq_letter, has_tag, coalesce(cast(letter = g as int), 0) as is_match from f""",
    "jigsaw_displacement": rf"""with r as (select row_id, regexp_extract_all(coalesce(ground_truth, ''), '[0-9]') as g, regexp_extract_all(coalesce({_TAG.format(t="coalesce(response, '')")}, ''), '[0-9]') as q from rollouts where problem_type in ('event_logic_sort', 'sort')),
f as (select *, list_slice(list_concat(q, list_slice(list_filter(g, lambda x: not list_contains(q, x)), 1, greatest(len(g) - len(q), 0))), 1, len(g)) as p from r),
c as (select *, list_sum(list_transform(p, lambda x, i: case when list_contains(g, x) then abs(i - (len(g) + 1 - list_position(list_reverse(g), x))) else len(g) - 1 end)) as cost, len(list_filter(p, lambda x, i: g[i] = x)) as same from f)
select row_id, len(g) as n, case when len(q) < 2 then 0 else same end as n_right, {r9("case when len(g) < 2 or len(q) < 2 then 0e0 when p = g then 1e0 else greatest(0e0, 1e0 - cost / floor(len(g) * len(g) / 2e0)) end")} as reward from c""",
    "grounding_reward": rf"""with d as (select m->>'$.id' as problem_id, max(try_cast(m->>'$.duration' as double)) as duration from (select metadata::json as m from records where problem_type = 'temporal_grounding' and json_valid(metadata)) a where m->>'$.id' is not null and try_cast(m->>'$.duration' as double) > 0 group by 1),
r as (select row_id, problem_id, {_PAIRS["response", 1]} as s, {_PAIRS["response", 2]} as e, {_PAIRS["ground_truth", 1]} as gs, {_PAIRS["ground_truth", 2]} as ge, ({_TWICE}) or regexp_matches(coalesce(response, ''), '\[[0-9]+-[0-9]+\]') as hack from rollouts where problem_type = 'temporal_grounding'),
i as (select row_id, s, e, gs, ge, hack, case when s is null or gs is null then 0e0 else greatest(0e0, least(e, ge) - greatest(s, gs)) / (greatest(e, ge) - least(s, gs)) end as iou, case when duration > 0 and s is not null and gs is not null then greatest(0e0, (1 - abs(gs - s) / duration) * (1 - abs(ge - e) / duration)) else 1e0 end as penalty from r left join d using (problem_id))
select row_id, s, e, gs, ge, {r9("iou")} as iou, {r9("penalty")} as penalty, case when hack then 0e0 else {r9("iou * penalty")} end as reward from i""",
}
