"""Queries that unnest documents, build tasks from them, and cut tables into batches, with oracles written on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.functions import building as B
from cinderloom.functions import parsing as P
from cinderloom.operators import batches as N
from cinderloom.plans.catalog import r9
from cinderloom.sources.tables import table

_SOUND = "not coalesce(is_deleted, false) and start_time >= 0 and start_time < end_time and end_time < 1e6"


def _text(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of documents with their sound events in order of time."""
    a = table(spark, sf_dir, "annotations").where("level1.macro_phases is not null and level2.events is not null")
    p = a.select("ann_id", "level2.events", F.explode("level1.macro_phases").alias("p")).where("p.phase_id is not null")
    own = F.filter("events", lambda e: F.coalesce((e["parent_phase_id"] == F.col("p.phase_id")) & (e["start_time"] < e["end_time"]), F.lit(False)))
    kids = F.array_sort(F.transform(own, lambda e: F.struct(e["start_time"].alias("s"), e["end_time"].alias("e"), e["event_id"].alias("id"), e["instruction"].alias("text"))))
    # A document may list a phase number again; each listing is a row.
    return p.select("ann_id", F.col("p.phase_id").alias("phase_id"), F.col("p.start_time").alias("ps"), F.col("p.end_time").alias("pe"), kids.alias("kids"))


def unnested_spans(spark: SparkSession, sf_dir: str):
    rows = _children(spark, sf_dir).select("ann_id", "phase_id", F.posexplode("kids").alias("j", "k"))
    return rows.select("ann_id", F.format_string("%d::p%d_e%d", "ann_id", "phase_id", "j").alias("id"), F.col("k.s").alias("s"), F.col("k.e").alias("e"))


def order_variants(spark: SparkSession, sf_dir: str):
    """Forward, reversed and shuffled orders of a phase's events, for phases with two or more that don't overlap."""
    rows = _children(spark, sf_dir).withColumn("kids", B.overlap_free(F.col("kids"))).where("size(kids) >= 2")
    ids = F.transform("kids", lambda k: k["id"])
    perm = B.hash_permutation(F.size("kids"), F.concat_ws(":", "ann_id", "phase_id"))
    return rows.select("ann_id", "phase_id", _text(ids).alias("forward"), _text(F.reverse(ids)).alias("reversed"), _text(B.permuted(ids, perm)).alias("shuffled")).distinct()


def sort_tasks(spark: SparkSession, sf_dir: str):
    """Up to five successive events, shuffled and numbered; the answer says where each in true order stands."""
    rows = _children(spark, sf_dir).withColumn("kids", F.slice("kids", 1, 5)).where("size(kids) >= 3")
    perm = B.hash_permutation(F.size("kids"), F.concat_ws(":", F.lit("sort"), "ann_id", "phase_id"))
    shown = B.permuted(F.transform("kids", lambda k: F.coalesce(k["text"], F.lit(""))), perm)
    lines = F.array_join(F.transform(shown, lambda t, i: F.format_string("(%d) %s.", i + 1, t)), " ")
    answer = F.array_join(F.transform(B.inverse_permutation(perm), lambda i: i.cast("string")), "")
    return rows.select("ann_id", "phase_id", F.md5(lines).alias("h"), answer.alias("answer")).distinct()


def next_step_tasks(spark: SparkSession, sf_dir: str):
    """A choice of what follows a phase's first events: the last one among the others of the document's, in hashed order."""
    rows = _children(spark, sf_dir).where("size(kids) >= 4")
    texts = F.transform("kids", lambda k: F.coalesce(k["text"], F.lit("")))
    rows = rows.withColumn("right", F.element_at(texts, 3)).withColumn("others", F.slice(F.array_distinct(F.filter(F.slice(texts, 4, 100), lambda t: t != F.element_at(texts, 3))), 1, 3)).where("size(others) >= 1")
    options = F.transform(F.array_sort(F.transform(F.concat(F.array("right"), "others"), lambda t: F.struct(F.md5(F.concat_ws(":", F.col("ann_id").cast("string"), t)).alias("h"), t.alias("t")))), lambda x: x["t"])
    rows = rows.withColumn("options", options)
    return rows.select("ann_id", "phase_id", F.md5(B.lettered(F.col("options"))).alias("h"), F.substring(F.lit("ABCDEFGH"), F.array_position("options", F.col("right")).cast("int"), F.lit(1)).alias("answer")).distinct()


def hierarchy_records(spark: SparkSession, sf_dir: str):
    """Segmentation records of each level: a document's phases, all its events, and each phase's events counted from its start."""
    spans = lambda c: F.array_sort(F.transform(F.filter(c, lambda x: F.coalesce(x["start_time"] < x["end_time"], F.lit(False))), lambda x: F.struct(x["start_time"].alias("s"), x["end_time"].alias("e"))))
    a = table(spark, sf_dir, "annotations")
    whole = [a.select("ann_id", F.lit(level).alias("level"), F.lit(0).alias("part"), spans(c).alias("x")) for level, c in (("L1", "level1.macro_phases"), ("L2_full", "level2.events"))]
    based = F.filter(F.transform("kids", lambda k: F.struct((F.greatest(k["s"], F.col("ps")) - F.col("ps")).alias("s"), (F.least(k["e"], F.col("pe")) - F.col("ps")).alias("e"))), lambda k: k["s"] < k["e"])
    inner = _children(spark, sf_dir).where("ps < pe").select("ann_id", F.lit("L2").alias("level"), F.col("phase_id").alias("part"), based.alias("x"))
    rows = whole[0].unionByName(whole[1]).unionByName(inner).where("size(x) > 0")
    length = F.aggregate("x", F.lit(0.0), lambda acc, k: acc + k["e"] - k["s"])
    return rows.select("ann_id", "level", "part", F.size("x").cast("long").alias("n"), (F.floor(length * 1e6 + F.lit(0.5)) / 1e6).alias("covered")).distinct()


def event_texts(spark: SparkSession, sf_dir: str):
    """The phases of a document as the reply that would list them, and read back."""
    x = F.array_sort(F.transform(F.filter("level1.macro_phases", lambda p: F.coalesce(p["start_time"] < p["end_time"], F.lit(False))), lambda p: F.struct(p["start_time"].alias("s"), p["end_time"].alias("e"))))
    rows = table(spark, sf_dir, "annotations").select("ann_id", x.alias("x")).where("size(x) > 0").withColumn("t", B.events_text(F.col("x")))
    return rows.select("ann_id", F.size("x").cast("long").alias("n"), F.size(P.segments(F.col("t"))).cast("long").alias("n_back"))


def direction_tasks(spark: SparkSession, sf_dir: str):
    """Sorting records put forward again: their numbered steps in the order the answer gives."""
    r = table(spark, sf_dir, "records").where("problem_type = 'event_logic_sort' and answer rlike '^[1-9]{2,9}$'")
    steps = F.regexp_extract_all(P.given(F.col("prompt")), F.lit(r"\(\d\) ([^()]*?)\.(?= \(|\s*$|\n)"), F.lit(1))
    digits = F.transform(F.split("answer", ""), lambda d: d.try_cast("int"))
    rows = r.select("pos", steps.alias("s"), digits.alias("d")).where("size(s) = size(d) and array_max(d) <= size(s)")
    return rows.select("pos", F.md5(F.array_join(B.permuted(F.col("s"), F.col("d")), "|")).alias("h"))


def scene_events(spark: SparkSession, sf_dir: str):
    """Events by the actions they list: how many are known, whether those are successive, and the span they cover."""
    e = table(spark, sf_dir, "hier_events").where("not coalesce(is_deleted, false) and child_action_ids is not null").select("row_id", "video_id", F.explode(F.array_distinct(F.transform("child_action_ids", lambda x: F.lower(F.trim(x))))).alias("aid"))
    a = table(spark, sf_dir, "actions").where(_SOUND).select("video_id", F.lower(F.trim("id")).alias("aid"), "start_time", "end_time")
    a = a.groupBy("video_id", "aid").agg(F.min("start_time").alias("s"), F.max("end_time").alias("e"))
    met = e.join(a, ["video_id", "aid"]).withColumn("num", F.regexp_extract("aid", r"^a(\d+)$", 1).try_cast("long"))
    return met.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce((F.count("num") == F.count(F.lit(1))) & (F.max("num") - F.min("num") + 1 == F.count(F.lit(1))), F.lit(False)).alias("successive"), F.min("s").alias("s"), F.max("e").alias("e")
    )


def uncovered_actions(spark: SparkSession, sf_dir: str):
    """Sound actions that no event of their video lists."""
    e = table(spark, sf_dir, "hier_events").where("not coalesce(is_deleted, false) and child_action_ids is not null").select("video_id", F.explode(F.transform("child_action_ids", lambda x: F.lower(F.trim(x)))).alias("aid"))
    a = table(spark, sf_dir, "actions").where(_SOUND).select("row_id", "video_id", F.lower(F.trim("id")).alias("aid"))
    return a.join(e, ["video_id", "aid"], "left_anti").select("row_id")


def whole_second_spans(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "hier_events").where(_SOUND).select("row_id", F.floor("start_time").cast("long").alias("s"), F.ceil("end_time").cast("long").alias("e"))
    return rows.where("s < e")


def metadata_paths(spark: SparkSession, sf_dir: str):
    """Numbers of metadata by path, one level deep, over all records."""
    m = F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string,variant>")
    rows = table(spark, sf_dir, "records").select(F.explode(m).alias("key", "v")).select("key", F.try_variant_get("v", "$", "double").alias("x"), F.schema_of_variant("v").alias("kind"))
    return rows.where("x is not null and not kind like 'STRING%' and kind <> 'BOOLEAN'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


def rank_sort(spark: SparkSession, sf_dir: str):
    """Documents in order of their source's rank, then length, numbered without one task sorting all."""
    rank = F.when(F.col("source") == "howto_transcript", 0).when(F.col("source") == "clip_caption", 1).when(F.col("source").isNull(), 3).otherwise(2)
    d = table(spark, sf_dir, "documents").select("doc_id", rank.alias("k"), "n_chars")
    placed = N.positions(d, [F.col("k"), F.desc("n_chars"), F.col("doc_id")])
    return placed.select("doc_id", (F.col("position") + 1).alias("rank_no"))


def longest_fill(spark: SparkSession, sf_dir: str):
    """The longest documents of other sources, as many as there are forum answers."""
    d = table(spark, sf_dir, "documents")
    size = d.where("source = 'forum_answer'").agg(F.count(F.lit(1)).alias("budget"))
    placed = N.positions(d.where("source <> 'howto_transcript'").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")])
    return placed.join(F.broadcast(size), F.col("position") < F.col("budget")).select("doc_id")


def training_batches(spark: SparkSession, sf_dir: str):
    """Records in a seeded order, filled up to a multiple of 64: their mini-batch of 64 and micro-batch of 16."""
    r = table(spark, sf_dir, "records").select("pos", F.md5(F.concat(F.lit("e1:"), F.col("pos").cast("string"))).alias("h"))
    full = N.padded(N.positions(r, [F.col("h"), F.col("pos")]).drop("h"), 64, "position")
    return full.select("pos", "position", "is_pad", F.floor(F.col("position") / 64).alias("mini"), F.floor(F.col("position") % 64 / 16).alias("micro"))


def repeated_rows(spark: SparkSession, sf_dir: str):
    """The plans' rows three times side by side, and twice as a whole."""
    t = N.positions(table(spark, sf_dir, "sample_targets").select("plan_id", "category"), [F.col("plan_id"), F.col("category")], parts=4)
    both = N.repeat(t, 3, "position").withColumn("way", F.lit("interleaved")).unionByName(N.repeat(t, 2, "position", False).withColumn("way", F.lit("tiled")))
    return both.select("way", "position", "plan_id", "category")


def chunked_rows(spark: SparkSession, sf_dir: str):
    """The targets in two chunks, put in reverse, and back by the inverse permutation."""
    t = N.positions(table(spark, sf_dir, "sample_targets").select("plan_id", "category"), [F.col("plan_id"), F.col("category")], parts=4)
    total = t.agg(F.count(F.lit(1)).alias("total"))
    perm = t.join(F.broadcast(total)).select("position", (F.col("total") - 1 - F.col("position")).alias("source"))
    back = N.reordered(N.reordered(t, perm, "position"), N.inverse(perm, "position"), "position")
    return back.join(F.broadcast(total)).select("plan_id", "category", "position", N.chunk_of(F.col("position"), F.col("total"), 2).alias("chunk"))


def flat_columns(spark: SparkSession, sf_dir: str):
    """Projections of the batch protocol: unknown names ignored, columns popped, renamed, nested and flat again."""
    r = table(spark, sf_dir, "rollouts")
    popped, rest = N.pop(N.select(r, ["row_id", "phase", "step", "nowhere", "reward", "temporal_segments"]), ["phase"], "row_id")
    one = N.flat(rest).select("row_id", "step", F.col("`temporal_segments/max_t`").alias("max_t")).join(N.rename(popped, ["phase"], ["side"]), "row_id")
    back = N.flat(N.nested(N.rename(one, ["side", "step"], ["at/side", "at/step"])))
    return back.groupBy(F.col("`at/side`").alias("side")).agg(F.count("`at/step`").alias("n_steps"), F.count("max_t").alias("n_times"))


QUERIES = {
    f.__name__: f
    for f in (
        unnested_spans, order_variants, sort_tasks, next_step_tasks, hierarchy_records, event_texts, direction_tasks, scene_events, uncovered_actions, whole_second_spans, metadata_paths, rank_sort, longest_fill,
        training_batches, repeated_rows, chunked_rows, flat_columns,
    )
}

_LIVE = "not coalesce(is_deleted, false) and not isnan(start_time) and not isnan(end_time) and start_time >= 0 and start_time < end_time and end_time < 1e6"
_K = """p as (select ann_id, i, level2.events as ev, p.phase_id as phase_id, p.start_time as ps, p.end_time as pe from (select ann_id, level2, unnest(level1.macro_phases) as p, unnest(range(len(level1.macro_phases))) as i from annotations where level1.macro_phases is not null and level2.events is not null) a where p.phase_id is not null),
k as (select ann_id, i, phase_id, ps, pe, e.start_time as s, e.end_time as e, e.event_id as id, coalesce(e.instruction, '') as text, row_number() over (partition by ann_id, i order by e.start_time, e.end_time, e.event_id, e.instruction) as j from (select *, unnest(ev) as e from p) b where e.parent_phase_id = phase_id and e.start_time < e.end_time)"""
_PERM = """{n}0 as (select {keys}, unnest(range(1, n + 1)) as v, n, {seed} as sd from {src}), {n}1 as (select *, row_number() over (partition by {keys} order by md5(sd || ':' || v)) as pl from {n}0), {n}2 as (select *, bool_and(v = pl) over (partition by {keys}) as idn from {n}1),
{n} as (select {keys}, v, case when idn then (pl + n - 2) % n + 1 else pl end as pl from {n}2)"""
SQL = {
    "unnested_spans": f"with {_K} select ann_id, printf('%d::p%d_e%d', ann_id, phase_id, j - 1) as id, s, e from k",
    "order_variants": f"""with {_K}, o as (select ann_id, i, phase_id, count(*) as n, bool_or(s < pe2) as clash from (select *, lag(e) over (partition by ann_id, i order by j) as pe2 from k) t group by all), g as (select * from o where n >= 2 and not coalesce(clash, false)),
{_PERM.format(n='m', keys='ann_id, i', seed="ann_id || ':' || phase_id", src='g')}
select distinct g.ann_id, g.phase_id, (select string_agg(id, ',' order by j) from k where k.ann_id = g.ann_id and k.i = g.i) as forward, (select string_agg(id, ',' order by j desc) from k where k.ann_id = g.ann_id and k.i = g.i) as reversed, (select string_agg(id, ',' order by pl) from k join m on k.ann_id = m.ann_id and k.i = m.i and k.j = m.v where k.ann_id = g.ann_id and k.i = g.i) as shuffled from g""",
    "sort_tasks": f"""with {_K}, g as (select ann_id, i, phase_id, least(count(*), 5) as n from k group by all having count(*) >= 3), {_PERM.format(n='m', keys='ann_id, i', seed="'sort:' || ann_id || ':' || phase_id", src='g')}
select distinct g.ann_id, g.phase_id, (select md5(string_agg(printf('(%d) %s.', pl, text), ' ' order by pl)) from k join m on k.ann_id = m.ann_id and k.i = m.i and k.j = m.v where k.ann_id = g.ann_id and k.i = g.i) as h, (select string_agg(pl, '' order by v) from m where m.ann_id = g.ann_id and m.i = g.i) as answer from g""",
    "next_step_tasks": f"""with {_K}, g as (select ann_id, i, phase_id from k group by all having count(*) >= 4), r as (select g.*, k.text as t from g join k on g.ann_id = k.ann_id and g.i = k.i and j = 3), d as (select r.ann_id, r.i, k.text, min(j) as j from r join k on r.ann_id = k.ann_id and r.i = k.i and k.j >= 4 and k.text <> r.t group by all),
o as (select ann_id, i, text, false as ok from (select *, row_number() over (partition by ann_id, i order by j) as q from d) x where q <= 3 union all select ann_id, i, t, true from r where exists (select 1 from d where d.ann_id = r.ann_id and d.i = r.i)), p2 as (select *, row_number() over (partition by ann_id, i order by md5(ann_id || ':' || text)) as q from o)
select distinct p2.ann_id, g.phase_id, md5(string_agg(chr(cast(64 + q as int)) || '. ' || text, chr(10) order by q)) as h, max(case when ok then chr(cast(64 + q as int)) end) as answer from p2 join g on p2.ann_id = g.ann_id and p2.i = g.i group by p2.ann_id, p2.i, g.phase_id""",
    "hierarchy_records": f"""with {_K}, x as (select ann_id, 'L1' as level, 0 as part, 0 as i, p.start_time as s, p.end_time as e from (select ann_id, unnest(level1.macro_phases) as p from annotations) a union all select ann_id, 'L2_full', 0, 0, p.start_time, p.end_time from (select ann_id, unnest(level2.events) as p from annotations) a
union all select ann_id, 'L2', phase_id, i, greatest(s, ps) - ps, least(e, pe) - ps from k where ps < pe) select distinct ann_id, level, part, n, covered from (select ann_id, level, part, i, count(*) as n, floor(sum(e - s) * 1e6 + 0.5) / 1e6 as covered from x where s < e group by all) t""",
    "event_texts": "select ann_id, count(*) as n, count(*) filter (round(p.start_time, 1) < round(p.end_time, 1)) as n_back from (select ann_id, unnest(level1.macro_phases) as p from annotations) a where p.start_time < p.end_time group by all",
    "direction_tasks": r"""with r as (select pos, answer, regexp_extract_all(regexp_replace(coalesce(prompt, ''), '\.( \(|\s*$|\n)', '.' || chr(1) || '\1', 'g'), '\(\d\) ([^()]*?)\.' || chr(1), 1) as s from records where problem_type = 'event_logic_sort' and regexp_matches(answer, '^[1-9]{2,9}$')), d as (select *, list_transform(string_split(answer, ''), lambda c: cast(c as int)) as d from r)
select pos, md5(array_to_string(list_transform(d, lambda i: s[i]), '|')) as h from d where len(s) = len(d) and list_max(d) <= len(s)""",
    "scene_events": rf"""with e as (select distinct row_id, video_id, lower(trim(x)) as aid from (select row_id, video_id, unnest(child_action_ids) as x from hier_events where not coalesce(is_deleted, false)) t), a as (select video_id, lower(trim(id)) as aid, min(start_time) as s, max(end_time) as e from actions where {_LIVE} group by all),
m as (select row_id, a.s, a.e, try_cast(nullif(regexp_extract(e.aid, '^a(\d+)$', 1), '') as bigint) as num from e join a on e.video_id = a.video_id and e.aid = a.aid) select row_id, count(*) as n, coalesce(count(num) = count(*) and max(num) - min(num) + 1 = count(*), false) as successive, min(s) as s, max(e) as e from m group by all""",
    "uncovered_actions": f"select row_id from actions a where {_LIVE} and not exists (select 1 from (select video_id, lower(trim(x)) as aid from (select video_id, unnest(child_action_ids) as x from hier_events where not coalesce(is_deleted, false)) t) e where e.video_id = a.video_id and e.aid = lower(trim(a.id)))",
    "whole_second_spans": f"select row_id, cast(floor(start_time) as bigint) as s, cast(ceil(end_time) as bigint) as e from hier_events where {_LIVE}",
    "metadata_paths": "with j as (select metadata::json as m from records where json_valid(metadata)), k as (select m, unnest(json_keys(m)) as key from j), v as (select key, json_extract(m, '$.\"' || key || '\"') as v from k) select key, count(*) as n, min(cast(v as double)) as least, max(cast(v as double)) as most from v where json_type(v) in ('BIGINT', 'UBIGINT', 'DOUBLE') group by all",
    "rank_sort": "select doc_id, row_number() over (order by case when source = 'howto_transcript' then 0 when source = 'clip_caption' then 1 when source is null then 3 else 2 end, n_chars desc, doc_id) as rank_no from documents",
    "longest_fill": "select doc_id from (select doc_id, row_number() over (order by n_chars desc, doc_id) as rn from documents where source <> 'howto_transcript') t where rn <= (select count(*) from documents where source = 'forum_answer')",
    "training_batches": """with o as (select pos, row_number() over (order by md5('e1:' || pos), pos) - 1 as p, count(*) over () as n from records), f as (select pos, p as position, false as is_pad from o union all select pos, p + n, true from o where p < 63 - (n - 1) % 64) select pos, position, is_pad, position // 64 as mini, position % 64 // 16 as micro from f""",
    "repeated_rows": """with t as (select plan_id, category, row_number() over (order by plan_id, category) - 1 as p, count(*) over () as n from sample_targets) select 'interleaved' as way, p * 3 + c as position, plan_id, category from t, range(3) as r(c) union all select 'tiled', p + c * n, plan_id, category from t, range(2) as r(c)""",
    "chunked_rows": "select plan_id, category, p as position, p // (n // 2) as chunk from (select plan_id, category, row_number() over (order by plan_id, category) - 1 as p, count(*) over () as n from sample_targets) t",
    "flat_columns": "select phase as side, count(step) as n_steps, count(temporal_segments.max_t) as n_times from rollouts group by all",
}
