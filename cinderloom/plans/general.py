"""Queries of the general training-data problems: intervals, references, nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.operators.flatten import annotation_occurrences, object_store, record_occurrences
from cinderloom.operators.periods import continuous_periods, seconds_to_ms
from cinderloom.operators.references import orphan_counts, orphan_references
from cinderloom.sources.tables import table

NODE_TABLES = {"phase": "phases", "event": "hier_events", "action": "actions"}


def _live_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, name in NODE_TABLES.items():
        rows = table(spark, sf_dir, name).where(
            "not coalesce(is_deleted, false) and not isnan(start_time) and not isnan(end_time)"
            " and start_time >= 0 and start_time < end_time"
        )
        rows = rows.select(
            "video_id",
            F.lit(kind).alias("node_kind"),
            seconds_to_ms(F.col("start_time")).alias("start_ms"),
            seconds_to_ms(F.col("end_time")).alias("end_ms"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = continuous_periods(
        _live_spans(spark, sf_dir), ["video_id", "node_kind"], "start_ms", "end_ms", tolerance=50
    )
    return pieces.withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


def p2_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered milliseconds per node kind."""
    return p2_found(spark, sf_dir).groupBy("node_kind", "piece").agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.countDistinct("video_id").alias("n_videos"),
        F.sum(F.col("end_ms") - F.col("start_ms")).cast("long").alias("total_ms"),
    )


def _clean_id(name: str):
    return F.lower(F.trim(F.col(name)))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All references and all their possible targets."""
    targets = None
    for kind, name in NODE_TABLES.items():
        rows = table(spark, sf_dir, name).select(
            "video_id", F.lit(kind).alias("kind"), _clean_id("id").alias("id"), "is_deleted", "loaded_at"
        )
        targets = rows if targets is None else targets.unionByName(rows)
    letter = F.substring("id", 1, 1)
    kind = F.when(letter == "p", "phase").when(letter == "e", "event").when(letter == "a", "action")
    actions = table(spark, sf_dir, "actions")
    links = table(spark, sf_dir, "causal_links")

    def refs_of(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.where("not coalesce(is_deleted, false)").select(
            F.lit(name).alias("ref_table"),
            F.lit(column).alias("ref_column"),
            "row_id",
            "video_id",
            _clean_id(column).alias("id"),
            "loaded_at",
        ).where("id <> ''")

    refs = refs_of(actions, "actions", "parent_event_id").withColumn("kind", F.lit("event"))
    for column in ("from_id", "to_id"):
        refs = refs.unionByName(refs_of(links, "causal_links", column).withColumn("kind", kind))
    return refs, targets


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*_references(spark, sf_dir)).select("ref_table", "ref_column", "row_id", "reason")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, column, reason and day of loaded_at."""
    counts = orphan_counts(*_references(spark, sf_dir))
    return counts.select("ref_table", "ref_column", "reason", F.col("period").cast("string").alias("day"), "n_orphans")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation_occurrences(table(spark, sf_dir, "annotations"), whole=True).unionByName(
        record_occurrences(table(spark, sf_dir, "records"), whole=True)
    )


#: The nodes of the flat tables; the others of the bridge are documents, levels, wrappers and metadata objects.
FLAT = ["phase", "event", "action", "message", "ordered_id", "frame_video"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables' links: the bridge's rows of their nodes."""
    return p6_bridge(spark, sf_dir).where(F.col("node").isin(FLAT)).select("src", "root_id", "node", "node_id", "parent_id")


def p6_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object store: every distinct object once, with the number of its occurrences."""
    return object_store(_occurrences(spark, sf_dir))


def p6_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence: its own and its parent's id, the object, the object that contains it and the place in its array."""
    return _occurrences(spark, sf_dir).select("src", "root_id", "node", "node_id", "parent_id", "container_id", "object_id", "ordinal")


_SPANS_SQL = " union all ".join(
    f"""select video_id, '{kind}' as node_kind, cast(round(start_time * 1000) as bigint) as s, cast(round(end_time * 1000) as bigint) as e
    from {name} where not coalesce(is_deleted, false) and not isnan(start_time) and not isnan(end_time)
    and start_time >= 0 and start_time < end_time and not isinf(end_time)"""
    for kind, name in NODE_TABLES.items()
)
_P2 = f"""with spans as ({_SPANS_SQL}),
prev as (select *, max(e) over (partition by video_id, node_kind order by s, e rows between unbounded preceding and 1 preceding) as pe from spans),
marked as (select *, sum(case when pe is null or s > pe + 50 then 1 else 0 end) over (partition by video_id, node_kind order by s, e rows unbounded preceding) as island from prev),
islands as (select video_id, node_kind, island, min(s) as s, max(e) as e from marked group by all),
pieces as (select video_id, node_kind, 'period' as piece, s as start_ms, e as end_ms from islands
union all select * from (select video_id, node_kind, 'gap' as piece, lag(e) over (partition by video_id, node_kind order by s) as start_ms, s as end_ms from islands) where start_ms is not null)
"""
_P5 = """with nodes as (
select video_id, 'p' as k, lower(trim(id)) as id, coalesce(is_deleted, false) as gone, loaded_at from phases
union all select video_id, 'e', lower(trim(id)), coalesce(is_deleted, false), loaded_at from hier_events
union all select video_id, 'a', lower(trim(id)), coalesce(is_deleted, false), loaded_at from actions),
state as (select video_id, k, id, bool_or(not gone) as live, min(case when not gone then loaded_at end) as first_live from nodes group by all),
refs as (select 'actions' as ref_table, 'parent_event_id' as ref_column, row_id, video_id, 'e' as k, lower(trim(parent_event_id)) as id, loaded_at from actions where not coalesce(is_deleted, false)
union all select 'causal_links', 'from_id', row_id, video_id, left(lower(trim(from_id)), 1), lower(trim(from_id)), loaded_at from causal_links where not coalesce(is_deleted, false)
union all select 'causal_links', 'to_id', row_id, video_id, left(lower(trim(to_id)), 1), lower(trim(to_id)), loaded_at from causal_links where not coalesce(is_deleted, false)),
orphans as (select r.*, case when s.live is null then 'missing' when not s.live then 'deleted' when s.first_live > r.loaded_at then 'late' end as reason
from refs r left join state s on r.video_id = s.video_id and r.k = s.k and r.id = s.id where r.id <> '')
"""
_P6 = """with docs as (select ann_id, case when not coalesce(level1._parse_error, false) then level1.macro_phases end as ph,
case when not coalesce(level2._parse_error, false) then level2.events end as ev,
case when not coalesce(level3._parse_error, false) then level3.grounding_results end as gr from annotations),
phases_ as (select ann_id, unnest(ph) as x from docs), events_ as (select ann_id, unnest(ev) as x from docs), ground as (select ann_id, unnest(gr) as x from docs),
nested as (select ann_id, x.event_id as event_id, unnest(x.sub_actions) as s from ground where x is not null and x.action_id is null),
meta as (select pos, messages, case when json_valid(metadata) then metadata::json end as m from records),
oid as (select pos, unnest(json_extract(m, '$.ordered_ids[*]')) as v, generate_subscripts(json_extract(m, '$.ordered_ids[*]'), 1) as i from meta),
vid as (select pos, unnest(json_extract(m, '$.offline_frame_extraction.videos[*]')) as v, generate_subscripts(json_extract(m, '$.offline_frame_extraction.videos[*]'), 1) as i from meta),
msg as (select pos, unnest(messages) as v, generate_subscripts(messages, 1) as i from meta)
select 'annotations' as src, ann_id::varchar as root_id, 'phase' as node, x.phase_id::bigint as node_id, 0::bigint as parent_id from phases_ where x is not null
union all select 'annotations', ann_id::varchar, 'event', x.event_id::bigint, coalesce(x.parent_phase_id, -1)::bigint from events_ where x is not null
union all select 'annotations', ann_id::varchar, 'action', x.action_id::bigint, coalesce(x.parent_event_id, -1)::bigint from ground where x is not null and x.action_id is not null
union all select 'annotations', ann_id::varchar, 'action', s.action_id::bigint, coalesce(event_id, -1)::bigint from nested where s is not null
union all select 'records', pos::varchar, 'message', i::bigint, 0::bigint from msg where v is not null
union all select 'records', pos::varchar, 'ordered_id', i::bigint, 0::bigint from oid where v is not null and json_type(v) <> 'NULL'
union all select 'records', pos::varchar, 'frame_video', i::bigint, 0::bigint from vid where v is not null and json_type(v) <> 'NULL'"""

QUERIES = {
    "p2_found": p2_found,
    "p2_cover": p2_cover,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_objects": p6_objects,
    "p6_bridge": p6_bridge,
}
SQL = {
    "p2_found": _P2 + "select * from pieces",
    "p2_cover": _P2 + "select node_kind, piece, count(*) as n_pieces, count(distinct video_id) as n_videos, cast(sum(end_ms - start_ms) as bigint) as total_ms from pieces group by all",
    "p5_found": _P5 + "select ref_table, ref_column, row_id, reason from orphans where reason is not null",
    "p5_report": _P5 + "select ref_table, ref_column, reason, strftime(loaded_at, '%Y-%m-%d') as day, count(*) as n_orphans from orphans where reason is not null group by all",
    "p6_found": _P6,
}
