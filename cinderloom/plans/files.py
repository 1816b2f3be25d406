"""Queries that write tables to the shared folder and read them back by every source."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.plans.catalog import r9
from cinderloom.session import ensure_checkpoint_dir
from cinderloom.sinks import files as K
from cinderloom.sources import files as S
from cinderloom.sources.tables import table

_SCHEMA = "pos bigint, data_file string, prompt string, answer string, problem_type string"


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").select("pos", "data_file", "prompt", "answer", "problem_type")


def jsonl_round_trip(spark: SparkSession, sf_dir: str):
    """Records as JSON lines, appended to in a second write, and read strictly."""
    at, r = _folder(spark), _records(spark, sf_dir)
    K.write_json_lines(r.where("pos % 2 = 0"), at)
    K.write_json_lines(r.where("pos % 2 = 1"), at, append=True)
    return S.json_lines(spark, at, _SCHEMA).select("pos", F.md5(F.concat_ws("|", "prompt", "answer", "problem_type")).alias("h"))


def jsonl_permissive(spark: SparkSession, sf_dir: str):
    """Lines cut off in the middle or blank among good ones: bad lines are counted, blank ones skipped."""
    at, r = _folder(spark), _records(spark, sf_dir)
    line = F.to_json(F.struct(*r.columns), {"ignoreNullFields": "false"})
    broken = F.when(F.col("pos") % 7 == 0, F.substring(line, 1, 40)).when(F.col("pos") % 11 == 0, F.lit("  ")).otherwise(line)
    r.select(broken.alias("value")).write.text(at)
    return S.json_lines(spark, at, _SCHEMA, strict=False).groupBy(F.col(S.BAD).isNotNull().alias("bad")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("n_pos"))


def folder_scan(spark: SparkSession, sf_dir: str):
    """One folder per step and phase, read together with step and phase drawn from the paths."""
    at = _folder(spark)
    r = table(spark, sf_dir, "rollouts").select("row_id", F.format_string("step_%06d", "step").alias("s"), F.coalesce("phase", F.lit("none")).alias("p"))
    K.write_json_lines(r, at, partition_by=["s", "p"])
    rows = S.json_lines(spark, f"{at}/*/*", "row_id bigint", place=True)
    return S.name_columns(rows, {"step": r"step_0*(\d+)", "phase": r"p=([a-z]+)"}).groupBy("step", "phase").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


def step_range(spark: SparkSession, sf_dir: str):
    """Steps 5 to 12 of a table partitioned by step: other partitions aren't opened."""
    at = _folder(spark)
    table(spark, sf_dir, "rollouts").select("row_id", "step", "reward").write.partitionBy("step").parquet(at)
    return spark.read.parquet(at).where("step between 5 and 12").select("row_id", F.col("step").cast("int").alias("step"))


def json_array(spark: SparkSession, sf_dir: str):
    """A folder of JSON documents, one a file, some of which are unreadable, and arrays of them."""
    at = _folder(spark)
    small = table(spark, sf_dir, "sample_targets").select("plan_id", F.to_json(F.struct("plan_id", "category", "target_share")).alias("j"))
    arrays = small.groupBy("plan_id").agg(F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list("j")), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("plan_id", "value").write.option("lineSep", "\n").partitionBy("plan_id").text(at)
    spark.createDataFrame([("zz", '{"plan_id": "cut')], "plan_id string, value string").write.mode("append").partitionBy("plan_id").text(at)
    return S.json_documents(spark, f"{at}/*", "plan_id string, category string, target_share double", F.col("target_share") > 0.1)


def csv_round_trip(spark: SparkSession, sf_dir: str):
    at = _folder(spark)
    K.write_csv(table(spark, sf_dir, "rollouts"), at, ["row_id", "phase", "reward", "video_paths", "nowhere"])
    return S.addressed(spark, at + "/*.csv").select(F.col("row_id").cast("long").alias("row_id"), "phase", F.col("reward").cast("string").try_cast("double").alias("reward"), F.length("video_paths").cast("long").alias("n"), (F.coalesce(F.col("nowhere").cast("string"), F.lit("")) == "").alias("is_empty"))


def teed_documents(spark: SparkSession, sf_dir: str):
    """Documents told apart in one pass by a first failing rule; each side is then read alone."""
    at = _folder(spark)
    d = table(spark, sf_dir, "documents")
    decision = F.when(F.coalesce(F.length("text"), F.lit(0)) < 80, "reject").when(F.col("lang").isNull(), "report").otherwise("keep")
    K.tee(d.select("doc_id", "text", "lang"), decision, at)
    sides = [spark.read.parquet(f"{at}/decision={s}").select("doc_id", F.lit(s).alias("side")) for s in ("keep", "reject", "report")]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


def summary_document(spark: SparkSession, sf_dir: str):
    at = _folder(spark)
    K.write_summary(table(spark, sf_dir, "rollouts").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("n_groups"), F.max("step").alias("last_step")), at)
    return spark.read.schema("n bigint, n_groups bigint, last_step int").json(at)


def saved_batch(spark: SparkSession, sf_dir: str):
    """A batch saved and loaded again by its address, with its split."""
    at = f"{_folder(spark)}.parquet"
    table(spark, sf_dir, "rollouts").select("row_id", F.col("phase").alias("split"), "temporal_segments").write.parquet(at)
    return S.addressed(spark, f"{at}@val").select("row_id", F.size("temporal_segments.predicted").alias("n"))


def kept_checkpoints(spark: SparkSession, sf_dir: str):
    """Of the steps' checkpoints the last three and the best by mean validation reward."""
    v = table(spark, sf_dir, "rollouts").where("phase = 'val' and reward is not null and not isnan(reward)").groupBy("step").agg((F.floor(F.avg("reward") * 1e9 + F.lit(0.5)) / 1e9).alias("score"))
    return K.retained(v, 3)


def frame_listing(spark: SparkSession, sf_dir: str):
    """Frame folders from the frame lists of records, as a listing would give them."""
    v = F.try_variant_get(F.try_parse_json("videos"), "$[0]", "array<string>")
    return S.frame_folders(table(spark, sf_dir, "records").select(F.explode(v).alias("path")))


def preferred_files(spark: SparkSession, sf_dir: str):
    """The files of the configs' training lists, each once in order; one for which a frames file is there is replaced."""
    rows = table(spark, sf_dir, "data_config").select("config_name", "train_files").orderBy("config_name").limit(1000).collect()
    paths = S.listed(*[[p.strip() for p in (r.train_files or "").split(",") if p.strip()] for r in rows])
    chosen = S.preferring_frames(paths, ["data/tg/train_frames.jsonl"])
    return spark.createDataFrame([(i, p, json.dumps(S.split_address(p + "@train")[1])) for i, p in enumerate(chosen)], "k bigint, path string, split string")


QUERIES = {
    f.__name__: f
    for f in (jsonl_round_trip, jsonl_permissive, folder_scan, step_range, json_array, csv_round_trip, teed_documents, summary_document, saved_batch, kept_checkpoints, frame_listing, preferred_files)
}
SQL = {
    "jsonl_round_trip": "select pos, md5(concat_ws('|', prompt, answer, problem_type)) as h from records",
    "jsonl_permissive": "select bad, count(*) as n, count(distinct case when not bad then pos end) as n_pos from (select pos, pos % 7 = 0 as bad from records where pos % 7 = 0 or pos % 11 <> 0) t group by all",
    "folder_scan": "select cast(step as bigint) as step, coalesce(phase, 'none') as phase, count(*) as n, min(row_id) as first_row from rollouts group by all",
    "step_range": "select row_id, step from rollouts where step between 5 and 12",
    "json_array": "select plan_id, category, target_share from sample_targets where target_share > 0.1e0",
    "csv_round_trip": "select row_id, phase, case when isnan(reward) then 'nan'::double else cast(printf('%.4f', reward) as double) end as reward, cast(length(to_json(video_paths)::varchar) as bigint) as n, true as is_empty from rollouts",
    "teed_documents": "select doc_id, case when coalesce(length(text), 0) < 80 then 'reject' when lang is null then 'report' else 'keep' end as side from documents",
    "summary_document": "select count(*) as n, count(distinct uid) as n_groups, max(step) as last_step from rollouts",
    "saved_batch": "select row_id, len(temporal_segments.predicted) as n from rollouts where phase = 'val'",
    "kept_checkpoints": f"""with v as (select step, {r9('avg(reward)')} as score from rollouts where phase = 'val' and reward is not null and not isnan(reward) group by step), r as (select *, row_number() over (order by step desc) as l, row_number() over (order by score desc, step desc) as b from v)
select step, score, case when b = 1 then 'best' when l = 1 then 'last' else 'kept' end as tracker from r where l <= 3 or b = 1""",
    "frame_listing": r"""with f as (select unnest(json_extract_string(v, '$[0][*]')) as p from (select videos::json as v from records where json_valid(videos)) a), g as (select regexp_extract(p, '^(.*)/(\d+)\.(?:jpg|jpeg|png|webp)$', 1) as d, try_cast(nullif(regexp_extract(p, '^(.*)/(\d+)\.(?:jpg|jpeg|png|webp)$', 2), '') as bigint) as k from f)
select d as frame_dir, count(distinct k) as n_frames, min(k) as first_frame, max(k) as last_frame from g where k is not null group by all""",
    "preferred_files": """with e as (select config_name, trim(unnest(string_split(coalesce(train_files, ''), ','))) as p, unnest(range(len(string_split(coalesce(train_files, ''), ',')))) as i from data_config), f as (select p, min(config_name || printf('%05d', i)) as o from e where p <> '' group by p)
select row_number() over (order by o) - 1 as k, case when p = 'data/tg/train.jsonl' then 'data/tg/train_frames.jsonl' else p end as path, '"train"' as split from f""",
}
