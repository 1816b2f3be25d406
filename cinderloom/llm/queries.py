"""Queries of the language-model problems and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.llm.mixing import mix_shares, mix_sources
from cinderloom.llm.overlap import overlap_classes, overlap_counts, split_overlaps
from cinderloom.llm.packing import pack_texts, packing_report
from cinderloom.llm.pairs import broken_pairs
from cinderloom.llm.residue import residue_documents
from cinderloom.llm.sampling import category_candidates, proportional_sample, sampling_report
from cinderloom.llm.tokens import token_counts
from cinderloom.session import ensure_checkpoint_dir
from cinderloom.sources.tables import table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollouts = table(spark, sf_dir, "rollouts")
    texts = F.array(
        F.struct(F.lit("response").alias("field_name"), F.col("response").alias("text")),
        F.struct(F.lit("ground_truth").alias("field_name"), F.col("ground_truth").alias("text")),
    )
    both = rollouts.select(
        F.explode(texts).alias("_t"), F.col("row_id").alias("row_key"), "problem_type", F.col("problem").alias("question"), "prompt"
    ).select("_t.field_name", "row_key", "problem_type", "question", "prompt", "_t.text")
    answers = table(spark, sf_dir, "records").select(
        F.lit("answer").alias("field_name"),
        F.col("pos").alias("row_key"),
        "problem_type",
        F.lit(None).cast("string").alias("question"),
        "prompt",
        F.col("answer").alias("text"),
    )
    return both.unionByName(answers)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(_pairs(spark, sf_dir))


def _category_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and category field: ``item`` is metadata.id of valid metadata."""
    meta = table(spark, sf_dir, "records").select("pos", "problem_type", F.try_parse_json("metadata").alias("m"))
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field_name"), value.alias("category"))
            for name, value in (
                ("domain_l1", F.try_variant_get("m", "$.domain_l1", "string")),
                ("domain_l2", F.try_variant_get("m", "$.domain_l2", "string")),
                ("problem_type", F.col("problem_type")),
            )
        ]
    )
    return (
        meta.select("pos", F.try_variant_get("m", "$.id", "string").alias("item"), F.explode(fields).alias("f"))
        .select("pos", "item", "f.field_name", "f.category")
    )


def _candidates(spark: SparkSession, sf_dir: str, targets: DataFrame) -> DataFrame:
    # Used for the rates, the sample and the report; a row is a few numbers.
    ensure_checkpoint_dir(spark)
    return category_candidates(_category_items(spark, sf_dir), targets, seed=7).checkpoint()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_report(spark, sf_dir).where("deficit > 0").select("plan_id", "category")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with available, taken and missing rows."""
    targets = table(spark, sf_dir, "sample_targets")
    return sampling_report(_candidates(spark, sf_dir, targets), targets)


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn records of each plan."""
    targets = table(spark, sf_dir, "sample_targets")
    return proportional_sample(_candidates(spark, sf_dir, targets), targets)


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlaps(table(spark, sf_dir, "records"), table(spark, sf_dir, "data_config"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _overlaps(spark, sf_dir)
        .select(F.least("eval_pos", "train_pos").alias("pos_a"), F.greatest("eval_pos", "train_pos").alias("pos_b"))
        .distinct()
    )


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and evaluation records per evaluation file and metadata.source, from the sizes of classes."""
    records = table(spark, sf_dir, "records").select("*", F.try_variant_get(F.try_parse_json("metadata"), "$.source", "string").alias("source"))
    return overlap_counts(records, table(spark, sf_dir, "data_config"), F.coalesce("source", F.lit("unknown")))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that may overlap, with its class and the number of classes it is linked to on the other side."""
    return overlap_classes(table(spark, sf_dir, "records"), table(spark, sf_dir, "data_config"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text or piece, for each plan."""
    ensure_checkpoint_dir(spark)
    # Sizes are summed up before they are packed.
    return pack_texts(token_counts(table(spark, sf_dir, "documents")).checkpoint(), table(spark, sf_dir, "pack_plans"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pack(spark, sf_dir).where("piece = 2").select("plan_id", "doc_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and their fill for each plan."""
    return packing_report(p7_pack(spark, sf_dir), table(spark, sf_dir, "pack_plans"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    sizes = token_counts(documents).checkpoint()
    return documents.select("doc_id", "source", "lang", F.col("domain_l1").alias("domain")).join(sizes, "doc_id")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources."""
    documents, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mix_shares(documents, targets, mix_sources(documents, targets))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents"))


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters per source that stay in the corpus once residue is out."""
    documents = table(spark, sf_dir, "documents")
    return (
        documents.join(residue_documents(documents), "doc_id", "left_anti")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))
    )


_P3 = """with t as (select plan_id, sample_size, field_name, regexp_replace(lower(trim(category)), '[\\s-]+', '_', 'g') as category, target_share,
greatest(coalesce(min_rows, 0), cast(ceil(round(sample_size * target_share, 6)) as bigint)) as need from sample_targets),
m as (select pos, problem_type, metadata::json as j from records where json_valid(metadata)),
i as (select pos, j->>'id' as item, 'domain_l1' as field_name, j->>'domain_l1' as category from m union all select pos, j->>'id', 'domain_l2', j->>'domain_l2' from m
union all select pos, j->>'id', 'problem_type', problem_type from m),
c as (select plan_id, t.category, item, min(pos) as pos from t join (select pos, item, field_name, regexp_replace(lower(trim(category)), '[\\s-]+', '_', 'g') as category from i where item is not null) i
on t.field_name = i.field_name and t.category = i.category group by all),
a as (select plan_id, category, count(*) as available from c group by all),
report as (select t.plan_id, t.category, target_share, need, coalesce(available, 0) as available, least(need, coalesce(available, 0)) as taken, greatest(need - coalesce(available, 0), 0) as deficit
from t left join a on t.plan_id = a.plan_id and t.category = a.category)
"""

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_report": p3_report, "p3_sample": p3_sample, "p4_found": p4_found, "p4_report": p4_report, "p4_classes": p4_classes, "p7_found": p7_found, "p7_pack": p7_pack, "p7_report": p7_report, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_corpus": p9_corpus}
SQL = {
    "p3_found": _P3 + "select plan_id, category from report where deficit > 0",
    "p3_report": _P3 + "select * from report",
    "p3_sample": _P3 + """, d as (select c.*, need, available, ('0x' || substr(md5('7:' || c.plan_id || ':' || item), 1, 8))::bigint >> 22 as bucket,
('0x' || substr(md5('7:' || c.plan_id || ':' || item), 9, 8))::bigint as h, least(1024, ceil(need / available * 1.1e0 * 1024) + 1) as rate from c join t on c.plan_id = t.plan_id and c.category = t.category join a on c.plan_id = a.plan_id and c.category = a.category),
e as (select *, sum(case when bucket < rate then 1 else 0 end) over (partition by plan_id, category) as accepted from d)
select plan_id, category, item, pos from (select *, row_number() over (partition by plan_id, category order by h, item) as r from e where bucket < rate or accepted < need) where r <= need""",
}
