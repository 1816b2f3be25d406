"""Queries of quotas, splits and rebalancing over records, with oracles by plain ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cinderloom.operators import quotas as Q
from cinderloom.operators.batches import positions
from cinderloom.operators.lookups import values_at_ranks
from cinderloom.session import ensure_checkpoint_dir
from cinderloom.sources.tables import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.try_parse_json("metadata")
    text = lambda path: F.coalesce(F.lower(F.trim(F.try_variant_get(m, path, "string"))), F.lit("unknown"))
    return table(spark, sf_dir, "records").select(
        "pos", "prompt", "answer", F.coalesce("problem_type", F.lit("unknown")).alias("kind"), text("$.domain_l1").alias("l1"), text("$.domain_l2").alias("l2"),
        F.coalesce(F.try_variant_get(m, "$.output_count", "int"), F.lit(0)).alias("outputs"), Q.order_hash("s1", "pos").alias("h"),
    )


def stratified(spark: SparkSession, sf_dir: str):
    """200 records in proportion to their types; the last type in order takes what rounding leaves."""
    items = _items(spark, sf_dir)
    quotas = Q.proportional_quotas(Q.group_counts(items, ["kind"]), [], "kind", F.lit(200))
    return Q.take(items, quotas, ["kind"], "h", "pos").select("pos", "kind")


def nested_stratified(spark: SparkSession, sf_dir: str):
    """300 records in proportion to their types and, within a type, to their domains; the last type makes up for what the others' domains gave away."""
    items, target = _items(spark, sf_dir), 300
    kinds = Q.proportional_quotas(Q.group_counts(items, ["kind"]), [], "kind", F.lit(target))
    fine = Q.group_counts(items, ["kind", "l1"])
    by_kind = lambda k: Q.proportional_quotas(fine.join(k.select("kind", F.col("quota").alias("t")), "kind"), ["kind"], "l1", F.col("t"))
    first = by_kind(kinds)
    everything = W.partitionBy(F.lit(0))
    taken = first.groupBy("kind").agg(F.sum("quota").alias("took"), F.sum("n").alias("n"))
    last = taken.withColumn("rest", F.lit(target) - F.sum("took").over(everything) + F.col("took")).withColumn("r", F.row_number().over(everything.orderBy(F.desc("kind")))).where("r = 1")
    last = last.select("kind", F.least("n", "rest").alias("quota"))
    final = first.join(last.select("kind"), "kind", "left_anti").select("kind", "l1", "quota").unionByName(by_kind(last).select("kind", "l1", "quota"))
    return Q.take(items, final, ["kind", "l1"], "h", "pos").select("pos", "kind", "l1")


def two_level_balance(spark: SparkSession, sf_dir: str):
    """400 records, even over domains and within a domain over its second level, those with most outputs first."""
    items = _items(spark, sf_dir)
    top = Q.even_quotas(Q.group_counts(items, ["l1"]), [], "l1", F.lit(400)).select("l1", F.col("quota").alias("t"))
    fine = Q.even_quotas(Q.group_counts(items, ["l1", "l2"]).join(top, "l1"), ["l1"], "l2", F.col("t"))
    # Most outputs first, then the draw: both in one number, as outputs stay below 1024.
    first = F.shiftleft(F.lit(1023) - F.least(F.col("outputs"), F.lit(1023)).cast("long"), 50) + F.shiftright("h", 10)
    return Q.take(items.withColumn("o", first), fine, ["l1", "l2"], "o", "pos").select("pos", "l1", "l2")


def small_whole_quota(spark: SparkSession, sf_dir: str):
    items = _items(spark, sf_dir)
    top = Q.small_whole_quotas(Q.group_counts(items, ["l1"]), [], "l1", F.lit(350)).select("l1", F.col("quota").alias("t"))
    fine = Q.small_whole_quotas(Q.group_counts(items, ["l1", "l2"]).join(top, "l1"), ["l1"], "l2", F.col("t"))
    return Q.take(items, fine, ["l1", "l2"], "h", "pos").select("pos", "l1", "l2")


def cell_downsample(spark: SparkSession, sf_dir: str):
    items = _items(spark, sf_dir)
    quotas = Q.cell_quotas(Q.group_counts(items, ["kind", "l1"]), ["kind", "l1"], 500, "c1")
    return Q.take(items, quotas, ["kind", "l1"], "h", "pos").select("pos", "kind", "l1")


def shortfall_balance(spark: SparkSession, sf_dir: str):
    """A budget of 330 evenly over domains, evenly inside over the second level, what small domains lack evenly over the others."""
    ensure_checkpoint_dir(spark)
    items, budget = _items(spark, sf_dir).checkpoint(), 330
    everything = W.partitionBy(F.lit(0))
    fine = Q.group_counts(items, ["l1", "l2"])
    tops = fine.groupBy("l1").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("subs")).withColumn("base", F.floor(F.lit(budget) / F.count(F.lit(1)).over(everything)))
    tops = tops.withColumn("whole", F.col("n") <= F.col("base"))
    lack = F.sum(F.when(F.col("whole"), F.col("base") - F.col("n")).otherwise(0)).over(everything) + F.lit(budget) - F.col("base") * F.count(F.lit(1)).over(everything)
    tops = tops.withColumn("more", F.floor(lack / F.greatest(F.lit(1), F.count_if(~F.col("whole")).over(everything))))
    inner = fine.join(tops.select("l1", "base", "whole", "subs"), "l1").withColumn("quota", F.when(F.col("whole"), F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.col("base") / F.col("subs")))))
    first = Q.take(items, inner, ["l1", "l2"], "h", "pos").select("pos", "l1", "l2", "h").checkpoint()
    left = items.join(first.select("pos"), "pos", "left_anti").select("pos", "l1", "l2", "h")
    second = Q.take(left, tops.where("not whole").select("l1", F.col("more").alias("quota")), ["l1"], "h", "pos")
    return first.unionByName(second).select("pos", "l1", "l2")


def type_nested_balance(spark: SparkSession, sf_dir: str):
    """240 records: an equal part for each type, inside it an equal part for each domain, both filled up from what is left."""
    # Each step looks twice at the one before, so the plan is cut between them.
    ensure_checkpoint_dir(spark)
    items, target = _items(spark, sf_dir).drop("prompt", "answer").checkpoint(), 240
    fine = Q.group_counts(items, ["kind", "l1"])
    kinds = fine.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("subs")).withColumn("per", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(target) / F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))).cast("long")))
    kinds = kinds.withColumn("whole", F.col("n") <= F.col("per")).withColumn("each", F.greatest(F.lit(1).cast("long"), F.floor(F.col("per") / F.col("subs"))))
    inner = fine.join(kinds.select("kind", "whole", "each"), "kind").withColumn("quota", F.when(F.col("whole"), F.col("n")).otherwise(F.least("n", "each")))
    first = Q.take(items, inner, ["kind", "l1"], "h", "pos").select("pos", "kind", "h").checkpoint()
    left = items.join(first.select("pos"), "pos", "left_anti").select("pos", "kind", "h")
    fill = Q.take(left, kinds.where("not whole").select("kind", (F.col("per") - F.col("each") * F.col("subs")).alias("quota")), ["kind"], "h", "pos")
    second = first.unionByName(fill).checkpoint()
    # More domains than a type's part overfill it, so the part is cut at the end.
    second = Q.take(second, kinds.select("kind", F.col("per").alias("quota")), ["kind"], "h", "pos").withColumn("one", F.lit(1)).checkpoint()
    rest = items.join(second.select("pos"), "pos", "left_anti").select("pos", "kind", "h", F.lit(1).alias("one"))
    remainder = kinds.agg((F.lit(target) - F.sum("per")).alias("quota")).withColumn("one", F.lit(1))
    return second.unionByName(Q.take(rest, remainder, ["one"], "h", "pos")).select("pos", "kind")


def shuffle_split(spark: SparkSession, sf_dir: str):
    """The first 100 records of a seeded order for validation, the next 1000 for training."""
    items = _items(spark, sf_dir).select("pos", "h", F.lit(1).alias("one"))
    ranked = Q.numbered(items, ["one"], "h", "pos").where("rn <= 1100")
    return ranked.select("pos", F.when(F.col("rn") <= 100, "val").otherwise("train").alias("side"))


def val_top_up(spark: SparkSession, sf_dir: str):
    """Validation rows of the logic file, filled up to 60 from training prompts that aren't among them, in proportion to type."""
    records = table(spark, sf_dir, "records")
    val = records.where("data_file = 'data/logic/val.jsonl'").select("pos", "prompt")
    pool = records.where("data_file like 'data/logic/train/%'").join(val.select("prompt"), "prompt", "left_anti").select("pos", F.coalesce("problem_type", F.lit("unknown")).alias("kind"), Q.order_hash("v1", "pos").alias("h"))
    short = val.agg(F.greatest(F.lit(0), F.lit(60) - F.count(F.lit(1))).alias("t"))
    quotas = Q.proportional_quotas(Q.group_counts(pool, ["kind"]).join(F.broadcast(short)), [], "kind", F.col("t"))
    return val.select("pos", F.lit("val").alias("origin")).unionByName(Q.take(pool, quotas, ["kind"], "h", "pos").select("pos", F.lit("train").alias("origin")))


def rebalance_binary(spark: SparkSession, sf_dir: str):
    """Forward or reverse answers made even in each domain: half the surplus flips, and its options change places."""
    items = _items(spark, sf_dir).where("kind = 'seg_aot_event_dir_binary' and answer in ('A', 'B')")
    counts = items.groupBy("l1").agg(F.count_if(F.col("answer") == "A").alias("a"), F.count_if(F.col("answer") == "B").alias("b"))
    quotas = counts.select("l1", F.when(F.col("a") >= F.col("b"), "A").otherwise("B").alias("answer"), F.floor(F.abs(F.col("a") - F.col("b")) / 2).alias("quota"))
    flipped = Q.take(items, quotas, ["l1", "answer"], "h", "pos").select("pos", F.lit(True).alias("flip"))
    from cinderloom.functions.parsing import swapped_options

    both = items.join(flipped, "pos", "left").withColumn("flip", F.coalesce("flip", F.lit(False)))
    return both.select("pos", "l1", "flip", F.when(F.col("flip"), F.translate("answer", "AB", "BA")).otherwise(F.col("answer")).alias("new_answer"), F.md5(F.when(F.col("flip"), swapped_options(F.col("prompt"))).otherwise(F.col("prompt"))).alias("prompt_hash"))


def rebalance_three(spark: SparkSession, sf_dir: str):
    """Answers A, B and C of a type made even: surplus answers, in seeded order, take the missing ones' slots in order."""
    items = _items(spark, sf_dir).where("kind = 'llava_mcq' and answer in ('A', 'B', 'C')").select("pos", "answer", "h")
    letters = spark.createDataFrame([("A",), ("B",), ("C",)], "answer string")
    counts = letters.join(Q.group_counts(items, ["answer"]), "answer", "left").fillna(0, ["n"])
    everything = W.partitionBy(F.lit(0))
    counts = counts.withColumn("share", F.floor(F.sum("n").over(everything) / 3)).withColumn("gap", F.col("n") - F.col("share"))
    # One row per letter; a remainder of one or two stays where it is.
    before = F.coalesce(F.sum(F.greatest(F.lit(0), -F.col("gap"))).over(everything.orderBy("answer").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = counts.where("gap < 0").select(F.col("answer").alias("new"), before.alias("lo"), (before - F.col("gap")).alias("hi"))
    moved = Q.take(items, counts.select("answer", F.greatest(F.lit(0), F.col("gap")).alias("quota")), ["answer"], "h", "pos").withColumn("one", F.lit(1))
    placed = Q.numbered(moved, ["one"], "h", "pos").join(F.broadcast(slots), (F.col("rn") > F.col("lo")) & (F.col("rn") <= F.col("hi")), "left").select("pos", "new")
    return items.join(placed, "pos", "left").select("pos", "answer", F.coalesce("new", "answer").alias("new_answer"))


def alternate(spark: SparkSession, sf_dir: str):
    """Sides dealt out in turn by the content's own hash, so the input's order doesn't matter; repeated contents share a side."""
    items = table(spark, sf_dir, "records").select("pos", F.md5(F.concat_ws("|", F.coalesce("prompt", F.lit("")), F.coalesce("answer", F.lit("")))).alias("id"))
    contents = items.select("id").distinct().withColumn("h", F.conv(F.substring("id", 1, 15), 16, 10).cast("long")).withColumn("one", F.lit(1))
    return items.join(Q.numbered(contents, ["one"], "h", "id").select("id", "rn"), "id").select("pos", (F.col("rn") % 2).alias("side"))


def batch_order(spark: SparkSession, sf_dir: str):
    """Task-pure batches of 16 by fractional stride: each task's batches spread evenly over the epoch."""
    counts = Q.group_counts(_items(spark, sf_dir), ["kind"]).select("kind", F.floor(F.col("n") / 16).cast("long").alias("batches"))
    return Q.interleaved(counts, "kind", "batches", "i1").select("kind", "batch", (F.floor(F.col("place") * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).alias("place"))


def remax(spark: SparkSession, sf_dir: str):
    """Rewards less a baseline given from outside: that of the group's earliest log line, which stands for the greedy reply."""
    ok = table(spark, sf_dir, "rollouts").where("reward is not null and not isnan(reward) and uid is not null")
    base = ok.groupBy("uid").agg(F.min_by("reward", "row_id").alias("base"))
    return ok.join(base, "uid").select("row_id", (F.floor((F.col("reward") - F.col("base")) * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).alias("advantage"))


def quota_overflow(spark: SparkSession, sf_dir: str):
    """400 documents, evenly over the sources, what small ones lack from the largest first."""
    d = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", Q.order_hash("s2", "doc_id").alias("h"))
    return Q.take(d, Q.even_quotas(Q.group_counts(d, ["source"]), [], "source", F.lit(400)), ["source"], "h", "doc_id").select("doc_id", "source")


def round_robin_domains(spark: SparkSession, sf_dir: str):
    """120 records, one of each type in turn."""
    items = _items(spark, sf_dir).where("kind <> 'unknown'").select("pos", "kind", "h")
    # No type can give more than the target, so only the first of each are numbered.
    first = Q.take(items, items.select("kind").distinct().withColumn("quota", F.lit(120)), ["kind"], "h", "pos")
    return Q.numbered(first, ["kind"], "h", "pos").orderBy("rn", "kind").limit(120).select("pos", "kind")


def largest_class(spark: SparkSession, sf_dir: str):
    """Only the largest type is halved, by taking its domains in turn."""
    items = _items(spark, sf_dir).where("kind <> 'unknown'").select("pos", "kind", "l1", "h")
    largest = Q.group_counts(items, ["kind"]).orderBy(F.desc("n"), "kind").limit(1).select("kind", F.floor(F.col("n") / 2).alias("half"))
    inside = Q.numbered(items.join(F.broadcast(largest), "kind"), ["l1"], "h", "pos")
    kept = positions(inside, [F.col("rn"), F.col("l1"), F.col("pos")]).where("position < half").select("pos", "kind")
    return items.join(F.broadcast(largest), "kind", "left_anti").select("pos", "kind").unionByName(kept)


def split_coverage(spark: SparkSession, sf_dir: str, ratio: float = 0.1):
    """A tenth of all records for validation: one of each type of two rows or more first, the rest where most is lacking; no type is emptied."""
    items = _items(spark, sf_dir).select("pos", "kind", "h")
    everything = W.partitionBy(F.lit(0))
    c = Q.group_counts(items, ["kind"]).withColumn("all", F.sum("n").over(everything))
    c = c.withColumn("target", F.least(F.floor(F.col("all") * F.lit(ratio)), F.greatest(F.col("all") - 1, F.lit(0)))).withColumn("target", F.when((F.col("target") == 0) & (F.col("all") > 1), 1).otherwise(F.col("target")))
    seed = F.md5(F.concat(F.lit("c2:"), "kind"))
    order = F.row_number().over(everything.orderBy(F.when(F.col("n") >= 2, 0).otherwise(1), seed))
    c = c.withColumn("one", ((F.col("n") >= 2) & (order <= F.col("target"))).cast("long"))
    c = c.withColumn("left", F.col("target") - F.sum("one").over(everything)).withColumn("room", F.greatest(F.lit(0).cast("long"), F.col("n") - 1 - F.col("one")))
    before = F.coalesce(F.sum("room").over(everything.orderBy(F.desc(F.col("n") * F.lit(ratio) - F.col("one")), seed).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quotas = c.withColumn("quota", F.col("one") + F.greatest(F.lit(0).cast("long"), F.least(F.col("room"), F.col("left") - before)))
    val = Q.take(items, quotas, ["kind"], "h", "pos").select("pos", F.lit("val").alias("side"))
    return items.join(val, "pos", "left").select("pos", F.coalesce("side", F.lit("train")).alias("side"))


def cap_per_group(spark: SparkSession, sf_dir: str):
    """The 20 longest documents of each source, and all of two that are exempt."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))
    ranks = Q.group_counts(d, ["source"]).select("source", F.greatest(F.lit(0).cast("long"), F.col("n") - 20).alias("rank"))
    # Only rows as long as the twentieth are ranked.
    level = values_at_ranks(d, ["source"], "n_chars", ranks).select("source", F.col("value").alias("least"))
    near = d.join(level, "source").where("n_chars >= least or source in ('run_log', 'subtitle_fix')")
    exempt = F.col("source").isin("run_log", "subtitle_fix")
    capped = near.where(~exempt).withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("rn <= 20")
    return capped.select("doc_id", "source").unionByName(near.where(exempt).select("doc_id", "source"))


QUERIES = {
    f.__name__: f
    for f in (
        quota_overflow, round_robin_domains, largest_class, split_coverage, cap_per_group, stratified, nested_stratified, two_level_balance, small_whole_quota, cell_downsample, shortfall_balance, type_nested_balance, shuffle_split, val_top_up, rebalance_binary, rebalance_three,
        alternate, batch_order, remax,
    )
}

_I = """j as (select *, case when json_valid(metadata) then metadata::json end as m from records), i as (select pos, prompt, answer, coalesce(problem_type, 'unknown') as kind, coalesce(lower(trim(m->>'$.domain_l1')), 'unknown') as l1, coalesce(lower(trim(m->>'$.domain_l2')), 'unknown') as l2,
coalesce(try_cast(m->>'$.output_count' as int), 0) as outputs, left(md5('s1:' || pos), 15) as h from j)"""


def _prop(name: str, source: str, parent: str, key: str, target: str) -> str:
    """A CTE ``name`` of ``source(parent, key, n)`` with ``quota`` in proportion."""
    p = f"partition by {parent}" if parent else ""
    return f"""{name}_a as (select *, sum(n) over ({p}) as al, cast({target} as bigint) as tt, {key} = max({key}) over ({p}) as la from {source}), {name}_b as (select *, least(cast(round_even(tt * n / al, 0) as bigint), n) as sh from {name}_a),
{name} as (select *, case when al <= tt then n when la then greatest(0, least(tt - coalesce(sum(case when not la then sh end) over ({p}), 0), n)) else sh end as quota from {name}_b)"""


def _even(name: str, source: str, parent: str, key: str, target: str) -> str:
    p = f"partition by {parent}" if parent else ""
    return f"""{name}_a as (select *, cast({target} as bigint) as tt, count(*) over ({p}) as g, row_number() over ({p} order by n desc, {key}) as k from {source}), {name}_b as (select *, least(n, tt // g + case when k <= tt % g then 1 else 0 end) as base from {name}_a),
{name}_c as (select *, tt - sum(base) over ({p}) as ov, coalesce(sum(n - base) over ({p} order by n desc, {key} rows between unbounded preceding and 1 preceding), 0) as bf from {name}_b), {name} as (select *, base + greatest(0, least(n - base, ov - bf)) as quota from {name}_c)"""


def _small(name: str, source: str, parent: str, key: str, target: str) -> str:
    p = f"partition by {parent}" if parent else ""
    return f"""{name}_a as (select *, cast({target} as bigint) as tt, sum(n) over ({p}) as al, count(*) over ({p}) as g from {source}), {name}_b as (select *, n <= tt // g as sm from {name}_a),
{name}_c as (select *, tt - coalesce(sum(case when sm then n end) over ({p}), 0) as rest, sum(case when sm then 0 else 1 end) over ({p}) as lg, row_number() over ({p} order by sm, n desc, {key}) as k from {name}_b),
{name} as (select *, case when al <= tt or sm then n else least(n, rest // lg + case when k <= rest % lg then 1 else 0 end) end as quota from {name}_c)"""


def _ranked(keys: str, quotas: str, columns: str, order: str = "h, pos", source: str = "i") -> str:
    return f"select {columns} from (select a.*, q.quota, row_number() over (partition by {keys} order by {order}) as rn from {source} a join {quotas} q using ({keys})) z where rn <= quota"


_KC, _DC, _DD = "kc as (select kind, count(*) as n from i group by all)", "dc as (select l1, count(*) as n from i group by all)", "dd as (select l1, l2, count(*) as n from i group by all)"
_KL = "kl as (select kind, l1, count(*) as n from i group by all)"
_R9 = "floor(({}) * 1e9 + 0.5e0) / 1e9"
SQL = {
    "quota_overflow": f"with i as (select doc_id, source, left(md5('s2:' || doc_id), 15) as h from documents where source is not null), dc as (select source, count(*) as n from i group by all), {_even('q', 'dc', '', 'source', '400')} " + _ranked("source", "q", "doc_id, source", "h, doc_id"),
    "round_robin_domains": f"with {_I} select pos, kind from (select pos, kind, row_number() over (partition by kind order by h, pos) as rn from i where kind <> 'unknown') t order by rn, kind limit 120",
    "largest_class": f"""with {_I}, {_KC}, b as (select kind, n // 2 as half from kc where kind <> 'unknown' order by n desc, kind limit 1), r as (select i.*, row_number() over (partition by kind, l1 order by h, pos) as rn from i where kind <> 'unknown'),
s as (select *, row_number() over (partition by kind order by rn, l1, pos) as k from r) select pos, kind from s where kind <> (select kind from b) or k <= (select half from b)""",
    "split_coverage": f"""with {_I}, {_KC}, a as (select kind, n, sum(n) over () as al, md5('c2:' || kind) as sd from kc), t as (select *, case when floor(al * 0.1e0) = 0 and al > 1 then 1 else least(floor(al * 0.1e0), greatest(al - 1, 0)) end as target from a),
o as (select *, case when n >= 2 and row_number() over (order by case when n >= 2 then 0 else 1 end, sd) <= target then 1 else 0 end as one from t), r as (select *, target - sum(one) over () as lf, greatest(0, n - 1 - one) as room from o),
q as (select kind, one + greatest(0, least(room, lf - coalesce(sum(room) over (order by n * 0.1e0 - one desc, sd rows between unbounded preceding and 1 preceding), 0))) as quota from r)
select pos, case when row_number() over (partition by i.kind order by h, pos) <= quota then 'val' else 'train' end as side from i join q using (kind)""",
    "cap_per_group": "select doc_id, coalesce(source, '') as source from (select doc_id, source, row_number() over (partition by source order by coalesce(n_chars, -1) desc, doc_id) as rn from documents) t where rn <= 20 or source in ('run_log', 'subtitle_fix')",
    "stratified": f"with {_I}, {_KC}, {_prop('q', 'kc', '', 'kind', '200')} " + _ranked("kind", "q", "pos, kind"),
    "nested_stratified": f"""with {_I}, {_KC}, {_prop('q', 'kc', '', 'kind', '300')}, {_KL}, kt as (select kl.*, q.quota as t from kl join q using (kind)), {_prop('f', 'kt', 'kind', 'l1', 't')},
tk as (select kind, sum(quota) as took, sum(n) as n from f group by all), la as (select kind, least(n, 300 - (select sum(took) from tk) + took) as t from tk where kind = (select max(kind) from tk)),
lt as (select kl.*, la.t from kl join la using (kind)), {_prop('g', 'lt', 'kind', 'l1', 't')}, u as (select kind, l1, quota from f where kind not in (select kind from la) union all select kind, l1, quota from g) """ + _ranked("kind, l1", "u", "pos, kind, l1"),
    "two_level_balance": f"with {_I}, {_DC}, {_even('q', 'dc', '', 'l1', '400')}, {_DD}, dt as (select dd.*, q.quota as t from dd join q using (l1)), {_even('f', 'dt', 'l1', 'l2', 't')} " + _ranked("l1, l2", "f", "pos, l1, l2", "outputs desc, h, pos"),
    "small_whole_quota": f"with {_I}, {_DC}, {_small('q', 'dc', '', 'l1', '350')}, {_DD}, dt as (select dd.*, q.quota as t from dd join q using (l1)), {_small('f', 'dt', 'l1', 'l2', 't')} " + _ranked("l1, l2", "f", "pos, l1, l2"),
    "cell_downsample": f"""with {_I}, {_KL}, a as (select *, greatest(1, 500 // count(*) over ()) as per, count(*) over () as c from kl), b as (select *, least(n, per) as base, 500 - per * c as lf from a),
f as (select kind, l1, base + greatest(0, least(n - base, lf - coalesce(sum(n - base) over (order by md5('c1:' || kind || ':' || l1) rows between unbounded preceding and 1 preceding), 0))) as quota from b) """ + _ranked("kind, l1", "f", "pos, kind, l1"),
    "shortfall_balance": f"""with {_I}, {_DD}, t as (select l1, sum(n) as n, count(*) as subs, 330 // count(*) over () as base, count(*) over () as g from dd group by l1), w as (select *, n <= base as whole from t),
m as (select *, (coalesce(sum(case when whole then base - n end) over (), 0) + 330 - base * g) // greatest(1, sum(case when whole then 0 else 1 end) over ()) as more from w),
r as (select i.pos, i.l1, i.l2, h, whole, more, case when whole then true else row_number() over (partition by i.l1, i.l2 order by h, pos) <= base // subs end as a from i join m using (l1)),
s as (select *, row_number() over (partition by l1, a order by h, pos) as rn from r) select pos, l1, l2 from s where a or (not whole and rn <= more)""",
    "type_nested_balance": f"""with {_I}, {_KL}, k as (select kind, sum(n) as n, count(*) as subs, greatest(1, 240 // count(*) over ()) as per from kl group by kind), e as (select *, n <= per as whole, greatest(1, per // subs) as each from k),
a as (select pos, i.kind, h, whole, per, each, subs, whole or row_number() over (partition by i.kind, l1 order by h, pos) <= each as x from i join e using (kind)),
b as (select *, row_number() over (partition by kind, x order by h, pos) as rn from a), c as (select *, x or (not whole and rn <= per - each * subs) as y from b), d as (select *, row_number() over (partition by kind, y order by h, pos) as r2 from c),
f as (select *, y and r2 <= per as z from d), g as (select *, row_number() over (partition by z order by h, pos) as r3 from f) select pos, kind from g where z or r3 <= 240 - (select sum(per) from k)""",
    "shuffle_split": f"with {_I} select pos, case when rn <= 100 then 'val' else 'train' end as side from (select pos, row_number() over (order by h, pos) as rn from i) t where rn <= 1100",
    "val_top_up": f"""with v as (select pos, prompt from records where data_file = 'data/logic/val.jsonl'), i as (select pos, coalesce(problem_type, 'unknown') as kind, left(md5('v1:' || pos), 15) as h from records r where data_file like 'data/logic/train/%' and not exists (select 1 from v where v.prompt = r.prompt)), {_KC},
{_prop('q', 'kc', '', 'kind', 'greatest(0, 60 - (select count(*) from v))')} select pos, 'val' as origin from v union all """ + _ranked("kind", "q", "pos, 'train' as origin"),
    "rebalance_binary": f"""with {_I}, b as (select * from i where kind = 'seg_aot_event_dir_binary' and answer in ('A', 'B')), c as (select l1, sum(case when answer = 'A' then 1 else -1 end) as d from b group by all),
r as (select b.*, d, row_number() over (partition by b.l1, answer order by h, pos) as rn from b join c using (l1)), f as (select *, answer = case when d >= 0 then 'A' else 'B' end and rn <= abs(d) // 2 as flip from r)
select pos, l1, flip, case when flip then translate(answer, 'AB', 'BA') else answer end as new_answer, md5(case when flip then regexp_replace(prompt, '(?m)^(\\(?A[.)])([^\\n]*)\\n(\\(?B[.)])([^\\n]*)$', '\\1\\4' || chr(10) || '\\3\\2', 'g') else prompt end) as prompt_hash from f""",
    "rebalance_three": f"""with {_I}, b as (select pos, answer, h from i where kind = 'llava_mcq' and answer in ('A', 'B', 'C')), c as (select l as answer, (select count(*) from b where answer = l) as n, (select count(*) from b) // 3 as s from (values ('A'), ('B'), ('C')) as v(l)),
d as (select answer, n - s as gap, coalesce(sum(greatest(0, s - n)) over (order by answer rows between unbounded preceding and 1 preceding), 0) as lo from c), r as (select b.*, gap, row_number() over (partition by b.answer order by h, pos) as rn from b join d using (answer)),
m as (select pos, row_number() over (order by h, pos) as k from r where rn <= gap) select b.pos, b.answer, coalesce(d.answer, b.answer) as new_answer from b left join m using (pos) left join d on gap < 0 and k > lo and k <= lo - gap""",
    "alternate": "with i as (select pos, md5(coalesce(prompt, '') || '|' || coalesce(answer, '')) as id from records) select pos, dense_rank() over (order by id) % 2 as side from i",
    "batch_order": f"with {_I}, c as (select kind, count(*) // 16 as b from i group by all), e as (select kind, b, unnest(range(0, b)) as batch from c) select kind, batch, {_R9.format('''(batch + ('0x' || left(md5('i1:' || kind || ':' || batch), 8))::bigint / 4294967296e0 * 0.5e0) / b''')} as place from e",
    "remax": f"with ok as (select * from rollouts where reward is not null and not isnan(reward) and uid is not null) select row_id, {_R9.format('reward - first_value(reward) over (partition by uid order by row_id)')} as advantage from ok",
}
