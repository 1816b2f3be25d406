"""Overlap by classes equals the expanded pairs; edits of long questions; samples and mixes hold what they promise."""

import random

from pyspark.sql import functions as F

from cinderloom.llm.mixing import leaf_budgets, mix_shares, mix_sources
from cinderloom.llm.overlap import overlap_classes, overlap_counts, split_overlaps, word_edits
from cinderloom.llm.queries import QUERIES
from cinderloom.llm.sampling import acceptance, category_candidates, proportional_sample
from cinderloom.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_counts_from_classes(spark):
    records, configs = table(spark, SF, "records"), table(spark, SF, "data_config")
    pairs = split_overlaps(records, configs)
    sources = records.select(F.col("pos").alias("eval_pos"), F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), "$.source", "string"), F.lit("unknown")).alias("source"))
    want = pairs.join(sources, "eval_pos").groupBy("eval_file", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_pos").alias("n_eval_records"))
    got = overlap_counts(records.withColumn("video", F.lit(1)), configs, F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), "$.source", "string"), F.lit("unknown")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} != set()
    classes = {r.pos: r for r in overlap_classes(records, configs).collect()}
    ends = {r.eval_pos for r in pairs.collect()} | {r.train_pos for r in pairs.collect()}
    assert ends <= set(classes) and all(r.n_links > 0 for r in classes.values())
    linked: dict = {}
    for r in pairs.collect():
        for one, other in ((r.eval_pos, r.train_pos), (r.train_pos, r.eval_pos)):
            linked.setdefault(classes[one].class_id, set()).add(classes[other].class_id)
    assert all(len(linked[r.class_id]) == r.n_links for r in classes.values())
    assert overlap_counts(records.limit(0), configs, F.lit("x")).count() == 0
    assert QUERIES["p4_report"](spark, SF).agg(F.sum("n_pairs")).first()[0] == pairs.count()


def test_edits_of_many_words(spark):
    many = [f"w{i}" for i in range(70_000)]
    changed = many[:100] + ["x"] + many[101:30_000] + many[30_001:] + ["y"]
    df = spark.createDataFrame([(many, changed), (["a", "b"], ["b"]), ([], []), (["a"] * 9, ["b"] * 9), (["a", "b"], ["b", "a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(word_edits(F.col("a"), F.col("b"), 4)).collect()] == [3, 1, 0, -1, 2]


def test_acceptance_filters(spark):
    items = spark.range(20_000).selectExpr("id as item", "id as pos", "'f' as field_name", "case when id % 3 > 0 then 'big' else 'small' end as category")
    targets = spark.createDataFrame([("p", 1000, "f", "big", 0.5, 5), ("p", 1000, "f", "small", 0.5, 5)], "plan_id string, sample_size long, field_name string, category string, target_share double, min_rows long")
    cand = category_candidates(items, targets, 3)
    rates = {r.category: r.accept for r in acceptance(cand, targets).collect()}
    assert 0.5 / 13_333 * 1000 * 1024 < rates["big"] < 60 and rates["big"] < rates["small"] < 110
    few, all_ = ({r.item for r in proportional_sample(cand, targets, x).collect()} for x in (1.1, 1e9))
    assert len(few) == len(all_) == 1000 and few != all_
    inside = {r.item for r in cand.join(spark.createDataFrame(list(rates.items()), "category string, accept double"), "category").where("bucket < accept").collect()}
    assert few <= inside


def test_mix_meets_budgets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abbbccd"), rng.choice(["en", "zh", None]), rng.choice(["x", "y", None]), rng.choice([5, 40, 300])) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (9999, None, "en", "x", 5), (9998, "a", "en", "x", None), (9997, "a", "en", "x", 0)], "doc_id long, source string, lang string, domain string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.2, 1), ("c", 0.2, 4), ("gone", 0.1, 3), ("d", 0.0, 3), ("z", None, 3)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets).cache()
    sizes = {r[0]: r[4] for r in rows}
    assert all(1 <= r.repeats <= {"a": 2, "b": 1, "c": 4}[r.source] and r.n_tokens == sizes[r.doc_id] for r in mix.collect())
    assert mix.count() == mix.select("doc_id").distinct().count()
    budgets = {r[0]: r[1] for r in leaf_budgets(docs.where("n_tokens > 0 and source is not null").fillna("unknown"), targets).groupBy("source").sum("budget").collect()}
    shares = {r.source: r for r in mix_shares(docs, targets, mix).collect()}
    for s, b in budgets.items():
        assert shares[s].chosen_tokens <= b + 1e-3 and abs(shares[s].budget_tokens - b) < 1e-3
        supply = sum(r[4] for r in rows if r[1] == s) * {"a": 2, "b": 1, "c": 4}[s]
        assert b - shares[s].chosen_tokens < 300 or abs(b - supply) < 1e-3
    total = sum(r[4] for r in rows if r[1] in "abc")
    assert abs(sum(budgets.values()) - total) < 1e-3 and shares["gone"].deficit_tokens > 0
    assert mix_sources(docs.limit(0), targets).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x", 10), (2, "b", "en", "x", 1000), (3, "b", "en", "y", 1000), (4, "a", "en", "y", 500)], "doc_id long, source string, lang string, domain string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {(r.domain, r.source): r.budget for r in leaf_budgets(docs, targets, 1000).collect()}
    # Domain x wants 0.9 * 10 / 510 + 0.1 / 2 of 1000 tokens; what source a lacks there is filled by source b in x.
    x = 1000 * (0.9 * 10 / 510 + 0.05)
    assert abs(got["x", "a"] + got["x", "b"] - x) < 1e-6 and got["x", "a"] == 10.0
