"""Language-model operators against brute force and on dirty fixtures."""

from pyspark.sql import functions as F

from cinderloom.llm.mixing import mix_shares, mix_sources
from cinderloom.llm.overlap import split_overlaps
from cinderloom.llm.packing import pack_texts
from cinderloom.llm.pairs import broken_pairs
from cinderloom.llm.queries import QUERIES, SQL
from cinderloom.llm.residue import residue_documents
from cinderloom.llm.sampling import category_candidates, proportional_sample, sampling_report
from cinderloom.llm.text import lcs_length, words
from cinderloom.llm.tokens import token_counts
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_sampling_oracles(spark):
    con = connect(SF)
    for name in SQL:
        assert compare(spark, con, SF, QUERIES[name], SQL[name]) == "", name


def test_pairs(spark):
    q = "What does the cook do with the red pan after stirring the soup?"
    cases = {
        "A": None, "<think>hm</think>\n<answer></answer>": "empty", "n/a": "empty", None: "empty", "<think>hm</think>\n<answ": "truncated", "<answer>3": "truncated",
        "The cook puts the red pan on the": "truncated", "I'm sorry, but I can't view videos.": "refusal", "The cook says sorry and cannot open the red jar.": None,
        "what does the cook do with the red pan after stirring soup": "copy", q + " The cook washes it in the sink and dries it with a towel.": None,
        "El cocinero lava la olla roja en el patio y la guarda.": "other_language", "The sign reads \"prohibido el paso\" and the cook waits.": None,
        "The cook washes the pan. " * 5000: None,
    }
    rows = [("response", i, "open_ended", q, "<video>\n" + q, t) for i, t in enumerate(cases)]
    schema = "field_name string, row_key long, problem_type string, question string, prompt string, text string"
    df = spark.createDataFrame(rows + [("answer", 99, None, None, None, None)], schema)
    got = {(r.field_name, r.row_key): r.defect for r in broken_pairs(df).collect()}
    want = {("response", i): d for i, d in enumerate(cases.values()) if d} | {("answer", 99): "empty"}
    assert got == want
    assert broken_pairs(df.limit(0)).count() == 0


def test_lcs(spark):
    df = spark.createDataFrame([("a b c d e f", "a x c d y f"), ("", "a"), ("a b", "a b"), ("q", "z")], "x string, y string")
    assert [r[0] for r in df.select(lcs_length(words(F.col("x")), words(F.col("y")))).collect()] == [4, 0, 2, 0]


def test_overlap(spark):
    def meta(k):
        return '{"clip_key": "%s"}' % k

    rows = [
        (1, "t/a", "<video>\nWhat happens after the cook stirs the soup?\nOptions:\nA. One thing\nB. Other thing", meta("Vid1_0_10"), None),
        (2, "v", "<video>what happens right after the cook stirs the soup?\nOptions:\nB) One thing\nA) Other thing\nAnswer with one letter.", meta("clips/vid1_1.0_12.mp4"), None),
        (3, "v", "What happens after the cook stirs the soup?", meta("vid1_0_13"), None),
        (4, "v", "", meta("vid1_0_10"), None), (5, "v", None, None, None), (6, "u", "Hi", "{broken", '["clips/vid2_0_5.mp4"]'), (7, "t/a", "hi!", None, '[["f/vid2_0_5/1.jpg"]]'),
        (8, "v", "Hi", meta("vid2_0_5"), None), (9, "v", "Hi", meta("vid2_0_5"), None),
    ]
    records = spark.createDataFrame(rows, "pos long, data_file string, prompt string, metadata string, videos string")
    configs = spark.createDataFrame([("c", " t/ ,", "v", "x"), ("d", None, "", "x")], "config_name string, train_files string, val_files string, created_on string")
    assert {(r.eval_pos, r.train_pos) for r in split_overlaps(records, configs).collect()} == {(2, 1), (8, 7), (9, 7)}
    assert split_overlaps(records.limit(0), configs).count() == 0


def test_sample_counts(spark):
    items = spark.range(2000).selectExpr("id % 900 as item", "id as pos", "'f' as field_name", "case when id % 900 < 700 then ' Big ' else 'sm-all' end as category")
    targets = spark.createDataFrame([("p", 300, "f", "big", 0.5, 5), ("p", 300, "f", "Sm All", 0.9, 5), ("p", 300, "f", "none", 0.1, 5)], "plan_id string, sample_size long, field_name string, category string, target_share double, min_rows long")
    cand = category_candidates(items, targets, 3)
    got = {r.category: r["count"] for r in proportional_sample(cand, targets).groupBy("category").count().collect()}
    assert got == {"big": 150, "sm_all": 200}
    assert {r.category: r.deficit for r in sampling_report(cand, targets).collect()} == {"big": 0, "sm_all": 70, "none": 30}


def test_packing(spark):
    docs = spark.createDataFrame([(i, "word " * n, "x") for i, n in enumerate([3, 900, 0, 50, 51, 120] * 20)] + [(999, None, "y")], "doc_id long, text string, piece string")
    plans = spark.createDataFrame([("p", 100), ("q", 1000), ("bad", None)], "plan_id string, capacity_tokens long")
    sizes = token_counts(docs)
    packed = pack_texts(sizes, plans, windows=4, partitions=3).cache()
    fill = packed.groupBy("plan_id", "container").agg(F.sum("n_tokens").alias("n")).toPandas()
    assert (fill[fill.plan_id == "p"].n <= 100).all() and (fill[fill.plan_id == "q"].n <= 1000).all()
    back = packed.groupBy("plan_id", "doc_id").agg(F.sum("n_tokens").alias("n_tokens")).join(sizes, ["doc_id", "n_tokens"])
    assert back.count() == 2 * sizes.where("n_tokens > 0").count()
    pieces = {r.doc_id for r in packed.where("piece = 2 and plan_id = 'q'").collect()}
    assert pieces == {r.doc_id for r in sizes.where("n_tokens > 1000").collect()}


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "en" if i % 2 else None, None, 10 + i % 7) for i in range(900)], "doc_id long, source string, lang string, domain string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets, total_tokens=6000)
    share = {r.source: r for r in mix_shares(docs, targets, mix).collect()}
    assert abs(share["a"].actual_share - 0.5) < 0.02 and share["gone"].chosen_tokens == 0
    assert mix.agg(F.max("repeats")).first()[0] <= 2


def test_residue(spark):
    texts = {
        1: "The cook stirs {object} slowly.", 2: "The template `{object}` is filled once.", 3: "```\ntext = f\"{title}\"\n```", 4: "404 Not Found", 5: "The slide says 404 Not Found is common.",
        6: "Please enable JavaScript to continue.", 7: "The assistant enables JavaScript again.", 8: "Lorem ipsum dolor sit amet magna.", 9: "", 10: None, 11: "A clean text. " * 3000, 12: "<video> and <think> stay.",
        13: "PAGE NOT FOUND.", 14: "See [INSERT NAME HERE] for more.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in residue_documents(df).collect()} == {1, 4, 6, 8, 13, 14}
    assert residue_documents(df.limit(0)).count() == 0
