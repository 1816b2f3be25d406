"""Pair defects whose rules must not depend on length, lines or the look of an ending."""

from pyspark.sql import functions as F

from cinderloom.llm.pairs import broken_pairs, sentence_ends

SCHEMA = "field_name string, row_key long, problem_type string, question string, prompt string, text string, extra int"


def found(spark, rows):
    df = spark.createDataFrame([("response", i, t, q, p, x, 0) for i, (t, q, p, x) in enumerate(rows)], SCHEMA)
    return {r.row_key: r.defect for r in broken_pairs(df).collect()}


def test_copies_at_any_length(spark):
    rows = []
    for n in (390, 410, 3000):
        q = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(n)]
        changed = ["other" if i % 12 == 5 else w for i, w in enumerate(q)]
        rows.append(("open_ended", " ".join(q) + "?", None, " ".join(changed)))
    assert found(spark, rows) == {0: "copy", 1: "copy", 2: "copy"}


def test_question_of_several_lines(spark):
    p = "<video>\nLook at the clip of the kitchen.\nWhat does the cook do with the red pan?\nOptions:\nA. One\nB. Two\nAnswer with one letter inside <answer> tags."
    rows = [
        ("open_ended", None, p, "What does the cook do with the red pan?"),
        ("open_ended", None, p, "Look at the clip of the kitchen. What does the cook do with the red pan?"),
        ("open_ended", None, p, "The cook washes the red pan in the sink and dries it."),
    ]
    assert found(spark, rows) == {0: "copy", 1: "copy"}


def test_lone_numbers(spark):
    rows = [("temporal_grounding", "When does it happen?", None, x) for x in ("12", "12.5", "<answer>12</answer>", "12 - 15 seconds")] + [("llava_mcq", "How many are there?", None, "12")]
    assert found(spark, rows) == {0: "truncated", 1: "truncated", 2: "truncated"}


def test_refusals_are_judged_as_a_whole(spark):
    q = "What does the cook do with the red pan in this clip?"
    rows = [
        ("open_ended", q, None, x)
        for x in (
            "Unfortunately this request is one that I have to turn down.", "Providing an answer here would be inappropriate.", "I can't see the lid, but the cook puts the red pan in the sink and rinses it.",
            "I cannot watch the clip. If you paste a transcript, I can try again.", "I can't view videos, but if you describe the clip I can try.", "وضع الطباخ المقلاة الحمراء في الحوض ثم غسلها بالماء.",
        )
    ]
    assert found(spark, rows) == {0: "refusal", 1: "refusal", 3: "refusal", 4: "refusal", 5: "other_language"}


def test_endings_are_those_of_other_sentences(spark):
    q = "What does the cook do with the red pan in this clip?"
    rows = [("open_ended", q, None, x) for x in ("The cook rinses it quickly.", "The baker dries it in the sink.", "The cook lifts the pan quickly", "<answer>The cook lifts the pan in the sink</answer>", "The cook lifts the", "The cook lifts the pan quic")]
    assert found(spark, rows) == {4: "truncated", 5: "truncated"}
    df = spark.createDataFrame([("One goes home. Two goes in. A. 切开小球。",), ("open end",), (None,), ("",)], "text string")
    assert {r.word for r in sentence_ends(df).collect()} == {"home", "球"}
    assert sentence_ends(df.limit(0)).count() == 0
    assert {r.word for r in sentence_ends(df.unionByName(df), 0.6).select(F.col("word")).collect()} == set()
