"""One criterion for copies at every length."""

import random

from pyspark.sql import functions as F

from cinderloom.llm.pairs import broken_pairs
from cinderloom.llm.text import lcs_length, words


def test_slight_change_is_a_copy_at_any_length(spark):
    rng = random.Random(4)
    rows = []
    for n in (399, 400, 401, 402, 3000):
        q = ["the"] + ["".join(rng.choices("bcdefgkmnoprst", k=6)) for _ in range(n - 1)]
        t = [f"changed{'x' * (i % 7)}" if i % 16 == 9 else w for i, w in enumerate(q)]
        rows.append(("response", n, "open_ended", " ".join(q) + "?", None, " ".join(t) + "."))
    df = spark.createDataFrame(rows, "field_name string, row_key long, problem_type string, question string, prompt string, text string")
    assert {(r.row_key, r.defect) for r in broken_pairs(df).collect()} == {(r[1], "copy") for r in rows}


def brute(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        row = [0] + _next(row, a, y)
    return row[-1]


def _next(row, a, y):
    out, left = [], 0
    for j, b in enumerate(y):
        left = row[j] + 1 if a == b else max(row[j + 1], left)
        out.append(left)
    return out


def test_lcs_against_the_table(spark):
    rng = random.Random(5)
    rows = [(" ".join(rng.choices("abcd", k=rng.randrange(0, 30))), " ".join(rng.choices("abcd", k=rng.randrange(0, 30)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "x string, y string")
    got = df.select("x", "y", lcs_length(words(F.col("x")), words(F.col("y"))).alias("n")).collect()
    assert [r.n for r in got] == [brute(r.x.split(), r.y.split()) for r in got]
