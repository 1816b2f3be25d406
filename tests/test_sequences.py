"""Folds and matchings against brute force."""

import random
from itertools import permutations

from pyspark.sql import functions as F

from cinderloom.operators import sequences as S


def iou(a, b):
    inter = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    union = a[1] - a[0] + b[1] - b[0] - inter
    return inter / union if union > 0 else 0.0


def best(a, b):
    if len(a) > len(b):
        a, b = b, a
    return max((sum(iou(x, y) for x, y in zip(a, p)) for p in permutations(b, len(a))), default=0.0)


def test_matchings(spark):
    rng = random.Random(3)
    seg = lambda: [s := rng.randrange(0, 30) / 2, s + rng.randrange(1, 20) / 2]
    rows = [(i, [seg() for _ in range(rng.randrange(0, 5))], [seg() for _ in range(rng.randrange(0, 6))]) for i in range(60)]
    df = spark.createDataFrame(rows + [(99, None, None)], "i int, a array<array<double>>, b array<array<double>>")
    df = df.select("i", S.sound_segments(F.col("a")).alias("a"), S.sound_segments(F.col("b")).alias("b"))
    got = {r.i: r for r in df.select("i", S.best_assignment_sum(F.col("a"), F.col("b")).alias("best"), S.ordered_match(F.col("a"), F.col("b")).alias("dp"), S.suppressed(F.col("a")).alias("kept")).collect()}
    for i, a, b in rows:
        assert abs(got[i].best - best(a, b)) < 1e-9
        assert got[i].dp <= got[i].best + 1e-9
        assert all(iou(x, y) < 0.7 for k, x in enumerate(got[i].kept) for y in got[i].kept[k + 1 :])
    assert got[99].best == 0.0 and got[99].dp == 0.0


def test_folds(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [])], "i int, x array<double>")
    got = {r.i: r for r in df.select("i", S.discounted(F.col("x"), 0.5).alias("d"), S.smoothed(F.col("x"), 0.5).alias("s")).collect()}
    assert got[1].d == [3.0, 4.0, 4.0] and got[1].s == [1.0, 1.5, 2.75] and got[2].d == [] == got[2].s


def test_balanced(spark):
    df = spark.range(40).selectExpr("id", "id * 7 % 31 as n", "1 as k")
    sums = [r.s for r in S.length_balanced(df, ["k"], "id", "n", 4).groupBy("part").agg(F.sum("n").alias("s")).collect()]
    assert len(sums) == 4 and max(sums) - min(sums) <= 5
