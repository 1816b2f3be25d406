"""Interval joins against all pairs, and batches within a budget."""

import random

from cinderloom.operators import sequences as S
from cinderloom.operators import spans as X


def made(spark, seed, n, alias):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + ["b", None]), i, s := float(rng.randrange(0, 300)), s + rng.randrange(1, 90)) for i in range(n)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], f"v string, {alias} long, s double, e double, slice string")


def test_overlaps_and_neighbours(spark):
    left, dl = made(spark, 1, 150, "a")
    right, dr = made(spark, 2, 60, "b")
    dl, dr = dl.drop("slice"), dr.drop("slice")
    want = {(a, b): min(e, f) - max(s, t) for v, a, s, e in left for w, b, t, f in right if v == w and v is not None and s < f and t < e}
    got = [(r.a, r.b, r.overlap) for r in X.overlapping(dl, dr, "v", 30.0).collect()]
    assert len(got) == len(want) and {(a, b): o for a, b, o in got} == want
    near = {r.a: (r.dist, r.b) for r in X.nearest(dl.where("v is not null"), dr.where("v is not null"), "v").collect()}
    best = {a: min((min(abs(s - t), abs(e - f)), b) for w, b, t, f in right if w == v) for v, a, s, e in left if v is not None and any(w == v for w, *_ in right)}
    assert near == best
    assert X.overlapping(dl.limit(0), dr, "v").count() == 0 and X.nearest(dl, dr.limit(0), "v").count() == 0


def test_budgets(spark):
    rng = random.Random(3)
    rows = [("g", i, rng.choice([0, 5, 40, 300])) for i in range(200)] + [("one", 1000, 7), (None, 1001, 9)]
    got = S.budgeted_batches(spark.createDataFrame(rows, "k string, id long, n int"), ["k"], "id", "n", 1000).collect()
    assert sorted(r.id for r in got) == sorted(r[1] for r in rows)
    total = sum(r[2] for r in rows if r[0] == "g")
    sums, squares = {}, {}
    for r in got:
        if r.k == "g":
            sums[r.part] = sums.get(r.part, 0) + r.n
            squares[r.part] = squares.get(r.part, 0) + r.n * r.n
    assert len(sums) == -(-total // 1000) and max(sums.values()) - min(sums.values()) <= 300
    assert [squares[p] for p in sorted(squares)] == sorted(squares.values(), reverse=True)
