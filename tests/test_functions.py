"""Functions and operators on dirty fixtures: nulls, empties, ties, repeats, clashing names; matchings against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cinderloom.functions import building as B
from cinderloom.functions import intervals as I
from cinderloom.functions import parsing as P
from cinderloom.functions import registry as R
from cinderloom.functions import tokens as T
from cinderloom.operators import batches as N
from cinderloom.operators import lookups as L
from cinderloom.operators import quotas as Q
from cinderloom.operators import sequences as S
from cinderloom.plans.intervals import mixed_rewards, segmentation_rewards
from cinderloom.sinks import files as K
from cinderloom.sources import files as SF


def column(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_replies(spark):
    texts = [(x,) for x in (None, "", "<events>[[1, 2.5], [3, 3], [.5, 9]] [0, 1]</events> [4, 5]", "no tag [1, 2]", "<events>[1,2]")]
    got = column(spark, texts, "t string", P.segments(F.col("t")))
    assert [[(x.k, x.s, x.e) for x in r] for r in got] == [[], [], [(1, 1.0, 2.5), (3, 0.5, 9.0), (4, 0.0, 1.0)], [], []]
    assert [len(r) for r in column(spark, texts, "t string", P.segments(F.col("t"), False, F.lit(2.0)))] == [0, 0, 1, 1, 1]
    assert column(spark, [("a",), (None,), ("[1-2]",), ("<answer>x</answer><answer>",)], "t string", P.is_hacked(F.col("t"))) == [False, False, True, True]
    assert column(spark, [("7:05",), ("1:02:03.5",), ("x",), (None,), ("7:5:1:2",)], "t string", P.clock_seconds(F.col("t"))) == [425.0, 3723.5, None, None, None]
    assert column(spark, [(5.0,), (59.9,), (6000.0,), (None,), (-3.0,)], "x double", P.clock_text(F.col("x"))) == ["00:05", "00:59", "100:00", None, "00:00"]
    assert column(spark, [(10.0,), (10.5,), (0.25,), (100.0,), (None,)], "x double", P.seconds_text(F.col("x")))[:4] == ["10", "10.5", "0.25", "100"]
    assert column(spark, [("Q\nA. x\nB) y\nA. z",), (None,), ("none",)], "t string", P.options(F.col("t"))) == [{"A": "z", "B": "y"}, {}, {}]
    assert column(spark, [("Q\nA. x\nB. y",), (None,)], "t string", P.swapped_options(F.col("t"))) == ["Q\nA. y\nB. x", ""]
    assert [r and tuple(r) for r in column(spark, [("Event 3",), ("action 4.2",), ("thing 1",), (None,)], "t string", P.item_id(F.col("t")))] == [("event", 3, None), ("action", 4, 2), None, None]
    assert column(spark, [("So far: a; ____; c. Which?",), ("So far: a; b. Which?",), (None,)], "t string", P.missing_step(F.col("t"))) == [2, None, None]
    parts = column(spark, [("<video>a<image>b",), ("<video>",), (None,)], "t string", P.content_parts(F.col("t")))
    assert [[(x.type, x.text) for x in r] for r in parts] == [[("video", None), ("text", "a"), ("image", None), ("text", "b")], [("video", None)], []]
    assert column(spark, [('x {"a": {"b": 1}} y',), ("```json\n{\"a\": 2}\n```",), ("{broken",), (None,)], "t string", P.embedded_json(F.col("t"))) == ['{"a": {"b": 1}}', '{"a": 2}', None, None]


def test_frames_and_clips(spark):
    for n, k in itertools.product((0, 1, 5, 9, 100), (0, 1, 2, 4, 9)):
        got = column(spark, [(n, k)], "n int, k int", I.uniform_indices(F.col("n"), F.col("k")))[0]
        want = [] if n <= 0 or k <= 0 else list(range(n)) if k >= n else [0] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
        assert got == want, (n, k)
    windows = column(spark, [(0,), (31,), (32,), (128,), (140,), (300,)], "d int", I.sliding_windows(F.col("d")))
    assert windows == [[], [], [[0, 32]], [[0, 128]], [[0, 128], [64, 140]], [[0, 128], [64, 192], [128, 256], [192, 300]]]
    assert I.parse_policy("0:60:2, 60:inf:1") == [(0.0, 60.0, 2.0), (60.0, float("inf"), 1.0)]
    with pytest.raises(ValueError):
        I.parse_policy("9:1:2")
    assert column(spark, [(0.0,), (60.0,), (61.0,), (None,)], "d double", I.policy_fps(F.col("d"), I.parse_policy("0:60:2,60:inf:1"))) == [2.0, 2.0, 1.0, None]
    assert column(spark, [([3.0, 1.0, 3.0, 9.0, -1.0], 5.0), ([], 2.0)], "b array<double>, d double", I.boundary_segments(F.col("b"), F.col("d"))) == [[[0.0, 1.0], [1.0, 3.0], [3.0, 5.0]], [[0.0, 2.0]]]
    assert column(spark, [([[0.0, 2.0], [1.0, 3.0], [3.0, 4.0], [6.0, 7.0]],), ([],)], "a array<array<double>>", I.merged(F.col("a"))) == [[[0.0, 4.0], [6.0, 7.0]], []]
    assert [tuple(r) for r in column(spark, [(50, 90), (2, 9)], "s int, e int", I.padded_bounds(F.col("s"), F.col("e"), 5, 40, F.lit(100)))] == [(50, 90), (0, 14)]


def _best(a, b, score):
    rows, cols = (a, b) if len(a) <= len(b) else (b, a)
    turn = len(a) > len(b)
    return max((sum(score(c, r) if turn else score(r, c) for r, c in zip(rows, p)) for p in itertools.permutations(cols, len(rows))), default=0.0)


def test_general_matching_against_brute_force(spark):
    rng = random.Random(2)

    def seg():
        s = rng.randrange(0, 40)
        return [float(s), float(s + rng.randrange(1, 15))]

    def ngiou(a, b):
        inter = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
        union, hull = a[1] - a[0] + b[1] - b[0] - inter, max(a[1], b[1]) - min(a[0], b[0])
        return (inter / union - (hull - union) / hull + 1) / 2

    rows = [([seg() for _ in range(rng.randrange(0, 5))], [seg() for _ in range(rng.randrange(0, 5))]) for _ in range(40)]
    for margin in (0.0, 3.0):
        score = lambda a, b, m=margin: max(ngiou(a, b), ngiou(a, [max(0.0, b[0] - m), b[1] + m])) if m else ngiou(a, b)
        got = column(spark, rows, "a array<array<double>>, b array<array<double>>", S.best_assignment_sum(F.col("a"), F.col("b"), True, margin))
        assert all(abs(g - _best(a, b, score)) < 1e-9 for g, (a, b) in zip(got, rows))


def test_segmentation_rewards_bounds(spark):
    sf = "/root/testdata/sf0.001"
    rows = segmentation_rewards(spark, sf).collect()
    assert rows and all(0 <= r.dp_reward <= 1 and 0 <= r.match_reward <= 1 for r in rows)
    mixed = mixed_rewards(spark, sf).collect()
    assert len(mixed) == spark.read.parquet(f"{sf}/rollouts.parquet").count() == len({r.row_id for r in mixed}) and all(0 <= r.reward <= 1 for r in mixed)


def test_tokens(spark):
    rows = [([1, 2, 9, 4],), ([1, 2],), ([],)]
    assert column(spark, rows, "x array<int>", T.eos_mask(F.col("x"), 9)) == [[1, 1, 1, 0], [1, 1], []]
    assert column(spark, rows, "x array<int>", T.padded(F.col("x"), 3, F.lit(0), True)) == [[1, 2, 9, 4], [0, 1, 2], [0, 0, 0]]
    assert column(spark, rows, "x array<int>", T.truncated(F.col("x"), 3, "left")) == [[2, 9, 4], [1, 2], []]
    with pytest.raises(Exception, match="longer than 3"):
        column(spark, rows, "x array<int>", T.truncated(F.col("x"), 3, "error"))
    assert column(spark, [([1.0, 2.0, 4.0], [1, 1, 0])], "r array<double>, m array<int>", T.masked_returns(F.col("r"), F.col("m"), 0.5)) == [[2.0, 2.0, 4.0]]


def test_quotas(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 9 + ["b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "pos int, k string").withColumn("quota", F.lit("clash")).withColumn("h", Q.order_hash("s", "pos"))
    quotas = spark.createDataFrame([("a", 57), ("b", 9999), (None, 3), ("none", 5)], "k string, quota long")
    got = Q.take(df, quotas, ["k"], "h", "pos").collect()
    order = sorted((r.h, r.pos, r.k) for r in df.collect())
    want = [p for k, n in (("a", 57), ("b", 9999), (None, 3)) for p in [x[1] for x in order if x[2] == k][:n]]
    assert sorted(r.pos for r in got) == sorted(want)
    ranks = {r.pos: r.rn for r in Q.numbered(df, ["k"], "h", "pos").collect()}
    assert all(ranks[x[1]] == [y[1] for y in order if y[2] == x[2]].index(x[1]) + 1 for x in order)
    assert Q.take(df.limit(0), quotas, ["k"], "h", "pos").count() == 0
    for fn in (Q.proportional_quotas, Q.even_quotas, Q.small_whole_quotas):
        c = fn(Q.group_counts(df, ["k"]), [], "k", F.lit(100)).collect()
        assert sum(r.quota for r in c) == 100 and all(0 <= r.quota <= r.n for r in c), fn


def test_lookups(spark):
    build = spark.createDataFrame([(1, "p", "a"), (2, "p", "a"), (3, "q", "b"), (4, None, "c")], "pos long, prompt string, answer string").withColumn("found", F.col("pos"))
    probe = spark.createDataFrame([(10, 3, "q", "b"), (11, 1, "q", "b"), (12, 1, "p", "a"), (13, 9, "p", "a"), (14, 4, None, "c"), (15, 2, "x", "y")], "id long, pos long, prompt string, answer string")
    first = {r.id: (r.found, r.way) for r in L.index_then_content(probe, build, "pos", ["prompt", "answer"], "found").collect()}
    assert first == {10: (3, "index"), 11: (3, "content"), 12: (1, "index"), 13: (None, None), 14: (None, None), 15: (None, None)}
    second = {r.id: (r.found, r.way) for r in L.content_then_index(probe, build, "pos", ["prompt", "answer"], "found", "pos").collect()}
    assert second == {10: (3, "content"), 11: (3, "content"), 12: (2, "content"), 13: (2, "content"), 14: (4, "index"), 15: (2, "index")}
    assert L.unique_rows(build, ["prompt", "answer"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        L.unique_rows(build, ["prompt", "answer"], strict=True).collect()
    with pytest.raises(Exception, match="conflicting values"):
        L.merged_rows(build, ["prompt"], ["pos"], strict=True).collect()
    values = spark.createDataFrame([("g", float(i % 7)) for i in range(50)] + [("h", 1.0), (None, 2.0), ("g", None), ("g", float("nan"))], "k string, v double")
    for cells in (1, 4, 1024):
        got = {(r.k, r.share): r.value for r in L.interpolated(values, ["k"], "v", [0.0, 0.3, 1.0], cells).collect()}
        xs = sorted(float(i % 7) for i in range(50))
        assert got["g", 0.3] == pytest.approx(xs[14] + (xs[15] - xs[14]) * 0.7) and got["h", 0.3] == 1.0 and got[None, 1.0] == 2.0
    assert L.interpolated(values.limit(0), ["k"], "v", [0.5]).count() == 0


def test_batches(spark):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(7)], "n long, position string")
    placed = N.positions(df.drop("position"), [F.desc("n")], parts=3)
    assert [(r.n, r.position) for r in placed.orderBy("position").collect()] == [(6 - i, i) for i in range(7)]
    for divisor in (1, 4, 7, 20):
        rows = N.padded(placed, divisor, "position").orderBy("position").collect()
        assert len(rows) % divisor == 0 and len(rows) - 7 < divisor and [r.position for r in rows] == list(range(len(rows)))
        assert all(r.n == 6 - r.position % 7 and r.is_pad == (r.position >= 7) for r in rows)
    with pytest.raises(Exception, match="not a multiple"):
        placed.select(N.chunk_of(F.col("position"), F.lit(7), 2)).collect()
    with pytest.raises(ValueError):
        N.rename(df, ["n"], [])
    assert N.select(df, ["position", "nowhere", "n"]).columns == ["position", "n"] and N.without_internal(df.withColumn("_a", F.lit(1))).columns == df.columns
    deep = spark.createDataFrame([((1, (2, None)), [3])], "a struct<b:int, c:struct<d:int, e:string>>, l array<int>")
    assert N.flat(deep).columns == ["a/b", "a/c/d", "a/c/e", "l"] and N.nested(N.flat(deep)).collect() == deep.collect()
    assert N.padded(placed.limit(0), 4, "position").count() == 0


def test_permutations(spark):
    rows = column(spark, [(n, f"s{n}") for n in range(0, 8)], "n int, s string", F.struct(B.hash_permutation(F.col("n"), F.col("s")).alias("p"), B.inverse_permutation(B.hash_permutation(F.col("n"), F.col("s"))).alias("q")))
    for n, r in enumerate(rows):
        assert r.p is None if n < 2 else sorted(r.p) == list(range(1, n + 1)) != r.p and [r.p.index(i) + 1 for i in range(1, n + 1)] == r.q
    spans = [([(1.0, 2.0), (0.0, 1.0)],), ([(0.0, 2.0), (1.0, 3.0)],), ([(1.0, 1.0)],), ([],), (None,)]
    assert [r and [(x.s, x.e) for x in r] for r in column(spark, spans, "a array<struct<s:double,e:double>>", B.overlap_free(F.col("a")))] == [[(0.0, 1.0), (1.0, 2.0)], None, None, [], None]


def test_registry(spark, tmp_path):
    (tmp_path / "mine.py").write_text("def score(xs):\n    return [{'overall': len(x['response']), 'r_num': 2} for x in xs]\n")
    df = spark.createDataFrame([(1, "abc", 7), (2, None, 7)], "row_id int, response string, score int")
    got = {r.row_id: r.score for r in R.scored(df.drop("score"), R.load(f"{tmp_path}/mine.py:score")).collect()}
    assert got[1].overall == 3.0 and got[1].extra == {"r_num": 2.0} and got[2].overall == 0.0
    with pytest.raises(ValueError, match="taken"):
        R.estimator("grpo")(lambda x: x)
    with pytest.raises(ValueError, match="unknown estimator"):
        R.advantages("none", df)


def test_files(spark, tmp_path):
    at = str(tmp_path / "lines")
    spark.createDataFrame([('{"a": 1}',), ("",), ("{cut",), ('{"a": null, "b": "x"}',), ("[1]",)], "value string").coalesce(1).write.text(at)
    loose = SF.json_lines(spark, at, "a int, b string", strict=False).collect()
    assert len(loose) == 4 and sorted(r._bad_line for r in loose if r._bad_line) == ["[1]", "{cut"]
    with pytest.raises(Exception, match="not a JSON object in .*lines"):
        SF.json_lines(spark, at, "a int, b string").collect()
    assert SF.split_address("a/b.parquet@train") == ("a/b.parquet", "train") and SF.split_address("a@b/c") == ("a@b/c", None)
    assert SF.listed(["b", "a"], ["a", "c"]) == ["b", "a", "c"] and SF.in_step_range(["step_5", "step_000012", "x"], 6, 12) == ["step_000012"]
    assert SF.merged_config({"a": 1, "n": {"x": 1, "y": 2}}, {"n": {"x": 3}}, {"n.y": 5, "a": 1}) == {"a": 1, "n": {"x": 3, "y": 5}}
    kept = K.retained(spark.createDataFrame([(1, 0.9), (2, 0.1), (3, None), (4, 0.9), (5, 0.2)], "step int, score double"), 1)
    assert {(r.step, r.tracker) for r in kept.collect()} == {(5, "last"), (4, "best")}
    from cinderloom.streaming.stateful import moving_moments, taken_once

    data = str(tmp_path / "stream")
    rows = spark.createDataFrame([(i, "t", i % 4, float(i % 3), "same" if i % 2 else None) for i in range(24)], "row_id int, task string, step int, reward double, k string")
    for step in range(4):
        rows.where(f"step = {step}").coalesce(1).write.mode("append").parquet(data)
    at_once = {r.step: r.std for r in moving_moments(spark, data, F.col("task"), 0.9, 1e-3, "reward is not null").collect()}
    assert len(at_once) == 4 and all(v > 0 for v in at_once.values())
    assert sorted(r.row_id for r in taken_once(spark, data, ["task", "k"], "row_id", runs=2).collect()) == [0, 1]
    split = taken_once(spark, data, ["task", "k"], "row_id", runs=1, files_per_batch=1).collect()
    assert len(split) == 2
