"""Intervals, references and flattening against brute force, with nulls, ties, repeats and clashing names."""

import random

from cinderloom.operators.flatten import annotation_occurrences, object_store, record_occurrences
from cinderloom.operators.periods import continuous_periods
from cinderloom.operators.references import orphan_references


def brute(rows, tolerance):
    out = set()
    for g in {r[0] for r in rows}:
        spans = sorted((s, e) for k, s, e in rows if k == g and s is not None and e is not None and e >= s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1] + tolerance:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(g, "period", s, e) for s, e in merged}
        out |= {(g, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def test_periods_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["b", None]), s := rng.randrange(0, 5000), s + rng.randrange(0, 60)) for _ in range(600)]
    rows += rows[:20] + [("b", None, 5), ("b", 5, None), ("c", 9, 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, s long, e long, _g string")
    got = continuous_periods(df, ["g"], "s", "e", tolerance=4, slice_width=100)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4)
    assert continuous_periods(df.limit(0), ["g"], "s", "e").count() == 0


def test_references(spark):
    refs = spark.createDataFrame(
        [("t", "c", 1, "v", "event", "e1", "2025-01-01"), ("t", "c", 2, "v", "event", "e2", "2025-01-01"), ("t", "c", 3, "v", "event", "e3", "2025-01-01"),
         ("t", "c", 4, "v", "event", "e4", "2025-01-01"), ("t", "c", 5, None, None, "e1", None)],
        "ref_table string, ref_column string, row_id long, video_id string, kind string, id string, loaded_at string",
    ).selectExpr("*", "cast(loaded_at as timestamp_ntz) as t").drop("loaded_at").withColumnRenamed("t", "loaded_at")
    targets = spark.createDataFrame(
        [("v", "event", "e1", None, "2024-01-01"), ("v", "event", "e2", True, "2024-01-01"), ("v", "event", "e3", False, "2025-02-01")],
        "video_id string, kind string, id string, is_deleted boolean, loaded_at string",
    ).selectExpr("*", "cast(loaded_at as timestamp_ntz) as t").drop("loaded_at").withColumnRenamed("t", "loaded_at")
    for share in (0.001, 0.9):  # all keys heavy, none heavy
        got = {(r.row_id, r.reason) for r in orphan_references(refs, targets, share).collect()}
        assert got == {(2, "deleted"), (3, "late"), (4, "missing"), (5, "missing")}
    assert orphan_references(refs.limit(0), targets).count() == 0


def test_flattening(spark):
    level1 = "struct<_parse_error:boolean,macro_phases:array<struct<phase_id:int,phase_name:string>>>"
    level2 = "struct<_parse_error:boolean,events:array<struct<event_id:int,parent_phase_id:int>>>"
    sub = "array<struct<action_id:int,sub_action:string>>"
    level3 = f"struct<_parse_error:boolean,grounding_results:array<struct<action_id:int,parent_event_id:int,event_id:int,parent_phase_id:int,sub_actions:{sub}>>>"
    docs = spark.createDataFrame(
        [(1, (None, [(1, "a"), None]), (False, [(7, None)]), (None, [(5, None, None, 1, None), (None, None, 9, 1, [(2, "x"), (2, "x"), None]), (None, None, 8, 1, [])])),
         (2, (True, [(1, "a")]), None, (None, None))],
        f"ann_id long, level1 {level1}, level2 {level2}, level3 {level3}",
    )
    occ = annotation_occurrences(docs)
    got = sorted((r.root_id, r.node, r.node_id, r.parent_id) for r in occ.where("node <> 'grounding'").collect())
    assert got == [("1", "action", 2, 9), ("1", "action", 2, 9), ("1", "action", 5, -1), ("1", "event", 7, -1), ("1", "phase", 1, 0)]
    assert object_store(occ).where("node = 'action'").count() == 2
    records = spark.createDataFrame(
        [(1, [("user", "q"), None], '{"ordered_ids": ["a", null], "offline_frame_extraction": {"videos": [{"frame_dir": "f"}]}}'), (2, None, "{broken"), (3, [], None)],
        "pos long, messages array<struct<role:string,content:string>>, metadata string",
    )
    got = sorted((r.root_id, r.node, r.node_id) for r in record_occurrences(records).collect())
    assert got == [("1", "frame_video", 1), ("1", "message", 1), ("1", "ordered_id", 1)]


def test_reference_counts_match_rows(spark):
    from pyspark.sql import functions as F

    from cinderloom.operators.references import orphan_counts

    rng = random.Random(7)
    days = [None, "2025-01-01 01:00:00", "2025-01-01 09:00:00", "2025-01-02 00:00:00"]
    refs = [("t", rng.choice("ab"), i, rng.choice(["v", "v", "w", None]), rng.choice(["event", "event", None]), rng.choice(["hot"] * 6 + ["e1", "e2", "e3", None]), rng.choice(days)) for i in range(400)]
    targets = [("v", "event", x, rng.choice([None, True, False]), rng.choice(days)) for x in ("hot", "e1", "e2") for _ in range(2)] + [("w", "event", "hot", False, days[2])]
    stamp = lambda df: df.withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz"))
    r = stamp(spark.createDataFrame(refs, "ref_table string, ref_column string, row_id long, video_id string, kind string, id string, loaded_at string"))
    t = stamp(spark.createDataFrame(targets, "video_id string, kind string, id string, is_deleted boolean, loaded_at string"))
    states: dict = {}
    for v, k, i, gone, at in targets:
        live, first = states.get((v, k, i), (False, None))
        states[v, k, i] = (live or not gone, first if gone or at is None else min(x for x in (first, at) if x))
    want = {}
    for _, c, n, v, k, i, at in refs:
        live, first = states.get((v, k, i), (None, None))
        reason = "missing" if live is None else "deleted" if not live else "late" if first and at and first > at else None
        if reason:
            want[n] = reason
    for share in (0.001, 0.2, 1.0):
        rows = orphan_references(r, t, share)
        assert {x.row_id: x.reason for x in rows.collect()} == want and rows.count() == len(want)
        counts = {(x.ref_column, x.reason, x.period): x.n_orphans for x in orphan_counts(r, t, share).collect()}
        assert counts == {(x.ref_column, x.reason, x.d): x["count"] for x in rows.groupBy("ref_column", "reason", F.to_date("loaded_at").alias("d")).count().collect()}
