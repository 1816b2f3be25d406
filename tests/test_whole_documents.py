"""Object store and bridge hold whole documents."""

from pyspark.sql import functions as F

from cinderloom.operators.flatten import annotation_occurrences, record_occurrences
from cinderloom.plans.general import p6_bridge, p6_objects

SF = "/root/testdata/sf0.001"


def test_every_container_is_stored(spark):
    bridge, objects = p6_bridge(spark, SF).cache(), p6_objects(spark, SF).cache()
    assert bridge.where("container_id is not null").join(objects, F.col("container_id") == objects.object_id, "left_anti").count() == 0
    assert bridge.where("node = 'root' or container_id is null").where("not (node = 'root' and container_id is null)").count() == 0
    n = spark.read.parquet(f"{SF}/records.parquet").count() + spark.read.parquet(f"{SF}/annotations.parquet").count()
    assert bridge.where("node = 'root'").count() == n
    assert objects.agg(F.sum("n_occurrences")).first()[0] == bridge.count()


def test_records_differ_by_any_part(spark):
    full = '{"id": "x", "timestamp": [1, 2], "ordered_ids": ["a", null], "offline_frame_extraction": {"effective_fps": 1, "videos": [{"n": 3}]}, "shared_source_frames": {"fps": 2}, "odd": [{"q": 1}]}'
    changed = [full.replace(a, b) for a, b in (('"x"', '"y"'), ("[1, 2]", "[1, 3]"), ('["a", null]', '[null, "a"]'), ('"effective_fps": 1', '"effective_fps": 2'), ('"n": 3', '"n": 4'), ('"fps": 2', '"fps": 3'), ('"q": 1', '"q": 2'))]
    rows = [(i, [("user", "q"), None], m, "f") for i, m in enumerate([full, full, *changed, "{broken", "{broken too", "[1]", None])] + [(50, [None, ("user", "q")], full, "f"), (51, [("user", "q"), None], full, "g")]
    df = spark.createDataFrame(rows, "pos long, messages array<struct<role:string,content:string>>, metadata string, data_file string")
    occ = record_occurrences(df, whole=True).cache()
    roots = {r.root_id: r.object_id for r in occ.where("node = 'root'").collect()}
    assert len(roots) == len(rows) and roots["0"] == roots["1"] and len(set(roots.values())) == len(rows) - 1
    got = sorted(r.node for r in occ.where("root_id = '0'").collect())
    assert got == sorted(["root", "message", "metadata", "metadata_entry", "metadata_entry", "timestamp", "timestamp", "timestamp", "ordered_ids", "ordered_id", "offline_frame_extraction", "extraction_entry", "frame_video", "shared_source_frames", "shared_frames_entry"])


def test_annotations_differ_by_any_part(spark):
    level = "struct<_parse_error:boolean,{}:array<struct<{}>>>"
    schema = f"ann_id long, summary string, level1 {level.format('macro_phases', 'phase_id:int')}, level2 {level.format('events', 'event_id:int,parent_phase_id:int')}, level3 {level.format('grounding_results', 'action_id:int,parent_event_id:int,event_id:int,parent_phase_id:int,sub_actions:array<struct<action_id:int>>')}"
    base = ("s", (None, [(1,)]), (False, [(7, None)]), (None, [(None, None, 9, 1, [(2,), (3,)])]))
    rows = [base, base, ("t", *base[1:]), (base[0], (True, [(1,)]), *base[2:]), (base[0], (True, [(2,)]), *base[2:]), (base[0], None, *base[2:]), (*base[:3], (None, [(None, None, 9, 1, [(2,), (4,)])]))]
    occ = annotation_occurrences(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema), whole=True).cache()
    roots = {r.root_id: r.object_id for r in occ.where("node = 'root'").collect()}
    assert len(roots) == 7 and roots["0"] == roots["1"] and len(set(roots.values())) == 6
    assert occ.where("root_id = '0'").count() == 9
