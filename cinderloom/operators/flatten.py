"""Nested documents as flat tables with parent-child links and Merkle identities.

Objects are hashed bottom-up over their canonical JSON and the identities of their children, so
equal subtrees have equal identities wherever they occur. The ``*_occurrences`` functions give the
bridge, one row per occurrence with its parent and ordinal; ``object_store`` keeps each distinct
object once. With ``whole`` they also give the documents themselves, their levels and their
metadata with its entries, so that every container but the root's own is an occurrence too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPE = "struct<node:string,node_id:bigint,parent_id:bigint,ordinal:int,payload:string,object_id:string,container_id:string>"
_FIELDS = ["node", "node_id", "parent_id", "ordinal", "object_id", "container_id", "payload"]
NO_PARENT = 0
NULL_PARENT = -1


def merkle_id(payload: Column, children: Column | None = None) -> Column:
    """SHA-256 over an object's canonical JSON and, in order, the identities of its children."""
    parts = [F.coalesce(payload, F.lit("null"))]
    if children is not None:
        parts.append(F.array_join(children, ","))
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _occurrence(node, node_id, parent_id, ordinal, payload, children=None, container=None) -> Column:
    fields = [
        F.lit(node),
        node_id,
        parent_id,
        ordinal,
        payload,
        merkle_id(payload, children),
        F.lit(None) if container is None else container,
    ]
    names = ["node", "node_id", "parent_id", "ordinal", "payload", "object_id", "container_id"]
    return F.struct(*[f.alias(n) for f, n in zip(fields, names)]).cast(_TYPE)


def _each(array: Column, build) -> Column:
    """``build(element, ordinal)`` of the non-null elements, ordinals from 1; none for a null array."""
    made = F.transform(array, lambda x, i: F.when(x.isNotNull(), build(x, i + F.lit(1))))
    return F.coalesce(F.filter(made, lambda o: o.isNotNull()), F.expr(f"cast(array() as array<{_TYPE}>)"))


def _contained(objects: Column, container: Column) -> Column:
    """``objects`` with those of no container yet put into ``container``."""
    return F.transform(objects, lambda o: o.withField("container_id", F.coalesce(o["container_id"], container)))


def _direct(objects: Column) -> Column:
    """Kinds, places and identities of the objects of no container."""
    kids = F.filter(objects, lambda o: o["container_id"].isNull())
    return F.transform(kids, lambda o: F.concat_ws(":", o["node"], o["ordinal"], o["object_id"]))


def _over(node: str, payload: Column, below: Column, ordinal: int = 1) -> Column:
    """An object and, put into it, the objects below it; those are made once, however often they are used."""

    def build(children: Column) -> Column:
        top = _occurrence(node, F.lit(ordinal), F.lit(NO_PARENT), F.lit(ordinal), payload, _direct(children))
        return F.concat(F.array(top), _contained(children, top["object_id"]))

    return F.transform(F.array(below), build)[0]


def _emit_whole(df: DataFrame, src: str, root: Column, payload: Column, occurrences: Column) -> DataFrame:
    """One row per occurrence, the root's among them; it covers its scalars and its children, and has no container."""
    rows = df.select(root.alias("root_id"), payload.alias("_own"), occurrences.alias("_occ"))
    rows = rows.select("root_id", "_own", "_occ", merkle_id(F.col("_own"), _direct(F.col("_occ"))).alias("_rid"))
    top = _occurrence("root", F.lit(0), F.lit(NO_PARENT), F.lit(0), F.col("_own"), _direct(F.col("_occ")))
    every = F.concat(F.array(top), _contained(F.col("_occ"), F.col("_rid")))
    return rows.select(F.lit(src).alias("src"), "root_id", F.explode(every).alias("_o")).select("src", "root_id", *[f"_o.{n}" for n in _FIELDS])


def _emit(df: DataFrame, src: str, root: Column, occurrences: Column) -> DataFrame:
    """One row per occurrence; the root's identity covers those of its direct children."""
    rows = df.select(root.alias("root_id"), occurrences.alias("_occ"))
    direct = F.transform(F.filter("_occ", lambda o: o["container_id"].isNull()), lambda o: o["object_id"])
    rows = rows.select("root_id", F.sha2(F.array_join(direct, ","), 256).alias("_rid"), F.explode("_occ").alias("_o"))
    return rows.select(
        F.lit(src).alias("src"),
        "root_id",
        F.col("_o.node").alias("node"),
        F.col("_o.node_id").alias("node_id"),
        F.col("_o.parent_id").alias("parent_id"),
        F.col("_o.ordinal").alias("ordinal"),
        F.col("_o.object_id").alias("object_id"),
        F.coalesce("_o.container_id", "_rid").alias("container_id"),
        F.col("_o.payload").alias("payload"),
    )


def annotation_occurrences(annotations: DataFrame, whole: bool = False) -> DataFrame:
    """Phases, events, actions and action wrappers (node ``grounding``) of annotation documents.

    Levels flagged as parse errors, null levels, null arrays and null elements give nothing. An
    element of level 3 without an action id of its own is a wrapper, however many ``sub_actions`` it
    has; its actions' parent is its event. A null parent becomes -1, phases have parent 0. Repeated
    elements and documents each give their own rows. With ``whole`` a level that isn't null has a row
    itself, and the root holds the document's other columns.
    """
    def usable(level: str, array: str) -> Column:
        return F.when(~F.coalesce(F.col(f"{level}._parse_error"), F.lit(False)), F.col(f"{level}.{array}"))

    null_parent = F.lit(NULL_PARENT).cast("long")
    phases = _each(
        usable("level1", "macro_phases"),
        lambda x, i: _occurrence("phase", x["phase_id"], F.lit(NO_PARENT), i, F.to_json(x)),
    )
    events = _each(
        usable("level2", "events"),
        lambda x, i: _occurrence(
            "event", x["event_id"], F.coalesce(x["parent_phase_id"].cast("long"), null_parent), i, F.to_json(x)
        ),
    )

    def inner(wrapper: Column, container: Column | None) -> Column:
        return _each(
            wrapper["sub_actions"],
            lambda s, j: _occurrence(
                "action", s["action_id"], F.coalesce(wrapper["event_id"].cast("long"), null_parent), j, F.to_json(s), None, container
            ),
        )

    def element(x: Column, i: Column) -> Column:
        children = inner(x, None)
        own = F.to_json(x.dropFields("sub_actions"))
        flat = _occurrence(
            "action", x["action_id"], F.coalesce(x["parent_event_id"].cast("long"), null_parent), i, own
        )
        wrapper = _occurrence(
            "grounding", x["event_id"], F.coalesce(x["parent_phase_id"].cast("long"), null_parent), i, own,
            F.transform(children, lambda o: o["object_id"]),
        )
        return F.when(x["action_id"].isNotNull(), F.array(flat)).otherwise(
            F.concat(F.array(wrapper), F.transform(children, lambda o: o.withField("container_id", merkle_id(own, F.transform(children, lambda c: c["object_id"])))))
        )

    level3 = F.filter(usable("level3", "grounding_results"), lambda x: x.isNotNull())
    grounded = F.coalesce(
        F.flatten(F.transform(level3, element)), F.expr(f"cast(array() as array<{_TYPE}>)")
    )
    if whole:
        arrays = {"level1": ("macro_phases", phases), "level2": ("events", events), "level3": ("grounding_results", grounded)}

        def level(name: str, ordinal: int) -> Column:
            array, below = arrays[name]
            # What isn't flattened stays in the payload: the whole level if it is flagged, else the array's length.
            own = F.col(name).dropFields(array).withField("n", F.size(F.col(f"{name}.{array}")))
            kept = F.when(F.coalesce(F.col(f"{name}._parse_error"), F.lit(False)), F.to_json(name)).otherwise(F.to_json(own))
            one = _over(name, kept, F.col(f"_{name}"), ordinal)
            return F.when(F.col(name).isNotNull(), one).otherwise(F.expr(f"cast(array() as array<{_TYPE}>)"))

        own = F.to_json(F.struct(*[c for c in annotations.columns if c not in ("ann_id", *arrays)]))
        staged = annotations.withColumns({f"_{n}": below for n, (_, below) in arrays.items()})
        staged = staged.select("ann_id", own.alias("_own"), F.concat(*[level(n, k) for k, n in enumerate(arrays, 1)]).alias("_levels"))
        return _emit_whole(staged, "annotations", F.col("ann_id").cast("string"), F.col("_own"), F.col("_levels"))
    return _emit(
        annotations, "annotations", F.col("ann_id").cast("string"), F.concat(phases, events, grounded)
    )


def record_occurrences(records: DataFrame, whole: bool = False) -> DataFrame:
    """Messages, ordered ids and frame videos of records; ids are places in their array from 1.

    Null elements keep their place but give no row; metadata that isn't valid JSON, or whose fields
    have another shape, gives nothing. With ``whole`` a metadata object has a row and every entry below it too, the known
    arrays and objects with rows for what they hold; the root holds the record's other columns, and the
    text of metadata that is no object.
    """
    others = [c for c in records.columns if c not in ("pos", "messages", "metadata")]
    parsed = records.select("pos", "messages", "metadata", *others, F.try_parse_json("metadata").alias("_m"))
    parsed = parsed.select(
        "pos",
        "messages",
        "metadata",
        *others,
        "_m",
        F.try_variant_get("_m", "$.ordered_ids", "array<variant>").alias("_ids"),
        F.try_variant_get("_m", "$.offline_frame_extraction.videos", "array<variant>").alias("_videos"),
    )
    messages = _each(
        F.col("messages"), lambda x, i: _occurrence("message", i, F.lit(NO_PARENT), i, F.to_json(x))
    )

    def entries(node: str, array: str) -> Column:
        real = F.transform(F.col(array), lambda v: F.when(v.isNotNull() & ~F.is_variant_null(v), F.to_json(v)))
        return _each(real, lambda x, i: _occurrence(node, i, F.lit(NO_PARENT), i, x))

    if whole:
        return _whole_records(parsed, others, messages, entries("ordered_id", "_ids"), entries("frame_video", "_videos"), entries)
    found = F.concat(messages, entries("ordered_id", "_ids"), entries("frame_video", "_videos"))
    return _emit(parsed, "records", F.col("pos").cast("string"), found)


def _whole_records(parsed: DataFrame, others: list[str], messages: Column, ids: Column, videos: Column, entries) -> DataFrame:
    members = {"_members": "$", "_frames": "$.offline_frame_extraction", "_shared": "$.shared_source_frames"}
    staged = parsed.withColumns({name: F.try_variant_get("_m", path, "map<string,variant>") for name, path in members.items()})
    staged = staged.withColumn("_times", F.try_variant_get("_m", "$.timestamp", "array<variant>"))

    def pairs(node: str, name: str, taken: dict[str, str]) -> Column:
        """An object for each member by key, but for keys whose value is flattened further, its column given."""
        other = lambda k: ~F.coalesce(F.create_map(*[x for key, c in taken.items() for x in (F.lit(key), F.col(c).isNotNull())])[k], F.lit(False))
        keys = F.array_sort(F.map_keys(name))
        keys = F.filter(keys, other) if taken else keys
        return _each(keys, lambda k, i: _occurrence(node, i, F.lit(NO_PARENT), i, F.to_json(F.struct(k.alias("key"), F.to_json(F.col(name)[k]).alias("value")))))

    nested = {
        "ordered_ids": ("_ids", ids),
        "timestamp": ("_times", entries("timestamp", "_times")),
        "offline_frame_extraction": ("_frames", F.concat(pairs("extraction_entry", "_frames", {"videos": "_videos"}), videos)),
        "shared_source_frames": ("_shared", pairs("shared_frames_entry", "_shared", {})),
    }
    none = F.expr(f"cast(array() as array<{_TYPE}>)")
    parts = [pairs("metadata_entry", "_members", {key: c for key, (c, _) in nested.items()})]
    for k, (key, (c, below)) in enumerate(nested.items(), 1):
        sizes = [F.size(c).alias("n")] + ([F.size("_videos").alias("n_videos")] if c == "_frames" else [])
        parts.append(F.when(F.col(c).isNotNull(), _over(key, F.to_json(F.struct(F.lit(key).alias("key"), *sizes)), below, k)).otherwise(none))
    staged = staged.withColumns({"_messages": messages, "_entries": F.concat(*parts)})
    whole = F.when(F.col("_members").isNotNull(), _over("metadata", F.to_json(F.struct(F.size("_members").alias("n"))), F.col("_entries"))).otherwise(none)
    text = F.when(F.col("_members").isNull(), F.col("metadata")).alias("metadata")
    own = F.to_json(F.struct(*others, text, F.size("messages").alias("n_messages")))
    staged = staged.select("pos", own.alias("_own"), F.concat("_messages", whole).alias("_parts"))
    return _emit_whole(staged, "records", F.col("pos").cast("string"), F.col("_own"), F.col("_parts"))


def object_store(occurrences: DataFrame) -> DataFrame:
    """Each distinct object once: ``node, object_id, payload, n_occurrences``."""
    return occurrences.groupBy("node", "object_id").agg(
        F.min("payload").alias("payload"), F.count(F.lit(1)).alias("n_occurrences")
    )
