"""Parsing replies, prompts and names, as native columns. A null text parses like an empty one unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a time pair is written inside brackets.
SEGMENT = r"\[\s*([0-9]*\.?[0-9]+)\s*,\s*([0-9]*\.?[0-9]+)\s*\]"
#: The domains a screening reply may name.
DOMAINS = ["procedural", "physical", "lifestyle", "entertainment", "narrative", "educational", "other"]


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null if there is no match or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def segments(text: Column, tagged: bool = True, duration: Column | None = None) -> Column:
    """``array<struct<k, s, e>>`` of the valid pairs in the first <events> block, or anywhere; ``k`` counts all pairs from 1.

    A pair is valid if s < e and, where a duration is known, e isn't beyond it. Negative numbers aren't pairs.
    """
    block = F.regexp_extract(given(text), r"(?s)<events>(.*?)</events>", 1) if tagged else given(text)
    ends = F.arrays_zip(F.regexp_extract_all(block, F.lit(SEGMENT), F.lit(1)).alias("s"), F.regexp_extract_all(block, F.lit(SEGMENT), F.lit(2)).alias("e"))
    pairs = F.transform(ends, lambda p, i: F.struct((i + 1).alias("k"), p["s"].cast("double").alias("s"), p["e"].cast("double").alias("e")))

    def valid(p: Column) -> Column:
        sound = p["s"] < p["e"]
        return sound if duration is None else sound & F.coalesce(p["e"] <= duration + F.lit(1e-6), F.lit(True))

    return F.filter(pairs, valid)


def has_events(text: Column) -> Column:
    return given(text).rlike(r"(?s)<events>.*?</events>")


def is_hacked(text: Column) -> Column:
    """Repeated tags, or spans written ``[1-2]`` to match more than one pattern."""
    text = given(text)
    repeated = [F.regexp_count(text, F.lit(tag)) > 1 for tag in ("<answer>", "</answer>", "<events>", "</events>")]
    return repeated[0] | repeated[1] | repeated[2] | repeated[3] | text.rlike(r"\[[0-9]+-[0-9]+\]")


def screen_reply(text: Column) -> Column:
    """``struct<l1_score, l2_score, domain, known_domain, decision>`` of a ``KEY: value`` reply; nulls for absent keys, 0 to 5 for scores."""

    def value(key: str) -> Column:
        return F.trim(F.regexp_extract(given(text), rf"(?im)^{key}:[ \t]*([^\n]*)$", 1))

    def score(key: str) -> Column:
        number = F.nullif(F.regexp_extract(value(key), r"^([0-9]{1,4})", 1), F.lit("")).cast("int")
        return F.least(F.lit(5), number)

    domain = F.nullif(F.lower(value("DOMAIN_L1")), F.lit(""))
    return F.struct(
        F.when(score("L1_SCORE").isNotNull(), score("L1_SCORE")).alias("l1_score"),
        F.when(score("L2_SCORE").isNotNull(), score("L2_SCORE")).alias("l2_score"),
        domain.alias("domain"),
        F.coalesce(domain.isin(DOMAINS), F.lit(False)).alias("known_domain"),
        F.nullif(F.lower(value("DECISION")), F.lit("")).alias("decision"),
    )


def embedded_json(text: Column) -> Column:
    """The JSON object of a reply as text: a fenced one, else the first braces on a line, with two levels inside; null if invalid."""
    fenced = extracted(given(text), r"(?s)```(?:json)?\s*(\{.*?\})\s*```")
    bare = extracted(given(text), r"(\{(?:[^{}\n]|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*\})")
    found = F.coalesce(fenced, bare)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def seconds_text(seconds: Column) -> Column:
    """Seconds with two decimals at most and no idle zeros."""
    return F.regexp_replace(F.format_string("%.2f", seconds), r"\.?0+$", "")


def clock_seconds(text: Column) -> Column:
    """Seconds of ``MM:SS`` or ``HH:MM:SS``; null for other texts."""
    parts = F.split(text, ":")
    number = lambda i: F.element_at(parts, i).cast("double")
    return F.when(text.rlike(r"^\d+:\d{1,2}(?:\.\d+)?$"), number(1) * 60 + number(2)).when(
        text.rlike(r"^\d+:\d{1,2}:\d{1,2}(?:\.\d+)?$"), number(1) * 3600 + number(2) * 60 + number(3)
    )


def clock_text(seconds: Column) -> Column:
    """Whole seconds as ``MM:SS``; minutes grow beyond 99."""
    whole = F.when(seconds.isNotNull(), F.floor(F.greatest(seconds, F.lit(0.0))).cast("long"))
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.concat(F.lit("0"), minutes)).otherwise(minutes), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def clip_parts(key: Column) -> Column:
    """``struct<video, start_sec, end_sec>`` of ``video_start_end``, whatever its case; null for other names."""
    pattern = r"^(.+)[_-](\d+(?:\.\d+)?)[_-](\d+(?:\.\d+)?)$"
    name = F.lower(F.trim(key))
    return F.when(
        name.rlike(pattern),
        F.struct(F.regexp_extract(name, pattern, 1).alias("video"), F.regexp_extract(name, pattern, 2).cast("double").alias("start_sec"), F.regexp_extract(name, pattern, 3).cast("double").alias("end_sec")),
    )


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def one_line(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(given(text), r"\s+", " "))


def steps_of(prompt: Column) -> Column:
    """The steps a question lists, split at semicolons after its colon."""
    return F.transform(F.split(F.regexp_extract(given(prompt), r"(?::\s*)([^\n?]*)\.", 1), ";"), lambda x: F.trim(x))


def missing_step(prompt: Column) -> Column:
    """Place, from 1, of the step left blank (``____`` or ``[MISSING]``); null if none is."""
    return F.nullif(F.array_position(F.transform(steps_of(prompt), lambda x: x.rlike(r"^(?:_{2,}|\[MISSING\])$")), True), F.lit(0))


def options(prompt: Column) -> Column:
    """``map<letter, text>`` of a prompt's options; of a letter's repeats the last counts."""
    marks = r"(?m)^\s*\(?([A-H])[.)]\s*(.*?)\s*$"
    pairs = F.arrays_zip(F.regexp_extract_all(given(prompt), F.lit(marks), F.lit(1)).alias("k"), F.regexp_extract_all(given(prompt), F.lit(marks), F.lit(2)).alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def swapped_options(prompt: Column) -> Column:
    """The prompt with the texts of options A and B exchanged."""
    return F.regexp_replace(given(prompt), r"(?m)^(\(?A[.)])([^\n]*)\n(\(?B[.)])([^\n]*)$", "$1$4\n$3$2")


def item_id(text: Column) -> Column:
    """``struct<kind, parent, child>`` of ``Event 3`` or ``Action 4.2``; null for other texts."""
    pattern = r"(?i)^\s*(phase|event|action)\s+(\d+)(?:\.(\d+))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int")
    return F.when(text.rlike(pattern), F.struct(F.lower(F.regexp_extract(text, pattern, 1)).alias("kind"), part(2).alias("parent"), part(3).alias("child")))


def numbered_list(items: Column) -> Column:
    """``1. a`` lines of an array's non-blank texts."""
    kept = F.filter(items, lambda x: F.trim(x) != "")
    return F.array_join(F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.trim(x))), "\n")


def thought_and_rest(text: Column) -> Column:
    """``struct<thought, rest>``: what stands in the first <think> block, and what follows it; without one all is the rest."""
    pattern = r"(?s)<think>(.*?)</think>(.*)"
    has = given(text).rlike(pattern)
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.struct(F.when(has, bare(F.regexp_extract(text, pattern, 1))).alias("thought"), bare(F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(given(text))).alias("rest"))


def content_parts(prompt: Column, marks: str = "video|image") -> Column:
    """A prompt as ``array<struct<type, text>>``: media marks become parts of their own, texts between them stay in order."""
    pieces = F.split(F.regexp_replace(given(prompt), f"<({marks})>", "\u0001$1\u0002"), "\u0001")

    def parts(piece: Column, i: Column) -> Column:
        mark = F.regexp_extract(piece, f"^({marks})\u0002", 1)
        after = F.regexp_replace(piece, f"^({marks})\u0002", "")
        none = F.lit(None).cast("string")
        medium = F.when(mark != "", F.array(F.struct(mark.alias("type"), none.alias("text")))).otherwise(F.array())
        return F.concat(medium, F.when(F.trim(after) != "", F.array(F.struct(F.lit("text").alias("type"), F.trim(after).alias("text")))).otherwise(F.array()))

    return F.flatten(F.transform(pieces, parts))
