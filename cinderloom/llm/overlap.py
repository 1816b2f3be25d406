"""Records of evaluation files that lie, the same or nearly so, in training files."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.llm.text import CLOSING, let, visible, words
from cinderloom.session import ensure_checkpoint_dir

EDITS = 4
SPAN_SECONDS = 2.0
COMMON_WORDS = 200

_CLIP = r"^(.+?)[_-](\d+(?:\.\d+)?)[_-](\d+(?:\.\d+)?)(?:\.[a-z][a-z0-9]*)?$"


def clip_of(name: Column) -> Column:
    """``struct(video, span_start, span_end)`` of a clip's name or path however written; null if unreadable."""
    return let(
        F.regexp_extract(F.lower(F.trim(name)), r"([^/\\]*)$", 1),
        lambda base: F.when(
            base.rlike(_CLIP),
            F.struct(
                F.regexp_extract(base, _CLIP, 1).alias("video"),
                F.regexp_extract(base, _CLIP, 2).cast("double").alias("span_start"),
                F.regexp_extract(base, _CLIP, 3).cast("double").alias("span_end"),
            ),
        ),
    )


def record_clip(metadata: Column, videos: Column) -> Column:
    """The clip of a record: its clip key, or the first file or frame folder of ``videos``."""
    named = F.try_variant_get(F.try_parse_json(metadata), "$.clip_key", "string")
    parsed = F.try_parse_json(videos)
    frame = F.try_variant_get(parsed, "$[0][0]", "string")
    folder = F.regexp_extract(frame, r"([^/\\]+)[/\\][^/\\]*$", 1)
    file = F.try_variant_get(parsed, "$[0]", "string")
    return F.coalesce(clip_of(named), clip_of(folder), clip_of(file))


def question_parts(prompt: Column) -> Column:
    """``struct(stem, options)``: the words of the question, and the sorted words of its options.

    Media marks, case, spacing, punctuation, option marks and order, and a closing instruction line don't count.
    """
    text = F.regexp_replace(F.lower(visible(prompt)), r"<(?:video|image)>", " ")
    text = F.regexp_replace(text, rf"\n\s*{CLOSING}[^\n]*\s*$", "")
    lines = F.transform(F.split(text, r"\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & (x != "options:") & (x != "choices:"))
    mark = r"^\(?[a-h][.)]\s*"
    stem = F.filter(lines, lambda x: ~x.rlike(mark))
    options = F.filter(lines, lambda x: x.rlike(mark))
    return F.struct(
        words(F.array_join(stem, " ")).alias("stem"),
        F.array_sort(words(F.array_join(F.transform(options, lambda x: F.regexp_replace(x, mark, "")), " "))).alias("options"),
    )


def numbered(tokens: Column) -> Column:
    """Each word with its occurrence number, so that a bag of words becomes a set."""
    return let(
        F.array_sort(tokens),
        lambda a: F.transform(a, lambda w, i: F.concat_ws("#", w, (i - F.array_position(a, w).cast("int")).cast("string"))),
    )


def word_edits(a: Column, b: Column, most: int) -> Column:
    """Words replaced, added or dropped between two word arrays if at most ``most``, else -1.

    Each distinct word becomes one character beyond the surrogates, of which there are 2 ** 20, and the built-in
    edit distance does the rest. Texts whose sets differ too much are told apart before, and so
    are two that differ and together have more distinct words than that.
    """
    first, places = 0x10000, 1 << 20

    def spelt(tokens: Column, known: Column) -> Column:
        codes = F.transform(tokens, lambda w: F.lpad(F.hex(F.array_position(known, w) + F.lit(first - 1)), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    far = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)) > 2 * most
    return F.when(far, F.lit(-1)).otherwise(
        let(F.array_union(a, b), lambda v: F.when(F.size(v) > places, F.lit(-1)).otherwise(F.levenshtein(spelt(a, v), spelt(b, v), most)))
    )


def bag_edits(a: Column, b: Column) -> Column:
    """Words replaced, added or dropped between two bags given as ``numbered`` sets."""
    common = F.size(F.array_intersect(a, b))
    return F.greatest(F.size(a), F.size(b)) - common


def config_entries(configs: DataFrame) -> DataFrame:
    """``config_name, role, entry`` of comma-separated file lists; blank entries and null lists give none."""
    lists = F.array(
        F.struct(F.lit("val").alias("role"), F.col("val_files").alias("files")),
        F.struct(F.lit("train").alias("role"), F.col("train_files").alias("files")),
    )
    return (
        configs.select("config_name", F.explode(lists).alias("l"))
        .select("config_name", "l.role", F.explode(F.split(F.coalesce("l.files", F.lit("")), ",")).alias("entry"))
        .withColumn("entry", F.regexp_replace(F.trim("entry"), "/+$", ""))
        .where("entry <> ''")
        .distinct()
    )


def ancestors(path: Column) -> Column:
    """A path and all directories above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def file_roles(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``data_file, val_configs, train_configs``: the configs each of ``files(data_file)`` is evaluation or training data of.

    A file pairs with another where the one's val_configs and the other's train_configs meet, so no table of pairs of
    files is made. There are as many configs as experiments, so the arrays stay short.
    """
    placed = (
        files.select("data_file", F.explode(ancestors(F.col("data_file"))).alias("entry"))
        .join(config_entries(configs), "entry")
        .select("config_name", "role", "data_file")
        .distinct()
    )
    of = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("config_name")))
    return placed.groupBy("data_file").agg(of("val").alias("val_configs"), of("train").alias("train_configs"))


def common_words(bags: DataFrame, most: int = COMMON_WORDS) -> list[str]:
    """The words that occur most often in ``bags(bag)``, rarest first; at most ``most`` of them reach the driver."""
    counts = bags.select(F.explode("bag").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    return [r["w"] for r in counts.orderBy(F.desc("f"), "w").limit(most).collect()][::-1]


def signatures(bag: Column, common: list[str]) -> Column:
    """Blocking signatures of a bag of words, exact for up to EDITS word edits.

    Two bags within EDITS edits share all but EDITS words of the larger. With the words of each bag in
    one order (words outside ``common`` first, by hash, then the common ones from rare to frequent) their
    first EDITS + 2 words then share at least two, so the signature is a pair of words. Bags of at most
    EDITS + 1 words may share just one word, or none: those also get single words, and up to EDITS
    words a signature that all share.
    """
    known = F.array(*[F.lit(w) for w in common]) if common else F.expr("cast(array() as array<string>)")
    ranked = F.array_sort(
        F.transform(bag, lambda w: F.struct(F.array_position(known, w).alias("r"), F.xxhash64(w).alias("h")))
    )

    def of(p: Column) -> Column:
        pairs = F.flatten(
            F.transform(
                p, lambda x, i: F.transform(F.slice(p, i + F.lit(2), EDITS + 2), lambda y: F.xxhash64(x["h"], y["h"]))
            )
        )
        none = F.expr("cast(array() as array<bigint>)")
        short = F.when(F.size(bag) <= EDITS + 1, F.transform(p, lambda x: x["h"])).otherwise(none)
        tiny = F.when(F.size(bag) <= EDITS, F.array(F.lit(0).cast("long"))).otherwise(none)
        return F.concat(pairs, short, tiny)

    return let(F.slice(ranked, 1, EDITS + 2), of)


def _linked(records: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files' roles, the rows with their class ``k``, and the verified links ``video, a, b`` of an evaluation and a training class."""
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    roles = file_roles(records.select("data_file").distinct(), configs).checkpoint()
    sides = roles.select("data_file", (F.size("val_configs") > 0).alias("is_eval"), (F.size("train_configs") > 0).alias("is_train"))
    cell = F.floor(F.col("span_start") / F.lit(SPAN_SECONDS)).cast("long")
    around = F.explode(F.array(cell - 1, cell, cell + 1))
    # Generators instead of filters, which would be pushed down with all their expressions repeated.
    placed = (
        records.select("pos", "data_file", "prompt", F.explode(F.array_compact(F.array(record_clip(F.col("metadata"), F.col("videos"))))).alias("clip"))
        .select("pos", "data_file", "prompt", "clip.*")
        .join(sides, "data_file")
        .withColumn("cell", cell)
    )
    shared = (
        placed.groupBy("video", "cell", "span_start").agg(F.max("is_eval").alias("e"), F.max("is_train").alias("t"))
        .select("video", around.alias("cell"), "e", "t")
        .groupBy("video", "cell").agg(F.max("e").alias("e"), F.max("t").alias("t"))
        .where("e and t").select("video", "cell")
    )
    asked = F.filter(F.array(question_parts(F.col("prompt"))), lambda q: F.size(q["stem"]) + F.size(q["options"]) > 0)
    rows = (
        placed.join(shared, ["video", "cell"], "left_semi")
        .select("pos", "data_file", "is_eval", "is_train", "video", "span_start", "span_end", F.explode(asked).alias("q"))
        .select(
            "pos", "data_file", "is_eval", "is_train", "video", "span_start", "span_end",
            F.array_join("q.stem", " ").alias("stem"), F.array_join("q.options", " ").alias("options"),
        )
        .withColumn("k", F.xxhash64("video", "span_start", "span_end", F.md5(F.concat_ws("|", "stem", "options"))))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    classes = (
        rows.groupBy("video", "k", "span_start", "span_end", "stem", "options")
        .agg(F.max("is_eval").alias("is_eval"), F.max("is_train").alias("is_train"))
    )
    as_words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    bags = classes.withColumn("bag", numbered(F.concat(as_words("stem"), as_words("options")))).persist(StorageLevel.MEMORY_AND_DISK)
    keyed = bags.select("video", "k", "span_start", "is_eval", "is_train", F.explode(signatures(F.col("bag"), common_words(bags))).alias("sig"))
    near = (
        keyed.where("is_eval").select("video", around.alias("cell"), "sig", F.col("k").alias("a"))
        .join(keyed.where("is_train").select("video", cell.alias("cell"), "sig", F.col("k").alias("b")), ["video", "cell", "sig"])
        .select("video", "a", "b").distinct()
    )
    fact = lambda k, x: bags.select("video", F.col("k").alias(k), F.struct("span_start", "span_end", "stem", "options").alias(x))
    verified = (
        near.join(fact("a", "xa"), ["video", "a"]).join(fact("b", "xb"), ["video", "b"])
        .where(
            (F.abs(F.col("xa.span_start") - F.col("xb.span_start")) <= SPAN_SECONDS)
            & (F.abs(F.col("xa.span_end") - F.col("xb.span_end")) <= SPAN_SECONDS)
        )
        .where(_apart("xa", "xb", as_words) <= EDITS)
        .select("video", "a", "b")
    )
    return roles, rows, verified


def split_overlaps(records: DataFrame, configs: DataFrame) -> DataFrame:
    """``eval_pos, eval_file, train_pos, train_file``: every evaluation record and a record of a
    training file of the same config, in another file, that name the same clip and ask the same question.

    ``records(pos, data_file, prompt, metadata, videos)``. Spans may differ by SPAN_SECONDS at each end
    and questions by EDITS words. Rows without a readable clip or without a word in the prompt match
    nothing; repeated rows match each on their own. Only rows of clips that lie on both sides are looked
    at further. Canonicalised records are hashed into classes, so copies are compared once; classes
    meet through the video, the span's start to the nearest cells, and signatures, are verified exactly,
    and only then expand into pairs of records.
    """
    roles, rows, verified = _linked(records, configs)
    members = lambda k, role: rows.where(f"is_{role}").select(
        "video", F.col("k").alias(k), F.col("pos").alias(f"{role}_pos"), F.col("data_file").alias(f"{role}_file")
    )
    return (
        verified.join(members("a", "eval"), ["video", "a"])
        .join(members("b", "train"), ["video", "b"])
        .join(_of_role(roles, "eval"), "eval_file")
        .join(_of_role(roles, "train"), "train_file")
        .where(_PAIRED)
        .select("eval_pos", "eval_file", "train_pos", "train_file")
    )


_PAIRED = "eval_file <> train_file and arrays_overlap(eval_configs, train_configs)"


def _of_role(roles: DataFrame, role: str) -> DataFrame:
    return roles.select(F.col("data_file").alias(f"{role}_file"), F.col("val_configs" if role == "eval" else "train_configs").alias(f"{role}_configs"))


def overlap_classes(records: DataFrame, configs: DataFrame) -> DataFrame:
    """``pos, data_file, is_eval, is_train, class_id, n_links``: the rows of ``split_overlaps`` in classes of copies of one clip and question,
    with the number of classes on the other side that theirs is linked to; its own counts if it lies on both."""
    roles, rows, verified = _linked(records, configs)
    inside = lambda k, role: rows.where(f"is_{role}").select("video", F.col("k").alias(k), F.col("data_file").alias(f"{role}_file")).distinct()
    met = verified.join(inside("a", "eval"), ["video", "a"]).join(inside("b", "train"), ["video", "b"])
    met = met.join(_of_role(roles, "eval"), "eval_file").join(_of_role(roles, "train"), "train_file").where(_PAIRED).select("video", "a", "b").distinct()
    ends = met.select("video", F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("other")), F.struct(F.col("b").alias("k"), F.col("a").alias("other")))).alias("l"))
    links = ends.select("video", "l.k", "l.other").distinct().groupBy("video", "k").agg(F.count(F.lit(1)).alias("n_links"))
    return rows.join(links, ["video", "k"]).select("pos", "data_file", "is_eval", "is_train", F.col("k").alias("class_id"), "n_links")


def overlap_counts(records: DataFrame, configs: DataFrame, source: Column) -> DataFrame:
    """``eval_file, source, n_pairs, n_eval_records`` of ``split_overlaps``, without expanding its pairs.

    Rows shrink to one per class, file and source; linked classes meet, and sizes are multiplied.
    ``source`` is an expression over ``records``.
    """
    roles, rows, verified = _linked(records, configs)
    known = records.select("pos", source.alias("source"))
    sized = lambda k, role, keys: rows.where(f"is_{role}").join(known, "pos").groupBy("video", F.col("k").alias(k), F.col("data_file").alias(f"{role}_file"), *keys).agg(F.count(F.lit(1)).alias(f"n_{role}"))
    met = verified.join(sized("a", "eval", ["source"]), ["video", "a"]).join(sized("b", "train", []), ["video", "b"])
    met = met.join(_of_role(roles, "eval"), "eval_file").join(_of_role(roles, "train"), "train_file").where(_PAIRED)
    # A class of evaluation records counts once however many training classes it meets.
    by_class = met.groupBy("video", "a", "eval_file", "source", "n_eval").agg(F.sum("n_train").alias("n_train"))
    return by_class.groupBy("eval_file", "source").agg(F.sum(F.col("n_eval") * F.col("n_train")).alias("n_pairs"), F.sum("n_eval").alias("n_eval_records"))


def _apart(a: str, b: str, as_words) -> Column:
    """Edits between two questions: word edits of the stems plus those of the options as bags."""
    same = (F.col(f"{a}.stem") == F.col(f"{b}.stem")) & (F.col(f"{a}.options") == F.col(f"{b}.options"))
    options = bag_edits(numbered(as_words(f"{a}.options")), numbered(as_words(f"{b}.options")))
    stems = word_edits(as_words(f"{a}.stem"), as_words(f"{b}.stem"), EDITS)
    return F.when(same, F.lit(0)).otherwise(let(stems, lambda n: F.when(n >= 0, n + options)))
