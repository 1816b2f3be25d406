"""Defective prompt and response pairs: empty, truncated, refusal, copy, other language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.llm.text import CLOSING, SCRIPTS, language, last_word, lcs_length, let, shingles, visible, words

#: Whole texts that stand for "no value", after markup and punctuation are dropped.
NO_VALUE = ["na", "n a", "none", "null", "nil", "nan", "undefined", "no answer", "not available", "not applicable", "no response", "no value", "tbd", "blank", "missing"]

#: Refusal templates; ``..`` stands for at most five words, ``I`` must be the speaker.
REFUSALS = [
    "i have to turn down", "i must turn down", "i need to turn down", "an answer .. would be inappropriate", "answering .. would be inappropriate", "an answer .. would not be appropriate",
    "i can't", "i cannot", "i can not", "i could not", "i couldn't", "i won't", "i will not be able", "i am not able", "i'm not able", "i am unable",
    "i'm unable", "i was unable", "i am not in a position", "i'm not in a position", "i am not capable", "i'm not capable", "i must decline", "i have to decline",
    "i need to decline", "i decline", "i must pass", "i have to pass", "i must refuse", "i refuse", "i do not have access", "i don't have access", "i have no access",
    "i have no means", "i have no way", "i have nothing to go on", "i don't feel comfortable", "i do not feel comfortable", "i'm not comfortable", "i am not comfortable",
    "i would rather not", "i'd rather not", "i will stop here", "i'm not allowed", "i am not allowed", "i'm not permitted", "i am not permitted", "i do not have the ability",
    "i don't have the ability", "not possible for me", "impossible for me", "not something i can", "beyond what i can", "beyond my abilities", "outside what i can",
    "my guidelines", "my policy", "content policy", "against my", "goes against .. i follow", "no video reached me", "nothing reached me", "did not load on my side", "as a text-only assistant", "as an ai",
    "as a language model",
]
#: The same in other languages.
OTHER_REFUSALS = [
    "lo siento", "no puedo", "je suis désolé", "je ne peux pas", "es tut mir leid", "ich kann leider", "ich kann diese", "ich kann das nicht",
    "sinto muito", "não posso", "não consigo", "к сожалению, я", "я не могу", "抱歉", "我无法", "我不能", "无法回答",
]

#: Words of sentences that go with a refusal, and so are no answer of their own.
BESIDES = r"\b(?:i|i['’]\w+|me|my|you|your|please|sorry|apolog\w+|thanks?|unfortunately|regret\w*|sadly|no answer|as an? \w+)\b"

#: Words that no English sentence breaks off complete after.
UNFINISHED = "a an the this that these those my your his her its our their of in on at to from by with for into onto over under near beside behind before after while and or but so because if when than as is are was were be been not very".split()

#: Least share of all sentence ends that a word must have to count as one a sentence can end in.
END_SHARE = 1e-5

#: Texts that no rule below can flag; they are dropped before anything dearer is looked at. A lone number may be a broken-off span.
_SPAN = r"\d+(?:\.\d+)?\s*(?:-|–|to)\s*\d+(?:\.\d+)?\s*(?:s|sec|secs|seconds)|<events>\s*\[\[[\[\]\d.,\s]+\]\]\s*</events>"
_LETTER = r"\(?[A-Ha-h][.)]?"


def _plain(sound: str) -> str:
    return rf"(?s)^(?:<think>.*?</think>\s*)?(?:<answer>\s*(?:{sound})\s*</answer>|\s*(?:{sound})\s*)\s*$"


PLAIN, PLAIN_NUMBER = _plain(f"{_LETTER}|{_SPAN}"), _plain(r"\d+")


def _refusal_pattern(templates: list[str]) -> str:
    """One pattern for lower-case text, branching on a template's first word so that most positions fail at once.

    It aligns a template's words in order, with at most five others where the template leaves a gap.
    """
    by_first: dict[str, list[str]] = {}
    for template in templates:
        first, _, more = template.replace("'", "['’]").partition(" ")
        more = more.replace(".. ", r"(?:\w+\W+){0,5}").replace(" ", r"\s+")
        by_first.setdefault(first, []).append(r"\s+" + more if more else "")
    bounded = [f"{w}(?:{'|'.join(m)})" for w, m in by_first.items() if w[0] < "Ѐ" or w[0] < "ӿ"]
    bare = [f"{w}(?:{'|'.join(m)})" for w, m in by_first.items() if w[0] > "ӿ"]
    return "|".join(([r"(?<![\w'’])(?:" + "|".join(bounded) + ")"] if bounded else []) + bare)


def declines(body: Column) -> Column:
    """Whether a text as a whole declines: some sentence aligns with a refusal template, and no other answers.

    A sentence or a clause after "but" answers if it has five words or more, aligns with no template,
    is no question and speaks neither of the speaker nor to the reader.
    """
    pattern = _refusal_pattern(REFUSALS)

    def answers(part: Column) -> Column:
        return (F.size(F.split(F.trim(part), r"\s+")) >= 5) & ~part.rlike(pattern) & ~part.rlike(BESIDES) & ~part.rlike(r"\?\s*$")

    def whole(low: Column) -> Column:
        parts = F.split(F.regexp_replace(low, r"(?<=[.!?;…])\s+|,?\s+\bbut\s+", "\n"), "\n")
        return low.rlike(_refusal_pattern(OTHER_REFUSALS)) | F.when(low.rlike(pattern), ~F.exists(parts, answers)).otherwise(F.lit(False))

    return let(F.lower(body), whole)


def sentence_ends(pairs: DataFrame, least_share: float = END_SHARE) -> DataFrame:
    """``word`` of all words that make up at least ``least_share`` of the sentence ends in ``pairs(text)``.

    Counted over whole texts. There can be at most ``1 / least_share`` such words. Single letters,
    as of options, and the words of UNFINISHED are none.
    """
    # What follows the last sign isn't known to be whole.
    closed = F.split(F.col("text"), r"[.!?…。！？]")
    pieces = F.slice(closed, 1, F.greatest(F.size(closed) - 1, F.lit(0)))
    ends = F.transform(F.filter(pieces, lambda x: x != ""), last_word)
    said = pairs.where(r"text rlike '\\p{L}{2}[.!?…。！？]|\\p{IsHan}[.!?…。！？]'").select(F.explode(ends).alias("word"))
    counted = said.where((F.length("word") >= 2) | F.col("word").rlike(r"\p{IsHan}")).where(~F.col("word").isin(UNFINISHED)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total), F.col("n") >= F.col("total") * F.lit(least_share)).select("word")


def bare_question(prompt: Column) -> Column:
    """The question of a full prompt, all its lines: media marks, options and closing instruction line aside."""
    text = F.regexp_replace(visible(prompt), "<(?:video|image)>", " ")
    text = F.regexp_replace(text, r"(?is)\n\s*(?:options|choices)\s*:.*$", "")
    text = F.regexp_replace(text, r"(?s)\n\s*\(?[A-H][.)]\s.*$", "")
    text = F.regexp_replace(text, rf"(?i)\n\s*{CLOSING}[^\n]*\s*$", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """``field_name, row_key, defect`` of the defective texts among
    ``pairs(field_name, row_key, problem_type, question, prompt, text)``.

    The tests go in this order and the first that holds names the defect: cut-off structure
    (open tag, bracket or thoughts), nothing that could be an answer, refusal, copy, broken-off
    sentence or span, other language. A null text is empty; with a null or blank question the prompt's
    own is used, and without either, copies and languages can't be judged. Thoughts are never judged.
    Signs transcribed (type ``ocr``) and texts without words have no language. Repeated rows each
    give a row. Whole texts are looked at. A copy gives back the whole question or one of its lines, by
    word containment and longest common subsequence at every length. A sentence without a
    closing sign is broken off if no sentence anywhere ends in its last word.
    """
    pairs = pairs.select("field_name", "row_key", "problem_type", "question", "prompt", "text")
    grounding = F.coalesce(F.col("problem_type") == "temporal_grounding", F.lit(False))
    kept = pairs.where(F.col("text").isNull() | ~(F.col("text").rlike(PLAIN) | (~grounding & F.col("text").rlike(PLAIN_NUMBER))))
    text = visible(F.col("text"))
    thought = F.regexp_replace(text, r"(?s)<think>.*?</think>|^.*</think>", " ")
    last_answer = F.regexp_extract(F.col("_rest"), r"(?s)^.*<answer>(.*?)</answer>", 1)
    closed = F.col("_rest").rlike(r"(?s)<answer>.*</answer>")
    staged = (
        kept.select(
            "field_name",
            "row_key",
            "problem_type",
            F.regexp_replace(visible(F.col("prompt")), "\r", "").alias("_prompt"),
            F.when(F.trim(visible(F.col("question"))) != "", F.trim(visible(F.col("question")))).otherwise(bare_question(F.col("prompt"))).alias("_q"),
            F.trim(F.regexp_replace(thought, r"^\s+|\s+$", "")).alias("_rest"),
        )
        .withColumn("_closed", closed)
        .withColumn("_body", F.regexp_replace(F.when(closed, last_answer).otherwise(F.col("_rest")), r"^\s+|\s+$", ""))
    )
    rest, body = F.col("_rest"), F.col("_body")
    open_structure = (
        rest.rlike(r"<think>")
        | (rest.rlike(r"<answer>") & ~F.col("_closed"))
        | (rest.rlike(r"<events>") & ~rest.rlike(r"</events>"))
        | rest.rlike(r"</?(?:a|an|ans|answ|answe|answer|e|ev|eve|even|event|events|t|th|thi|thin|think)?$")
        | (F.contains(body, F.lit("[")) & (F.length(F.replace(body, F.lit("["))) < F.length(F.replace(body, F.lit("]")))))
    )
    bare = F.lower(F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^<>]*>", " "), r"[^\p{L}\p{N}]+", " ")))
    refusal = declines(body)

    asked = F.regexp_replace(body, r"(?i)^\s*(?:the )?(?:question|q|you asked|the question was|prompt)\s*:\s*", "")
    # One more projection, so that words are split once.
    judged = staged.withColumn("_bare", bare)
    lines = F.filter(F.transform(F.split("_q", r"\n"), words), lambda w: F.size(w) >= 3)
    judged = judged.withColumn("_bw", words(asked)).withColumn("_all", words(F.col("_q")))
    bw = F.col("_bw")
    n_b = F.size(bw)
    most, extra = F.lit(0.75), F.lit(1.25)

    def may_copy(qw: Column) -> Column:
        """Whether an answer holds a question's words and hardly any others."""
        n_q = F.size(qw)
        contained = F.size(F.array_intersect(bw, qw)) >= most * F.size(F.array_distinct(qw))
        few_new = F.size(F.array_except(bw, qw)) <= F.greatest(F.lit(1.0), n_q * F.lit(0.12))
        return (n_q >= 3) & (n_b <= n_q * extra + F.lit(1)) & contained & few_new

    one_line = F.when(F.col("_q").contains("\n") & ~may_copy(F.col("_all")), F.try_element_at(F.filter(lines, may_copy), F.lit(1)))
    judged = judged.withColumn("_qw", F.coalesce(one_line, F.col("_all")))
    qw = F.col("_qw")
    n_q = F.size(qw)
    choices = F.regexp_count(body, F.lit(r"(?:^|[\s(])[A-H][.)]\s+\S"))
    with_options = (choices >= 2) & (n_b > n_q)
    answer_like = F.exists(F.array_except(bw, qw), lambda w: w.rlike(r"^(?:\d+|[a-h])$")) | (choices == 1)
    contained = F.size(F.array_intersect(bw, qw)) >= most * F.size(F.array_distinct(qw))
    likely = may_copy(qw) & ~answer_like
    # Aligned outside the table; unlikely pairs are null there and cost nothing.
    judged = judged.withColumn("_common", lcs_length(F.when(likely, bw), F.when(likely, qw)))
    plain_copy = F.when(likely, F.col("_common") >= most * F.greatest(n_q, F.least(n_b, n_q)))
    pw = words(F.col("_prompt"))
    prompt_copy = F.when(
        (n_q >= 3) & with_options & contained & (F.size(F.array_intersect(bw, pw)) >= F.lit(0.9) * F.size(F.array_distinct(bw))),
        F.size(F.array_intersect(shingles(bw), shingles(pw))) >= F.lit(0.6) * F.size(shingles(bw)),
    )
    copy = F.coalesce(plain_copy, F.lit(False)) | F.coalesce(prompt_copy, F.lit(False))

    ended = body.rlike(r"[.!?…。！？\"'”’»」』)\]>:;；]\s*$")
    unspaced = "".join([r"\p{IsHan}", SCRIPTS["ja"], SCRIPTS["th"]])
    sentence = (F.size(F.split(F.trim(body), r"\s+")) >= 3) | (F.regexp_count(body, F.lit(f"[{unspaced}]")) >= 4)
    broken_off = F.col("word").isNull()
    option = body.rlike(r"^\(?[A-H][.):]\s")
    tail_option = F.regexp_extract(body, r"(?:^|[\s(])([A-H][.)]\s+[^\n]+)$", 1)
    lines = F.concat(F.regexp_replace(F.col("_prompt"), r"\s*\n\s*", "\n"), F.lit("\n"))
    whole_line = F.contains(lines, F.concat(body, F.lit("\n")))
    cut_line = F.contains(lines, body) & ~whole_line
    ends_in_option = (tail_option != "") & F.contains(lines, F.concat(F.regexp_replace(tail_option, r"^[A-H][.)]\s+", ""), F.lit("\n")))
    is_span = F.col("problem_type") == "temporal_grounding"
    cut_span = is_span & (
        body.rlike(r"^(?:from\s+)?[\d.]+\s*(?:-|–|to|and)?\s*$")
        | body.rlike(r"^[\d.]+\s*(?:-|–|to)\s*\d+\.$")
        | body.rlike(r"^[\d.]+\s*(?:-|–|to)\s*[\d.]+\s+(?:se|seco|secon)$")
        | body.rlike(r"(?:-|–|\bto|\band|\by|\bund|\bet|\be|и|到|,)\s*$")
        | body.rlike(r"(?:^|[^\d.])\d+\.$")
        | body.rlike(r"(?i)^the event .*\d\.?$")
    )
    free = ~option & ~whole_line & ~ends_in_option & (F.coalesce(F.col("problem_type"), F.lit("")) != "ocr")
    whole_span = body.rlike(r"(?i)^(?:from\s+)?[\d.]+\s*(?:-|–|to|and)\s*[\d.]+\s*(?:s|sec|secs|second|seconds)?$")
    truncated = cut_span | (option & cut_line) | (sentence & ~ended & free & ~whole_span & broken_off)

    unquoted = F.regexp_replace(body, r"\"[^\"]*\"|“[^”]*”|«[^»]*»|「[^」]*」|<[^<>]*>", " ")
    b_lang, q_lang = language(unquoted), language(F.col("_q"))
    has_language = (F.coalesce(F.col("problem_type"), F.lit("")) != "ocr") & sentence & ~option & ~whole_line & ~whole_span
    foreign = F.when(has_language, b_lang != q_lang)

    defect = (
        F.when(open_structure, "truncated")
        .when((F.col("_bare") == "") | F.col("_bare").isin(NO_VALUE), "empty")
        .when(refusal, "refusal")
        .when(copy, "copy")
        .when(F.coalesce(truncated, F.lit(False)), "truncated")
        .when(F.coalesce(foreign, F.lit(False)), "other_language")
    )
    ended_in = F.when(~ended & sentence, last_word(body))
    # Bounded by END_SHARE, so small enough to be sent to every task.
    judged = judged.withColumn("_last", ended_in).join(F.broadcast(sentence_ends(pairs)), F.col("_last") == F.col("word"), "left")
    # A generator rather than a filter, which would be pushed down with all its expressions repeated.
    return judged.select("field_name", "row_key", F.explode(F.array_compact(F.array(defect))).alias("defect"))
