"""Text expressions shared by the language-model operators. All are native columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs without content, which only look like characters.
INVISIBLE = "[​-‏⁠﻿­]"
#: White space that Java's \s leaves out.
WIDE_SPACE = "[ 　 -  ]"

#: Function words, and letters, that tell Latin-script languages apart.
LANGUAGE_WORDS = {
    "en": r"\b(?:the|and|an|of|with|what|which|that|at|does|how|when|to|are|it|is|while|this|was|for|by|between|from|then|its|has)\b",
    "es": r"\b(?:el|los|las|una|y|por|del|qué|está|sobre|entre|delante|que|en|cuando|con|su|al|pero|desde|hasta|junto|la)\b|[ñ¿¡]",
    "de": r"\b(?:der|die|das|den|dem|ein|eine|und|im|auf|neben|vor|ist|was|wenn|deshalb|zwischen|warum|wird|mit|von|nicht|sich|zur|zum)\b|[ßäöü]",
    "fr": r"\b(?:le|les|des|du|une|et|dans|sur|est|pour|que|devant|au|entre|pourquoi|se|donc|avec|qui|aux|pas|la)\b|\b[ld]['’]|[èêàœ]",
    "pt": r"\b(?:o|os|as|uma|um|na|ao|do|da|e|diante|portanto|entre|não|em|sobre|é|no|com|dos|pelo|pela)\b|[ãõ]",
}
#: Further scripts, each of which stands for one language here.
SCRIPTS = {
    "ja": r"\p{IsHiragana}\p{IsKatakana}", "ko": r"\p{IsHangul}", "ar": r"\p{IsArabic}", "he": r"\p{IsHebrew}", "el": r"\p{IsGreek}",
    "hi": r"\p{IsDevanagari}", "th": r"\p{IsThai}", "hy": r"\p{IsArmenian}", "ka": r"\p{IsGeorgian}", "bn": r"\p{IsBengali}", "ta": r"\p{IsTamil}",
}
#: How closing instruction lines begin.
CLOSING = r"(?:please (?:provide|answer)|answer with|think first|keep the answer|give the|reason between|reply with|return <|return the)"


def let(value: Column, build) -> Column:
    """``build(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), build)[0]


def visible(text: Column) -> Column:
    """``text`` without invisible signs, wide spaces as plain ones; an empty string for null."""
    filled = F.coalesce(text, F.lit(""))
    cleaned = F.regexp_replace(F.regexp_replace(filled, INVISIBLE, ""), WIDE_SPACE, " ")
    return F.when(F.octet_length(filled) == F.length(filled), filled).otherwise(cleaned)


def words(text: Column) -> Column:
    """Lower-case words in order; every Han or kana sign is a word of its own."""
    return F.regexp_extract_all(
        F.lower(text), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0)
    )


def shingles(tokens: Column, width: int = 5) -> Column:
    """Distinct runs of ``width`` words as 64-bit hashes; one shorter run if there are fewer words."""

    def of(t: Column) -> Column:
        n = F.greatest(F.size(t) - F.lit(width - 1), F.lit(1))
        return F.array_distinct(
            F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(t, i, F.lit(width)), " ")))
        )

    return let(tokens, of)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two word arrays, whatever their length; 0 beside a null.

    An Arrow-batched function: a row of the usual table is one integer's bits, so a row costs one
    addition per word instead of a cell per pair of words.
    """

    @F.pandas_udf("int")
    def bits(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def length(x, y) -> int:
            if x is None or y is None:
                return 0
            first, second = x.split(), y.split()
            places: dict[str, int] = {}
            for i, word in enumerate(first):
                places[word] = places.get(word, 0) | 1 << i
            full = (1 << len(first)) - 1
            row = full
            for word in second:
                met = row & places.get(word, 0)
                row = ((row + met) | (row - met)) & full
            return len(first) - row.bit_count()

        return pd.Series([length(x, y) for x, y in zip(xs, ys)], dtype="int32")

    return bits(F.array_join(a, " "), F.array_join(b, " "))


def last_word(text: Column) -> Column:
    """The lower-case word a text ends in; a Han sign is a word; an empty string when it ends in none."""
    tail = F.substring_index(F.rtrim(text), " ", -1)
    return F.lower(F.regexp_extract(tail, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{M}&&[^\p{IsHan}]]+)$", 1))


def language(text: Column) -> Column:
    """Language of a text by script and function words; null when nothing speaks for one.

    A Latin language needs more hits than every other one; plain ASCII with "the" is English at once.
    """
    low = F.lower(text)
    han = F.regexp_count(text, F.lit(r"[\p{IsHan}]"))
    cyrillic = F.regexp_count(text, F.lit(r"[\p{IsCyrillic}]"))
    latin = F.regexp_count(text, F.lit(r"[\p{IsLatin}]"))
    hits = F.array(
        *[
            F.struct(F.regexp_count(low, F.lit(pattern)).alias("n"), F.lit(lang).alias("lang"))
            for lang, pattern in LANGUAGE_WORDS.items()
        ]
    )
    best = let(
        F.sort_array(hits, asc=False),
        lambda r: F.when((r[0]["n"] >= 1) & (r[0]["n"] > r[1]["n"]), r[0]["lang"]),
    )
    english = text.rlike(r"^[\x00-\x7f]*$") & low.rlike(r"\bthe\b")
    other = F.lit(None).cast("string")
    for lang, signs in reversed(SCRIPTS.items()):
        n = F.regexp_count(text, F.lit(f"[{signs}]"))
        other = F.when((n >= 3) & (n >= latin), lang).otherwise(other)
    return (
        F.when(english, "en")
        .when(text.rlike("[" + "".join(SCRIPTS.values()) + "]") & other.isNotNull(), other)
        .when((han >= 2) & (han * 3 >= latin), "zh")
        .when((cyrillic >= 3) & (cyrillic >= latin), "ru")
        .otherwise(best)
    )
