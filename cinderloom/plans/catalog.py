"""Queries declared as SQL that Spark and the oracle engine both understand, with the few dialect words mapped."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinderloom.sources.tables import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings rollouts records data_config "
    "annotations phases hier_events actions causal_links sample_targets pack_plans mix_targets"
).split()
_NAMES = re.compile(rf"\b(?:{'|'.join(TABLES)})\b")


def r9(x: str) -> str:
    """``x`` to nine decimals by the same arithmetic in either engine."""
    return f"floor(({x}) * 1e9 + 0.5e0) / 1e9"


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the tables that ``text`` names; each is bound to its Parquet file by a private view."""
    used = sorted(set(_NAMES.findall(text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(
            _NAMES.sub(lambda m: "{" + m[0] + "}", text.replace("{", "{{").replace("}", "}}")),
            **{name: table(spark, sf_dir, name) for name in used},
        )

    return run


def oracle_text(text: str) -> str:
    return re.sub(r"\bpercentile\(", "quantile_cont(", text)


_N = r"([0-9]*\.?[0-9]+)"
_WORDINGS = [
    rf"(?is)The\s+event(?:\s+['\"“].*?['\"”])?\s+happens\s+in\s+(?:the\s+)?{_N}\s*-\s*{_N}\s*seconds?".replace("'", "''"),
    rf"(?i){_N}\s*-\s*{_N}\s*seconds?",
    r"(?i)([0-9]+\.?[0-9]*)\s+(?:to|and)\s+([0-9]+\.?[0-9]*)",
]


def pair_sql(text: str, g: int) -> str:
    """The cascade as SQL: the wordings in the text, then in its answer, then the first bracketed pair of its events."""
    answer, events = f"regexp_extract({text}, '(?s)<answer>(.*?)</answer>', 1)", f"regexp_extract({text}, '(?s)<events>(.*?)</events>', 1)"
    tried = [(t, w) for t in (text, answer) for w in _WORDINGS] + [(events, rf"\[\s*{_N}\s*,\s*{_N}\s*\]")]
    number = lambda t, w, k: f"try_cast(nullif(regexp_extract({t}, '{w}', {k}), '') as double)"
    return "case " + " ".join(f"when {number(t, w, 1)} < {number(t, w, 2)} then {number(t, w, g)}" for t, w in tried) + " end"
