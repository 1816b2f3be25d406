"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how byte-level BPE of this family splits a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counts(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, n_tokens`` of whole texts; null and empty texts have 0 tokens.

    ``vocabulary`` is a file of ranks that every executor can read. Arrow batches are kept small, as one
    text may be very long.
    """
    spark = texts.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")

    def count(batches):
        import base64

        import pandas as pd
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["_text"]]
            yield pd.DataFrame({"_key": batch["_key"], "n_tokens": sizes})

    counted = texts.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInPandas(
        count, "_key long, n_tokens long"
    )
    return counted.withColumnRenamed("_key", key)
