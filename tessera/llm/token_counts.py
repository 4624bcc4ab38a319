"""Token counts of whole texts, merging only pre-tokens that aren't whole tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe
from tessera.llm.common import reach, table


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of text (null: as empty, 0) as the tokenizer of the file at path counts them, without added tokens.

    path must be readable on every node. Special strings inside texts are one token each, as is the library's default.
    The shortcut table is broadcast: its size is bound by the vocabulary, whatever the data."""
    whole = reach(spark).sparkContext.broadcast(bpe.proved(spark, path))

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        counter = bpe.loaded(path, whole.value)
        return pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    return count(text)


def op6_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    """Per row of documents: doc_id, n_bytes, n_tokens, over_limit. Null and empty texts have 0 bytes and 0 tokens;
    repeated rows give repeated rows; other columns are never read."""
    import public_tokenizers

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(spark, text, public_tokenizers.path("byte_bpe_50k.json")).alias("n_tokens"),
    )
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
