"""Token counts of texts, by a named tokenizer."""

from __future__ import annotations

import base64
import importlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import reach

#: Fixed value: tokens that an entry costs beside its content.
OVERHEAD = 30
#: Tokenizers: rank files of the public_tokenizers package; the library's own, which it fetches; an estimate in SQL.
FILES = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
FETCHED, APPROXIMATE = ("cl100k_base", "o200k_base"), "approx"


@lru_cache(4)
def encoding(name: str):
    """The worker's tokenizer of that name, made once."""
    import tiktoken

    if name not in FILES:
        return tiktoken.get_encoding(name)
    files = importlib.import_module("public_tokenizers")
    with open(files.path(FILES[name]), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def approximate(text: Column) -> Column:
    """A token for every 4 characters begun; needs no tokenizer and runs within the plan."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("bigint")


def token_count(spark: SparkSession, text: Column, tokenizer: str = "byte_bpe_50k") -> Column:
    """Tokens of whole texts, special strings being ordinary text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    if tokenizer == APPROXIMATE:
        return approximate(text)
    if tokenizer not in FILES and tokenizer not in FETCHED:
        raise ValueError(f"Unknown tokenizer: {tokenizer}")
    reach(spark)

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(tokenizer).encode_ordinary
        return pd.Series([len(encode(t)) for t in texts], dtype="int64")

    return count(text)


def entry_cost(tokens: Column) -> Column:
    return tokens + F.lit(OVERHEAD)
