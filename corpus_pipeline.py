"""A corpus from raw documents to packed sequences: what is toxic, in no language, or a copy goes; the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents, and any others that docs have, whatever their names. Texts count whole, however long; a null text is as empty; no
documents give none. Among equals the smallest doc_id stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language, packing, simhash, toxicity
from tessera.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Null and empty texts stay; rows repeated with one doc_id and text go or stay
    together."""
    return toxicity.not_toxic(spark, docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be in a language: those without a letter (so null and empty ones), and those no nearer to any
    learned language than chance, go."""
    return language.known_language(spark, docs, docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the most code points; of repeated rows one."""
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; rows without a doc_id stay."""
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens, one row a piece; rows without a doc_id too."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(spark, docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: A kernel machine, a tokenizer and a genetic algorithm have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
