"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language, licences, nearest, packing, pieces, simhash, token_counts, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_nearest": nearest.op1_nearest,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_warc": warc.op3_warc,
        "op4_language": language.op4_language,
        "op5_licences": licences.op5_licences,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_packing": packing.op7_packing,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_pieces": pieces.op10_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.OP3_SQL, "op5_licences": licences.OP5_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
