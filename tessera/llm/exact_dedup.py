"""Exact duplicates by digest, frequent digests apart from the rest. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table, unused, without

#: Counters that a Misra-Gries summary keeps, and digests that it may name: as many, so that none of the frequent ones is
#: crowded out. A digest in more than about 1 of 2,300 rows (3.5 of the summary's 8,192 places) is among them; others may
#: be missed and are shuffled, a small group each. It bounds what is broadcast (HEAVY rows of about 100 bytes).
HEAVY = COUNTERS = 4096


def normalised(text: Column) -> Column:
    """Null as empty, without any of space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the text as it is), digest (SHA-256 of the normalised text): the only pass over
    the texts."""
    return docs.select(
        "doc_id",
        F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("n_chars"),
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the one with the most code points, then the smallest doc_id, stays. Among rows repeated
    with one doc_id and text, one stays. Null is as empty; a null doc_id comes last among equals. An empty table
    gives no rows. Texts of any length count whole; columns but doc_id and text don't count.

    A Misra-Gries summary (Spark's approx_top_k, of bounded size) names digests that may be frequent. Their exact counts
    and winners are aggregated map-side over all rows, so that a hot digest sends one row per task; at most HEAVY
    verified winners are broadcast, and their rows are decided where they lie. Other digests are shuffled as usual."""
    rows = stored(digests(docs.select("doc_id", "text")), "digests")
    named = rows.agg(F.expr(f"approx_top_k(digest, {HEAVY}, {COUNTERS})").alias("top")).select(F.explode("top.item").alias("digest"))
    first = F.struct(F.col("n_chars").alias("chars"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus"))
    winners = stored(
        rows.join(F.broadcast(named), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(first).alias("top")).where("group_size > 1"),
        "winners",
    ).select("digest", "group_size", (-F.col("top.minus")).alias("keep_id"), F.col("top.chars").alias("keep_chars"))

    heavy = rows.join(F.broadcast(winners), "digest")
    is_winner = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    lost = heavy.where(~is_winner).select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest")
    # usually a row for each winner; a number only among rows that repeat it
    won = heavy.where(is_winner).select(
        "doc_id", "keep_id", "group_size", (F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")) == 1).alias("kept"), "digest"
    )
    alike = Window.partitionBy("digest")
    order = alike.orderBy(F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last())
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "doc_id",
        F.first("doc_id").over(order).alias("keep_id"),
        F.count(F.lit(1)).over(alike).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
        "digest",
    )
    return light.unionByName(lost).unionByName(won).withColumnRenamed("digest", "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without exact duplicates; all columns stay, whatever their names. Rows with a null doc_id stay, as no decision can
    name them. Of rows repeated with one doc_id and text one stays."""
    groups = stored(exact_groups(docs).select("doc_id", "kept", "keep_id"), "groups")
    again = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("some"), F.min("kept").alias("all"))
    out = again.where("not some").select("doc_id").where("doc_id is not null")
    mixed = again.where("some and not all")
    if not docs.columns or mixed.isEmpty():
        return without(docs, out, "doc_id")
    # an id with both kept and dropped rows: its rows alone are numbered
    digest, chars, number = unused(docs, "_digest"), unused(docs, "_chars"), unused(docs, "_n")
    known = docs["doc_id"]
    unsure = docs.join(mixed.select(F.col("doc_id").alias(digest)), known.eqNullSafe(F.col(digest)), "left_semi")
    sure = without(docs, out, "doc_id").join(mixed.select(F.col("doc_id").alias(digest)), F.col("doc_id").eqNullSafe(F.col(digest)), "left_anti")
    with_digest = unsure.withColumn(digest, F.sha2(normalised(F.col("text")).cast("binary"), 256)).withColumn(chars, F.char_length(F.coalesce(F.col("text"), F.lit(""))))
    best = exact_groups(docs).where("kept").select(F.struct("doc_id", F.col("text_sha256").alias("sha")).alias(number))
    order = Window.partitionBy("doc_id", digest).orderBy(F.col(chars).desc())
    one = with_digest.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
    one = one.join(best, F.col("doc_id").eqNullSafe(F.col(number)["doc_id"]) & (F.col(digest) == F.col(number)["sha"]), "left_semi")
    return sure.unionByName(one.drop(digest, chars))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_groups of documents; what it does with odd rows is said there."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC NULLS LAST)
"""
