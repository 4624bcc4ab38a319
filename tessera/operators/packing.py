"""Order, budgets and parts of entries.

Entries are ranked by a range-partitioned sort: ranks and running sums are worked out per partition, and only each
partition's totals meet in one place, so nothing that grows with the data runs in one task but the last, sequential step of
parts, which sees (rank, cost) pairs of the entries within the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import entry_cost
from tessera.session import stored

#: Fixed value: entries in the list of largest consumers.
TOP = 5


def largest_first() -> tuple[Column, ...]:
    """By length, largest first; equal ones by path, so that runs agree."""
    return F.col("length").desc(), F.col("relative_path").asc()


def ranked(entries: DataFrame) -> DataFrame:
    """entries(length, relative_path, cost, ...) with rank (from 1) and prev (the cost of all before), in largest-first
    order. Two passes over the sorted partitions instead of a window over everything. The first pass is stored, since
    another evaluation could cut the partitions elsewhere; callers give it narrow rows."""
    ordered = entries.repartitionByRange(*largest_first()).sortWithinPartitions(*largest_first()).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy(*largest_first())
    local = ordered.select("*", F.row_number().over(within).alias("_n"), F.sum("cost").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    local = stored(local, "ranks")
    totals = local.groupBy("_part").agg(F.max("_n").alias("_rows"), F.max("_sum").alias("_cost"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_cost").over(earlier), F.lit(0)).alias("_before"))
    out = local.join(F.broadcast(before), "_part")  # as many rows as partitions
    return out.withColumn("rank", F.col("_n") + F.col("_rows")).withColumn("prev", F.col("_before") + F.col("_sum") - F.col("cost")).drop("_part", "_n", "_sum", "_rows", "_before")


def within_budget(entries: DataFrame, max_tokens: int | None) -> DataFrame:
    """Entries up to and with the one that crosses the budget."""
    return entries if max_tokens is None else entries.where((F.col("rank") == 1) | (F.col("prev") <= max_tokens))


def _next_fit(split: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = 1, 0
        for pdf in batches:
            parts = []
            for cost in pdf.cost:
                if held + cost > split and held > 0:
                    part, held = part + 1, 0
                held += cost
                parts.append(part)
            yield pd.DataFrame({"rank": pdf["rank"], "part": parts})

    return fold


def split_parts(entries: DataFrame, split_tokens: int | None) -> DataFrame:
    """entries(rank, cost, ...) with part (from 1): by rank, a part ends before the entry that would overfill it; an entry
    over the budget has a part of its own. Each decision needs the one before, so (rank, cost) pairs go through one task,
    as a stream; everything else stays where it is."""
    if split_tokens is None:
        return entries.withColumn("part", F.lit(1))
    pairs = entries.select("rank", "cost").repartition(1).sortWithinPartitions("rank")  # not coalesce, which would put what comes before into the same task
    return entries.join(pairs.mapInPandas(_next_fit(split_tokens), "rank bigint, part int"), "rank")


def part_totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("part").agg(F.sum("cost").alias("part_tokens"), F.count(F.lit(1)).alias("entries"))


def top_tokens(entries: DataFrame, k: int = TOP) -> DataFrame:
    """The largest consumers, by tokens without overhead; equal ones by rank."""
    return entries.orderBy(F.desc("tokens"), "rank").limit(k).select("relative_path", "tokens")


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("processed_files"))


def with_cost(entries: DataFrame, tokens: Column) -> DataFrame:
    counted = entries.withColumn("tokens", tokens)
    return counted.withColumn("cost", entry_cost(F.col("tokens")))
