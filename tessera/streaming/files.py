"""Files as they arrive: the same filters and transforms on a stream. Budgets and parts need an order over all files, so
they stay with batches (foreachBatch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.minify import process
from tessera.functions.tokens import token_count
from tessera.operators import filters, packing, render
from tessera.plans.options import Options, resolve


def stream_files(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """New files under root as the relation of files. Spark's own source is used, which skips names that begin with a dot
    or an underscore, and empty files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    name = F.element_at(F.split(path, "/"), -1)
    return raw.select(
        path.alias("path"),
        F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root.rstrip('/')) + 2})").alias("relative_path"),
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).alias("extension"),
        "length",
        F.expr("make_valid_utf8(cast(content as string))").alias("content"),
    )


def stream_entries(files: DataFrame, options: Options) -> DataFrame:
    """relative_path, tokens, cost, entry of the streamed files that a run would take; without state."""
    kept = filters.collect_files(files, options, resolve(options), ())
    kept = kept.withColumn("content", process(F.col("content"), F.col("extension"), options)).where(~filters.is_trivial(F.col("content")))
    counted = packing.with_cost(kept, token_count(files.sparkSession, F.col("content"), options.tokenizer))
    return counted.select("relative_path", "tokens", "cost", render.entry(F.col("relative_path"), F.col("content")).alias("entry"))


def write_entries(entries: DataFrame, to: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Starts the stream for the files there are now; each batch goes to Parquet under `to`, or to a function."""
    writer = entries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", to).start()
