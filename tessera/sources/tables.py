"""Tables of texts as a relation of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("path", "relative_path", "name", "extension", "length", "content")


def as_files(df: DataFrame, relative_path: str, content: str, root: str = "/corpus/") -> DataFrame:
    """The relation of files for SQL expressions of a path and a content. Null contents are empty."""
    rows = df.select(F.expr(relative_path).alias("relative_path"), F.coalesce(F.expr(content), F.lit("")).alias("content"))
    name = F.element_at(F.split("relative_path", "/"), -1)
    return rows.select(
        F.concat(F.lit(root), "relative_path").alias("path"),
        "relative_path",
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).alias("extension"),
        F.octet_length("content").cast("bigint").alias("length"),
        "content",
    )


#: A path and a content for each table of texts; Spark and DuckDB read both alike.
PATHS = {
    "documents": (
        "concat('docs/', source, '/', lang, '/doc_', cast(doc_id as string), case doc_id % 6 when 0 then '.md' when 1 then '.txt'"
        " when 2 then '.yml' when 3 then '.css' when 4 then '.cs' else '.min.js' end)",
        "text",
    ),
    "pages": ("concat('web/page_', cast(page_id as string), '.html')", "html"),
    "events": ("concat('Events.Tests/evt_', cast(event_id as string), '.json')", "props"),
    "conversations": ("concat('chat/', role, '/c', cast(conv_id as string), '_', cast(turn as string), '.yaml')", "text"),
}


def table_files(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """Files of the named tables, of all of them if none is named."""
    found = None
    for name in tables or PATHS:
        path, content = PATHS[name]
        files = as_files(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), path, content)
        found = files if found is None else found.unionByName(files)
    return found
