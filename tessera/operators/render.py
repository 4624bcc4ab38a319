"""What a bundle looks like: entries, parts, names, summaries."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import token_label


def entry(relative_path: Column, content: Column) -> Column:
    """A file between tags; paths have forward slashes, and nothing is escaped."""
    path = F.translate(relative_path, "\\", "/")
    end = F.when(content.endswith("\n"), "").otherwise("\n")
    return F.concat(F.lit('<file path="'), path, F.lit('">\n'), content, end, F.lit("</file>\n"))


def part_texts(entries: DataFrame) -> DataFrame:
    """part, part_text: entries(part, rank, entry) in order."""
    return entries.groupBy("part").agg(F.expr("listagg(entry, '') WITHIN GROUP (ORDER BY rank)").alias("part_text"))


def part_file_names(parts: DataFrame, base: str, several: bool | None = None) -> DataFrame:
    """parts(part, part_tokens) with file_name. several: whether parts have numbers; by default if there are some."""
    if several is None:
        several = parts.agg(F.max("part")).first()[0] not in (None, 1)
    number = F.concat(F.lit("_part"), F.col("part").cast("string")) if several else F.lit("")
    return parts.withColumn("file_name", F.concat(F.lit(f"{base}"), number, F.lit("_"), token_label(F.col("part_tokens")), F.lit(".txt")))


def base_name(source: str, name: str | None = None, everything: bool = False, now: datetime | None = None) -> str:
    """The given name without its ending, else one of directory, switch and time."""
    if name:
        return os.path.splitext(name)[0]
    now = now or datetime.now()
    folder = os.path.basename(os.path.abspath(source)).replace(".", "_")
    return f"{folder}{'_all' * everything}_{now:%Y-%m-%d}_{now:%H%M}"


def _thousands(n: int, digits: int = 0) -> str:
    """Rounded half away from zero, as a decimal."""
    scaled = (n * 10**digits * 2 + 1000) // 2000
    whole = str(scaled // 10**digits)
    return f"{whole}.{scaled % 10**digits}" if digits else whole


def summary(kilobytes: float, tokens: int, processed: int, total: int, seconds: float) -> str:
    shown = f"{_thousands(tokens)}k" if tokens >= 1000 else str(tokens)
    return f"{kilobytes:.0f} KB • {shown} tokens • {processed}/{total} files • {seconds:.1f}s"


def consumers(top: list[tuple[str, int]]) -> list[str]:
    return [f"{k}. {path} ({f'{_thousands(n, 1)}k' if n >= 1000 else n})" for k, (path, n) in enumerate(top, 1)]


def footer(name: str, processed: int, total: int, tokens: int, seconds: float) -> str:
    return f"\n<!-- {name}: {processed}/{total} files | ~{tokens} tokens | {seconds:.1f}s -->"


def friendly_path(path: str) -> str:
    home = os.path.expanduser("~")
    return "~" + path[len(home) :] if path.lower().startswith(home.lower()) else path
