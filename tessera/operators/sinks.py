"""Where bundles go: part files, or one text."""

from __future__ import annotations

import contextlib
import os
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parts(parts: DataFrame, folder: str, overwrite: bool = True, bom: bool = True, now: datetime | None = None) -> list[str]:
    """parts(part, file_name, part_text) as files on the driver, one part in memory at a time: written under a draft name
    and renamed when whole; a draft goes if anything fails. An existing file is replaced, or the new one gets minute and
    second. Returns the paths."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for row in parts.orderBy("part").select("file_name", "part_text").toLocalIterator():
        place = os.path.join(folder, row.file_name)
        if os.path.exists(place) and not overwrite:
            stem, ending = os.path.splitext(place)
            place = f"{stem}_{now or datetime.now():%M%S}{ending}"
        draft = os.path.join(folder, f"{row.file_name}.{uuid.uuid4().hex}.tmp")
        try:
            with open(draft, "x", encoding="utf-8-sig" if bom else "utf-8", newline="\n") as f:
                f.write(row.part_text)
            os.replace(draft, place)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(draft)
        out.append(place)
    return out


def write_parts_shared(parts: DataFrame, folder: str) -> None:
    """Parts as a table (part, file_name, part_text) in a store that only Spark reaches."""
    parts.select("part", "file_name", "part_text").write.mode("overwrite").parquet(folder)


def one_text(entries: DataFrame) -> DataFrame:
    """All entries in order as one row (text); no rows for none. Bounded by the budget that entries were cut to."""
    return entries.agg(F.expr("listagg(entry, '') WITHIN GROUP (ORDER BY rank)").alias("text"), F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
