"""What the operators share: tables, the shared folder, stages that survive lost executors, joins chosen by size."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import reach, scratch, shared_dir, stored

__all__ = ["BROADCAST_KEYS", "fold", "reach", "scratch", "shared_dir", "sized", "stored", "table", "trim", "unused", "without"]

#: Keys that may be broadcast: at 8 bytes a key and Spark's hash relation, under about 30 MB. Beyond it a join shuffles.
BROADCAST_KEYS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sized(side: DataFrame) -> DataFrame:
    """A narrow side of a join (keys and a value or two): broadcast if it has at most BROADCAST_KEYS rows, else both sides
    are shuffled and merged."""
    few = side.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return F.broadcast(side) if few else side.hint("merge")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't among keys (unique, not null). Rows with a null key stay."""
    return rows.join(sized(keys), key, "left_anti")


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores behind it as no column of df has (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trim() -> None:
    """Gives memory that was freed back to the system, which the C library (glibc; others have no such call) else keeps."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
