"""A Spark data source for a tree of text files: hidden and empty ones too, decoded by their byte order mark."""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringEndsWith

from tessera.session import reach

SCHEMA = "path string, relative_path string, name string, extension string, length bigint, modification_time timestamp, content string"
#: Bytes of files that one task reads.
PARTITION = 32 << 20
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode(data: bytes) -> str:
    """By the byte order mark, which goes; UTF-8 without one. What can't be decoded becomes replacement characters."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode("utf-8", "replace")


def extension_of(name: str) -> str:
    """From the last dot on, in lower case; none without a dot."""
    dot = name.rfind(".")
    return name[dot:].lower() if dot >= 0 else ""


class Slice(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        super().__init__(files)


class TreeReader(DataSourceReader):
    """Options: path (the tree's root), recursive, excluded (folder names that aren't entered, separated by slashes),
    metadata (no contents are read)."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.metadata = str(options.get("metadata", "false")).lower() == "true"
        self.excluded = {x.lower() for x in options.get("excluded", "").split("/") if x}
        self.low, self.high, self.endings = -1, float("inf"), []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Bounds of length and endings of name are applied to the listing, before any file is read."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("length",) and isinstance(f, LessThanOrEqual | LessThan):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif column == ("length",) and isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column == ("name",) and isinstance(f, StringEndsWith):
                self.endings.append(f.value)
            else:
                yield f

    def _listed(self) -> Iterator[tuple[str, int, float]]:
        for folder, below, names in os.walk(self.root):
            below[:] = sorted(d for d in below if d.lower() not in self.excluded) if self.recursive else []
            for name in sorted(names):
                place = os.path.join(folder, name)
                try:
                    about = os.stat(place)
                except OSError:
                    continue
                if self.low <= about.st_size <= self.high and all(name.endswith(e) for e in self.endings):
                    yield place, about.st_size, about.st_mtime

    def partitions(self) -> list[Slice]:
        if not os.path.isdir(self.root):
            raise ValueError(f"Directory not found: {self.root}")
        out, held, size = [], [], 0
        for file in self._listed():
            held.append(file)
            size += 0 if self.metadata else file[1]
            if size >= PARTITION or len(held) >= 10_000:
                out.append(Slice(held))
                held, size = [], 0
        return [*out, Slice(held)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for place, size, changed in partition.value:
            content = None
            if not self.metadata:
                with open(place, "rb") as f:
                    content = decode(f.read())
            name = os.path.basename(place)
            yield place, os.path.relpath(place, self.root).replace(os.sep, "/"), name, extension_of(name), size, datetime.fromtimestamp(changed, UTC), content


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, recursive: bool = True, excluded: tuple[str, ...] = (), metadata: bool = False) -> DataFrame:
    """Files under root, which every node must see. Folders whose name is excluded (whatever its case) aren't entered."""
    reach(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("repo_files").option("path", root).option("recursive", str(recursive)).option("metadata", str(metadata))
    return reader.option("excluded", "/".join(e for e in excluded if "/" not in e)).load()


def read_contents(listed: DataFrame) -> DataFrame:
    """The files of a listing (read_tree with metadata, and whatever filters) with their contents: only these are opened, on
    the executors, about PARTITION bytes a task. A file that has gone since has a null content."""
    size = listed.agg(F.sum("length")).first()[0] or 0

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part, contents = pdf.iloc[at : at + 64], []
                for place in part.path:
                    try:
                        with open(place, "rb") as f:
                            contents.append(decode(f.read()))
                    except FileNotFoundError:
                        contents.append(None)
                yield part.assign(content=contents)

    return listed.repartition(max(1, -(-size // PARTITION))).mapInPandas(read, SCHEMA)


__all__ = ["SCHEMA", "TreeSource", "decode", "extension_of", "read_contents", "read_tree"]
