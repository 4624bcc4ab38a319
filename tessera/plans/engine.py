"""From options to a result."""

from __future__ import annotations

import contextlib
import logging
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.minify import process
from tessera.functions.tokens import token_count
from tessera.operators import filters, packing, render, sinks
from tessera.plans.options import Options, Resolved, resolve, resource_template, tool_template
from tessera.plans.templates import TEMPLATES
from tessera.session import stored
from tessera.sources.files import read_contents, read_tree
from tessera.sources.globs import ignore_globs

log = logging.getLogger("tessera")
#: Fixed value: the name in a text's footer.
NAME = "bundle"


@dataclass(frozen=True)
class Result:
    generated_paths: tuple[str, ...] = ()
    total_tokens: int = 0
    processed_files: int = 0
    total_files: int = 0
    duration: float = 0.0
    top: tuple[tuple[str, int], ...] = ()
    kilobytes: float = field(default=0.0, compare=False)


def scan(spark: SparkSession, options: Options, resolved: Resolved, globs: Iterable[str] | None = None) -> DataFrame:
    """The files that a run takes: the listing is filtered first, and only the files left are read; folders that are
    excluded aren't entered."""
    listed = read_tree(spark, options.source_directory, options.recursive, resolved.exclude_directories, metadata=True)
    for kept in filters.by_listing(options, resolved, globs or ()):
        listed = listed.where(kept)
    files = read_contents(listed)
    for kept in filters.by_content(options):
        files = files.where(kept)
    return files


def prepared(spark: SparkSession, files: DataFrame, options: Options, self_closing: bool = True) -> DataFrame:
    """files with processed content, tokens and cost; trivial ones are gone. The content is a generator's output, which the
    optimizer doesn't copy into every use of it, so that the chain of replacements runs once a file."""
    others = [c for c in files.columns if c != "content"]
    done = files.select(*others, F.explode(F.array(process(F.col("content"), F.col("extension"), options))).alias("content"))
    done = done.where(~filters.is_trivial(F.col("content"), self_closing))
    return packing.with_cost(done, token_count(spark, F.col("content"), options.tokenizer))


def bundle(spark: SparkSession, files: DataFrame, options: Options) -> DataFrame:
    """relative_path, rank, tokens, cost, part, entry of the files that fit. What is prepared is stored once; ranks, budget
    and parts are worked out on narrow rows, and contents join them again by path."""
    done = stored(prepared(spark, files, options), "prepared")
    chosen = packing.within_budget(packing.ranked(done.select("relative_path", "length", "tokens", "cost")), options.max_tokens)
    parts = packing.split_parts(chosen, options.split_tokens)
    entries = parts.join(done.select("relative_path", "content"), "relative_path")
    return entries.select("relative_path", "rank", "tokens", "cost", "part", render.entry(F.col("relative_path"), F.col("content")).alias("entry"))


class Cancelled(RuntimeError):
    """A run was ended from outside."""


class Engine:
    def __init__(self, spark: SparkSession, options: Options, clock=datetime.now):
        self.spark, self.options, self.clock = spark, options, clock
        self.resolved = resolve(options)
        self._group, self._cancelled = f"tessera-{uuid.uuid4().hex}", threading.Event()

    def cancel(self) -> None:
        """Ends a run of another thread: its Spark jobs are cancelled, and it raises Cancelled. Later runs end at once."""
        self._cancelled.set()
        self.spark.sparkContext.cancelJobGroup(self._group)

    @contextlib.contextmanager
    def _cancellable(self) -> Iterator[None]:
        context = self.spark.sparkContext
        before = context.getLocalProperty("spark.jobGroup.id")
        context.setJobGroup(self._group, "bundle", interruptOnCancel=True)
        try:
            self._go_on()
            yield
        except Exception as error:
            if self._cancelled.is_set():
                raise Cancelled("The run was cancelled.") from error
            raise
        finally:
            context.setLocalProperty("spark.jobGroup.id", before)

    def _go_on(self) -> None:
        if self._cancelled.is_set():
            raise Cancelled("The run was cancelled.")

    def files(self) -> DataFrame:
        globs = ignore_globs(self.options.source_directory) if self.options.respect_git_ignore else ()
        return scan(self.spark, self.options, self.resolved, globs)

    def run(self, files: DataFrame | None = None) -> Result:
        """Writes part files into the output directory. No files give an empty result and write nothing."""
        with self._cancellable():
            return self._run(files)

    def _run(self, files: DataFrame | None) -> Result:
        began, o = time.monotonic(), self.options
        files = (self.files() if files is None else files).persist()
        try:
            total = files.count()
            if not total:
                log.warning("No files found.")
                return Result(duration=time.monotonic() - began)
            entries = stored(bundle(self.spark, files, o), "entries")
            self._go_on()
            parts = packing.part_totals(entries).join(render.part_texts(entries), "part")
            base = render.base_name(o.source_directory, o.output_file_name, o.apply_all_options, self.clock())
            paths = sinks.write_parts(render.part_file_names(parts, base), o.output_directory, o.overwrite, now=self.clock())
            sums = packing.totals(entries).first()
            top = [(r.relative_path, r.tokens) for r in packing.top_tokens(entries).collect()] if o.track_top_token_files else []
            size = sum(os.path.getsize(p) for p in paths) / 1024
            result = Result(tuple(paths), sums.total_tokens, sums.processed_files, total, time.monotonic() - began, tuple(top), size)
            log.info(render.summary(size, result.total_tokens, result.processed_files, total, result.duration))
            for line in render.consumers(list(result.top)):
                log.info(line)
            return result
        finally:
            files.unpersist()

    def run_in_memory(self, files: DataFrame | None = None) -> Result:
        """One text in generated_paths[0]: no parts, short tags aren't trivial, largest consumers always. No files give no
        text; only trivial ones an empty text. The text is one row; whoever sets no budget must know that all of it fits."""
        with self._cancellable():
            return self._run_in_memory(files)

    def _run_in_memory(self, files: DataFrame | None) -> Result:
        began, o = time.monotonic(), self.options
        files = (self.files() if files is None else files).persist()
        try:
            total = files.count()
            if not total:
                return Result(duration=time.monotonic() - began)
            done = stored(prepared(self.spark, files, o, self_closing=False), "prepared")
            self._go_on()
            chosen = packing.within_budget(packing.ranked(done.select("relative_path", "length", "tokens", "cost")), o.max_tokens)
            entries = chosen.join(done.select("relative_path", "content"), "relative_path").withColumn("entry", render.entry(F.col("relative_path"), F.col("content")))
            entries = stored(entries, "entries")
            text = sinks.one_text(entries).first()
            sums = packing.totals(entries).first()
            top = tuple((r.relative_path, r.tokens) for r in packing.top_tokens(entries).collect())
            return Result((text.text if text else "",), sums.total_tokens, sums.processed_files, total, time.monotonic() - began, top)
        finally:
            files.unpersist()


def pack(spark: SparkSession, options: Options) -> Result:
    return Engine(spark, options).run()


def _as_text(spark: SparkSession, path: str, template: str | None, names: tuple[str, ...], build: Callable[[], Options], footer: bool) -> str:
    """What a tool answers: the text, or a text that says why there is none."""
    folder = os.path.abspath(path)
    if not os.path.isdir(folder):
        return f"Error: Directory not found: {folder}"
    try:
        options = replace(build(), source_directory=folder)
    except ValueError:
        return f"Error: Unknown template '{template}'. Valid values: {', '.join(names)}"
    try:
        found = Engine(spark, options).run_in_memory()
    except Exception as error:
        return f"Error during fusion: {error}"
    if not found.generated_paths:
        return "No files found matching the criteria."
    return found.generated_paths[0] + (render.footer(NAME, found.processed_files, found.total_files, found.total_tokens, found.duration) if footer else "")


def pack_to_string(spark: SparkSession, path: str, template: str | None = None, max_tokens: int | None = None, include_extensions: str | None = None, aggressive_minification: bool = False, tokenizer: str = "byte_bpe_50k") -> str:
    """A directory as one text with a footer of figures. include_extensions: a list with commas, of the only endings to take,
    whatever the template says. Unknown directories and templates, failures, and no files, give a text that says so."""
    only = tuple(e if e.startswith(".") else f".{e}" for e in (x.strip() for x in (include_extensions or "").split(",")) if e)

    def build() -> Options:
        return Options(
            template=tool_template(template),
            max_tokens=max_tokens,
            only_extensions=only or None,
            aggressive_csharp_reduction=aggressive_minification,
            track_top_token_files=True,
            tokenizer=tokenizer,
        )

    return _as_text(spark, path, template, tuple(TEMPLATES), build, footer=True)


def read_resource(spark: SparkSession, template: str, path: str, tokenizer: str = "byte_bpe_50k") -> str:
    """A directory as one text, without a budget or a footer; otherwise as pack_to_string. `generic` is no template."""
    return _as_text(spark, path, template, ("generic", *TEMPLATES), lambda: Options(template=resource_template(template), tokenizer=tokenizer), footer=False)
