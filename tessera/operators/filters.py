"""Which files are kept: predicates over the relation of files (path, relative_path, name, length, content)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import trim, utf16_length
from tessera.plans.options import EVERYTHING, Options, Resolved
from tessera.sources.globs import any_glob, ignore_globs

# Endings of the names of test projects, of unit-test projects; marks of generated files; the sample that
# tells binary files, the share of characters over 255 that makes one.
TEST_ENDINGS = (
    "UnitTests Tests IntegrationTests Specs Test Testing FunctionalTests AcceptanceTests EndToEndTests E2ETests TestProject"
    " TestSuite TestLib TestData TestFramework TestUtils TestUtilities TestHelper TestHelpers TestCommon TestShared"
    " TestSupport Benchmark Benchmarks Performance PerformanceTests LoadTests StressTests"
).split()
UNIT_TEST_ENDINGS = (
    "UnitTests UnitTest Tests Test Testing TestProject TestSuite TestLib TestData TestFramework TestUtils TestUtilities"
    " TestHelper TestHelpers TestCommon TestShared TestSupport"
).split()
GENERATED = ("<auto-generated", "<autogenerated")
HEAD_LINES, SAMPLE, BINARY_SHARE = 5, 8000, 0.1


def _any_ending(text: Column, endings: Iterable[str]) -> Column:
    """Whether a lower-case text ends with one of them, whatever their case."""
    return text.rlike(f"(?:{'|'.join(re.escape(e.lower()) for e in endings)})$")


def has_extension(extensions: tuple[str, ...]) -> Column:
    """The name ends with one of them (case aside), or all files count. An empty ending fits every name."""
    if EVERYTHING in extensions:
        return F.lit(True)
    return _any_ending(F.lower("name"), extensions) if extensions else F.lit(False)


def _parts() -> Column:
    return F.split(F.lower(F.translate("relative_path", "\\", "/")), "/")


def outside_folders(folders: tuple[str, ...]) -> Column:
    """No part of the relative path, the name included, is one of them (case aside)."""
    if not folders:
        return F.lit(True)
    return ~F.arrays_overlap(_parts(), F.array(*[F.lit(f.lower()) for f in folders]))


def outside_tests(endings: list[str] = TEST_ENDINGS) -> Column:
    """No part of the relative path, the name included, ends with one of them (case aside)."""
    return ~F.exists(_parts(), lambda part: _any_ending(part, endings))


def at_most(kilobytes: int) -> Column:
    return F.lit(True) if kilobytes == 0 else F.col("length") <= kilobytes * 1024


def is_text() -> Column:
    """At most BINARY_SHARE of the sample's characters are over 255; empty files are text."""
    sample = F.substring("content", 1, SAMPLE)
    odd = F.length(F.regexp_replace(sample, r"[\x00-\xFF]", ""))
    return F.coalesce(odd / F.nullif(F.length(sample), F.lit(0)) <= BINARY_SHARE, F.lit(True))


def not_empty() -> Column:
    return F.col("length") > 0


def not_generated() -> Column:
    """No mark of a generated file in the first lines."""
    head = F.slice(F.split("content", r"\r\n|\r|\n"), 1, HEAD_LINES)
    return F.coalesce(~F.exists(head, lambda line: F.lower(line).rlike("|".join(GENERATED))), F.lit(True))


def not_named(names: Iterable[str]) -> Column:
    names = [n.lower() for n in names]
    return ~F.lower("name").isin(names) if names else F.lit(True)


def outside_globs(patterns: Iterable[str]) -> Column:
    """Neither the name nor the relative path matches one of them; case counts."""
    regex = any_glob(patterns)
    if regex is None:
        return F.lit(True)
    return ~(F.col("name").rlike(regex) | F.translate("relative_path", "\\", "/").rlike(regex))


def not_ignored(globs: Iterable[str]) -> Column:
    """The path matches none of the absolute globs."""
    regex = any_glob(globs)
    return F.lit(True) if regex is None else ~F.translate("path", "\\", "/").rlike(regex)


def is_trivial(text: Column, self_closing: bool = True) -> Column:
    """Blank, only {} or [], or (if self_closing) one short tag without content."""
    bare = trim(text)
    short_tag = bare.startswith("<") & bare.endswith("/>") & (utf16_length(bare) < 10)
    trivial = (bare == "") | bare.isin("{}", "[]")
    return trivial | short_tag if self_closing else trivial


def by_listing(options: Options, resolved: Resolved, globs: Iterable[str] = ()) -> list[Column]:
    """The predicates that need no content, so that files they drop are never read."""
    out = [not_ignored(globs), has_extension(resolved.extensions), outside_folders(resolved.exclude_directories)]
    if options.exclude_test_projects:
        out.append(outside_tests(TEST_ENDINGS))
    if options.exclude_unit_test_projects:
        out.append(outside_tests(UNIT_TEST_ENDINGS))
    out.append(at_most(options.max_file_size_kb))
    if options.exclude_empty_files:
        out.append(not_empty())
    return [*out, not_named(options.exclude_files or ()), outside_globs(resolved.exclude_patterns)]


def by_content(options: Options) -> list[Column]:
    return [is_text()] * options.ignore_binary_files + [not_generated()] * options.exclude_auto_generated


def collect_files(files: DataFrame, options: Options, resolved: Resolved, globs: Iterable[str] | None = None) -> DataFrame:
    """The files that a run takes. globs: ignore rules; by default those of the source directory if options say so."""
    if globs is None:
        globs = ignore_globs(options.source_directory) if options.respect_git_ignore else ()
    for kept in [*by_listing(options, resolved, globs), *by_content(options)]:
        files = files.where(kept)
    return files
