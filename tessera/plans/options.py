"""Options of a run, and what they resolve to."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.templates import template, template_named

#: The budget of a part on the command line, and the ending that means every file.
SPLIT_TOKENS, EVERYTHING = 800_000, "*.*"

Names = tuple[str, ...] | None


@dataclass(frozen=True)
class Options:
    """None stands for "not given"; lists are tuples."""

    source_directory: str = field(default_factory=os.getcwd)
    output_directory: str = field(default_factory=lambda: str(Path.home() / "Documents" / "Bundles"))
    template: str | None = None
    include_extensions: Names = None
    exclude_extensions: Names = None
    only_extensions: Names = None
    exclude_directories: Names = None
    exclude_files: Names = None
    exclude_patterns: Names = None
    exclude_empty_files: bool = True
    exclude_auto_generated: bool = True
    output_file_name: str | None = None
    overwrite: bool = True
    recursive: bool = True
    trim_content: bool = True
    max_file_size_kb: int = 0
    ignore_binary_files: bool = True
    include_metadata: bool = False
    use_condensing: bool = True
    remove_csharp_namespaces: bool = False
    remove_csharp_comments: bool = False
    remove_csharp_regions: bool = False
    remove_csharp_usings: bool = False
    minify_xml_files: bool = True
    minify_html_and_razor: bool = True
    aggressive_csharp_reduction: bool = False
    apply_all_options: bool = False
    exclude_test_projects: bool = False
    exclude_unit_test_projects: bool = False
    respect_git_ignore: bool = True
    max_tokens: int | None = None
    split_tokens: int | None = None
    show_token_count: bool = False
    track_top_token_files: bool = False
    #: What the tokenizer's absence offline adds: a name for tessera.functions.tokens.
    tokenizer: str = "byte_bpe_50k"

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, list | set):
                object.__setattr__(self, f.name, tuple(value))
        if self.template is not None and template_named(self.template) is None:
            raise ValueError(f"Unknown template: {self.template}")

    @classmethod
    def root(cls, **given: Any) -> Options:
        """Defaults of the plain command: no template, parts of SPLIT_TOKENS; largest consumers aren't tracked."""
        return cls(**{"split_tokens": SPLIT_TOKENS, "show_token_count": True} | given | {"template": None, "track_top_token_files": False})

    @classmethod
    def dotnet(cls, all: bool = False, **given: Any) -> Options:  # noqa: A002
        """Defaults of the dotnet command; all switches every C# reduction on."""
        reductions = ("remove_csharp_namespaces", "remove_csharp_comments", "remove_csharp_regions", "remove_csharp_usings", "aggressive_csharp_reduction", "apply_all_options")
        every = dict.fromkeys(reductions, True) if all else {}
        return cls(**{"split_tokens": SPLIT_TOKENS, "show_token_count": True} | given | every | {"template": "DotNet"})

    @classmethod
    def wiki(cls, **given: Any) -> Options:
        """Defaults of the wiki command; it has no switches for test projects."""
        dropped = {"exclude_test_projects": False, "exclude_unit_test_projects": False}
        return cls(**{"split_tokens": SPLIT_TOKENS, "show_token_count": True} | given | dropped | {"template": "AzureDevOpsWiki"})


@dataclass(frozen=True)
class Resolved:
    extensions: tuple[str, ...]
    exclude_directories: tuple[str, ...]
    exclude_patterns: tuple[str, ...]


def _union(*lists: Iterable[str] | None) -> tuple[str, ...]:
    """Each name once, in the order of first mention; case counts."""
    return tuple(dict.fromkeys(name for names in lists for name in names or ()))


def resolve(options: Options) -> Resolved:
    """What to scan for. Only-extensions stand alone; without a template every file does, and excluded endings have no
    effect; with one, its endings less the excluded, plus the included."""
    own_folders, own_patterns = tuple(options.exclude_directories or ()), tuple(options.exclude_patterns or ())
    if options.only_extensions:
        return Resolved(options.only_extensions, own_folders, own_patterns)
    if options.template is None:
        return Resolved((EVERYTHING,) if options.include_extensions is None else options.include_extensions, own_folders, own_patterns)
    chosen = template(template_named(options.template) or options.template)
    dropped = set(options.exclude_extensions or ())
    return Resolved(
        _union((e for e in dict.fromkeys(chosen.extensions) if e not in dropped), options.include_extensions),
        _union(chosen.folders, own_folders),
        _union(chosen.patterns, own_patterns),
    )


def extension_list(text: Column) -> Column:
    """A comma-separated list of endings as an array: no empty ones, trimmed, each with its dot."""
    kept = F.filter(F.split(text, ","), lambda x: x != "")
    return F.transform(F.transform(kept, lambda y: F.trim(y)), lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x)))


def parse_extensions(text: str | None) -> tuple[str, ...] | None:
    """extension_list for a text on the driver; nothing given, or blank, is None."""
    if text is None or not text.strip():
        return None
    return tuple(e if e.startswith(".") else f".{e}" for e in (x.strip() for x in text.split(",") if x))


def tool_template(name: str | None) -> str | None:
    """A tool's template: blank is none; unknown names are an error."""
    if name is None or not name.strip():
        return None
    found = template_named(name)
    if found is None:
        raise ValueError(f"Unknown template: {name}")
    return found


def resource_template(name: str | None) -> str | None:
    """A resource's template: as a tool's, but `generic` is none, so every file."""
    return None if name is not None and name.strip().lower() == "generic" else tool_template(name)
