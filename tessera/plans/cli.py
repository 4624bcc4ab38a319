"""Command line: python -m tessera.plans.cli [dotnet | wiki] --directory DIR [options], or serve (or mcp) for tools."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import sys
import typing

from pyspark.sql import SparkSession

from tessera.plans.engine import pack
from tessera.plans.options import Options
from tessera.plans.serve import serve

MAKERS = {"root": Options.root, "dotnet": Options.dotnet, "wiki": Options.wiki}
#: Names of options on the command line that differ from their fields.
SHORT = {"source_directory": "directory", "output_directory": "output", "output_file_name": "name"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    out.add_argument("command", nargs="?", choices=sorted(MAKERS), default="root")
    out.add_argument("--all", action="store_true", help="every reduction of C# (dotnet)")
    kinds = typing.get_type_hints(Options)
    for f in dataclasses.fields(Options):
        name, kind = "--" + SHORT.get(f.name, f.name).replace("_", "-"), str(kinds[f.name])
        if kinds[f.name] is bool:
            out.add_argument(name, dest=f.name, action=argparse.BooleanOptionalAction, default=None)
        elif "tuple" in kind:
            out.add_argument(name, dest=f.name, type=lambda text: tuple(x.strip() for x in text.split(",") if x.strip()), default=None)
        else:
            out.add_argument(name, dest=f.name, type=int if "int" in kind else str, default=None)
    return out


def options_of(args: list[str]) -> Options:
    found = vars(parser().parse_args(args))
    command, everything = found.pop("command"), found.pop("all")
    given = {k: v for k, v in found.items() if v is not None}
    return MAKERS[command](**given, **({"all": everything} if command == "dotnet" else {}))


def main(args: list[str] | None = None) -> int:
    """Failures are shown and give 1; none is raised."""
    logging.basicConfig(level=logging.INFO, format="%(message)s", stream=sys.stderr)
    args = sys.argv[1:] if args is None else args
    try:
        if args[:1] in (["serve"], ["mcp"]):
            serve(SparkSession.builder.getOrCreate())
            return 0
        options = options_of(args)
        for path in pack(SparkSession.builder.getOrCreate(), options).generated_paths:
            print(path)
    except Exception as failure:  # shown instead, as documented
        logging.getLogger("tessera").error("%s", failure)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
