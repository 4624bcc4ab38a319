"""Regular expressions with one dialect: only line feeds end lines, classes are those of Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (pattern, replacement, whether ^ and $ are at lines); applied in order.
Step = tuple[str, str, bool]


def replace(text: Column, pattern: str, by: str = "", lines: bool = False) -> Column:
    """by is a Java replacement: $1 is a group."""
    return F.regexp_replace(text, F.lit(("(?mdU)" if lines else "(?dU)") + pattern), F.lit(by))


def apply(text: Column, steps: list[Step]) -> Column:
    for pattern, by, lines in steps:
        text = replace(text, pattern, by, lines)
    return text


def trim(text: Column) -> Column:
    """Without white space of Unicode at either end."""
    return replace(text, r"\A\s+|\s+\z")


#: White space at the ends of lines, blank lines.
TRIM_LINES: list[Step] = [(r"^[\s\t]+|[\s\t]+$", "", True)]
CONDENSE: list[Step] = [(r"^\s*$\r?\n", "", True)]


def trim_lines(text: Column) -> Column:
    """White space around line ends goes; where lines end in a bare line feed, a blank line joins its neighbours, which
    is what the patterns say."""
    return apply(text, TRIM_LINES)


def trim_lines_apart(text: Column) -> Column:
    """An alternative that never joins lines: only spaces and tabs at their ends go."""
    return replace(text, r"^[ \t]+|[ \t]+(?=\r?$)", "", True)


def condense(text: Column) -> Column:
    return apply(text, CONDENSE)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def token_label(tokens: Column) -> Column:
    """999t, 1k, 3k: thousands are rounded half up."""
    thousands = F.round(tokens / F.lit(1000.0), 0).cast("bigint")
    return F.when(tokens < 1000, F.concat(tokens.cast("string"), F.lit("t"))).otherwise(F.concat(thousands.cast("string"), F.lit("k")))
