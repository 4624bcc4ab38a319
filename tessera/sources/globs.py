"""Glob patterns as regular expressions, and the ignore rules of a directory and those above it."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable


def glob_regex(pattern: str) -> str:
    """* stops at slashes, ** doesn't, ? is one character, [...] and [!...] are classes; case counts."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        close = pattern.find("]", k + 2)
        if pattern.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif pattern.startswith("**", k):
            out.append(".*")
            k += 2
        elif c == "[" and close > 0:
            inner = pattern[k + 1 : close].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            k = close + 1
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
            k += 1
    return "".join(out)


def any_glob(patterns: Iterable[str]) -> str | None:
    """One regular expression that matches a whole text if any pattern does; None for no patterns."""
    found = [glob_regex(p) for p in patterns]
    return rf"(?s)\A(?:{'|'.join(found)})\z" if found else None


def ignore_globs(start: str) -> list[str]:
    """Absolute globs of the .gitignore in a directory and in those above it, up to one whose parent has a .git folder or
    that has no parent. Each line stands for itself under its directory: no negation, no folders-only, no any-depth."""
    out: list[str] = []
    folder = os.path.abspath(start)
    while True:
        rules = os.path.join(folder, ".gitignore")
        if os.path.isfile(rules):
            with open(rules, encoding="utf-8-sig", errors="replace") as lines:
                for line in map(str.strip, lines):
                    if line and not line.startswith("#"):
                        out.append(os.path.join(folder, line).replace("\\", "/"))
        above = os.path.dirname(folder)
        if above == folder or os.path.isdir(os.path.join(above, ".git")):
            return out
        folder = above
