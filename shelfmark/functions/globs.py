"""Globs and ignore rules as regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, slash: bool = True) -> str:
    """A shell glob as an unanchored regular expression; without ``slash`` wildcards stop at '/'."""
    any_, one = (".*", ".") if slash else ("[^/]*", "[^/]")
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        close = pattern.find("]", k + 2) if c == "[" else -1
        if not slash and pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
            continue
        if not slash and pattern.startswith("**", k):
            out.append(".*")
            k += 2
            continue
        if c == "*":
            out.append(any_)
        elif c == "?":
            out.append(one)
        elif close > 0:
            body = pattern[k + 1 : close].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            k = close
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return "".join(out)


def any_glob(value: Column, patterns: list[str]) -> Column:
    """Whether a whole value matches any of the globs: one regular expression."""
    if not patterns:
        return F.lit(False)
    return value.rlike("(?s)^(?:" + "|".join(glob_regex(p) for p in patterns) + r")\z")


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file."""

    pattern: re.Pattern
    negated: bool
    directory: bool


class IgnoreRules:
    """The rules of an ignore file; the last that matches decides."""

    def __init__(self, text: str = "") -> None:
        self.rules = [r for r in map(self._rule, text.splitlines()) if r]

    @staticmethod
    def _rule(line: str) -> Rule | None:
        text = re.sub(r"(?<!\\)\s+$", "", line)
        if not text or text.startswith("#"):
            return None
        negated = text.startswith("!")
        text = text[negated:].removeprefix("\\") if text[negated:].startswith(("\\#", "\\!")) else text[negated:]
        directory = text.endswith("/")
        text = text.rstrip("/")
        if not text:
            return None
        anchored = "/" in text
        body = glob_regex(text.lstrip("/"), slash=False)
        return Rule(re.compile(f"{'' if anchored else '(?:.*/)?'}{body}", re.S), negated, directory)

    def matches(self, path: str, is_dir: bool = False) -> bool:
        """Whether the rules ignore this very path."""
        found = False
        for rule in self.rules:
            if (is_dir or not rule.directory) and rule.pattern.fullmatch(path):
                found = not rule.negated
        return found

    def ignored(self, path: str) -> bool:
        """Whether a file or any directory above it is ignored."""
        parts = path.split("/")
        return any(self.matches("/".join(parts[:k]), True) for k in range(1, len(parts))) or self.matches(path)
