"""Text for terminals, from collected small results."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import Any

BOLD, DIM, CYAN, OFF = "\033[1m", "\033[2m", "\033[36m", "\033[0m"


def _paint(text: str, code: str, color: bool) -> str:
    return f"{code}{text}{OFF}" if color else text


def use_color(stream: Any = None) -> bool:
    """Whether a stream is a terminal."""
    return bool(getattr(stream or sys.stdout, "isatty", lambda: False)())


def place(r: Any, color: bool = False) -> str:
    """name, file:line and signature of a record."""
    return f"{_paint(r['qualname'] or r['name'], BOLD, color)} | {_paint(f'{r["file"]}:{r["line"]}', CYAN, color)} | {r['signature'] or '()'}"


def results(query: str, hits: Iterable[Any], explain: bool = False, color: bool = False) -> str:
    """Search hits."""
    rows = list(hits)
    label = repr(query) if query.strip() else "that shape"
    out = [_paint(f"{len(rows)} like {label}:", BOLD, color) if rows else f"Nothing like {label} is indexed."]
    for r in rows:
        out.append(f"  {place(r, color)}")
        if r["docstring"]:
            out.append(_paint(f"      {r['docstring']}", DIM, color))
        if explain:
            b = r["breakdown"] if "breakdown" in r else None
            parts = sorted(((k, b[k]) for k in ("name", "doc", "sig") if b[k] is not None), key=lambda x: -x[1]) if b else []
            why = ", ".join(f"{k} {v:.0f}" for k, v in parts)
            out.append(_paint(f"      score {r['score']:.0f}" + (f" ({why})" if why else ""), DIM, color))
    return "\n".join(out)


def clusters(found: Iterable[Any], color: bool = False) -> str:
    """Near-duplicate clusters."""
    rows = list(found)
    out = [_paint(f"{len(rows)} clusters of near-duplicates:", BOLD, color) if rows else "No near-duplicates."]
    for c in rows:
        out += ["", f"{c['size']} functions, {c['score']:.0f} % alike", *(f"  {place(m, color)}" for m in c["members"])]
    return "\n".join(out)


def matches(found: Iterable[Any], color: bool = False) -> str:
    """Staged records and what they resemble."""
    rows = list(found)
    out = [_paint(f"{len(rows)} staged functions resemble indexed ones:", BOLD, color) if rows else "Nothing staged resembles an indexed function."]
    for m in rows:
        out += [f"  {place(m['staged'], color)}", f"    {m['score']:.0f} % like {place(m['existing'], color)}"]
    return "\n".join(out)


def _board(title: str, rows: list[tuple[str, int]]) -> list[str]:
    wide = max((len(str(n)) for _, n in rows), default=0)
    return ["", title, *(f"  {n:>{wide}}  {k}" for k, n in rows)] if rows else []


def stats(total: Any, languages: list, names: list, files: list, least: int = 3, color: bool = False) -> str:
    """Totals and leaderboards, and a word on the most repeated name."""
    if not total["total_functions"]:
        return "The index has no functions."
    out = [_paint(f"{total['total_functions']} functions in {total['total_files']} files", BOLD, color)]
    out += _board("Languages", languages) + _board("Repeated names", names) + _board("Biggest files", files)
    if names and names[0][1] >= least:
        out += ["", f"{names[0][0]} is defined {names[0][1]} times."]
    return "\n".join(out)


def stale(found: Iterable[Any], scanned: int, ignored: int, color: bool = False) -> str:
    """Dead-code candidates."""
    rows = list(found)
    head = f"{len(rows)} of {scanned} functions are mentioned nowhere else ({ignored} ignored):" if rows else f"All of {scanned} functions are mentioned somewhere ({ignored} ignored)."
    return "\n".join([_paint(head, BOLD, color), *(f"  {place(r, color)}" for r in rows)])
