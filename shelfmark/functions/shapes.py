"""Signature shapes: parsing to type tokens, and their asymmetric similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.schema import SHAPE

ALIASES = {"boolean": "bool", "integer": "int", "string": "str", "nonetype": "none", "object": "any"}
UNTYPED = {"self", "cls", "*", "/"}
Shape = tuple[list[str], str, bool]


def normalise_type(token: str) -> str:
    """Lower-case type token without subscript, module and quotes; aliases are one."""
    bare = token.strip().partition("[")[0].strip().rpartition(".")[2].strip("\"' ").lower()
    return ALIASES.get(bare, bare) or "any"


def split_params(text: str) -> list[str]:
    """Comma-separated parts, but not within brackets."""
    parts, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "[({") - (c in "])}" and depth > 0)
        if c == "," and not depth:
            parts.append(text[at:k])
            at = k + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def param_type(raw: str, query: bool) -> str | None:
    """The type token of a parameter; none for receivers and markers."""
    text = raw.strip()
    if not text or text in UNTYPED:
        return None
    if text.startswith("*"):
        return "*"
    text = text.partition("=")[0].strip()
    name, colon, hint = text.partition(":")
    if colon:
        return None if name.strip() in UNTYPED else normalise_type(hint)
    if name.strip() in UNTYPED:
        return None
    return normalise_type(text) if query else "any"


def parse_signature(text: str, query: bool = False) -> Shape:
    """A signature's parameter types, return type, and whether that was given. In a query bare words are types."""
    head, arrow, tail = text.strip().rpartition("->")
    if not arrow:
        head, tail = tail, ""
    inner = re.search(r"\((.*)\)", head, re.S)
    kinds = (param_type(p, query) for p in split_params(inner[1] if inner else head))
    hint = bool(tail.strip())
    return [k for k in kinds if k is not None], normalise_type(tail) if hint else "any", hint


def looks_like_signature(text: str) -> bool:
    """Whether a query reads as a signature: an arrow, or something in parentheses."""
    return "->" in text or re.search(r"\(.*\)", text, re.S) is not None


def looks_like_signature_column(text: Column) -> Column:
    """``looks_like_signature`` as an expression."""
    return text.contains("->") | text.rlike(r"(?s)\(.*\)")


@F.pandas_udf(SHAPE)
def shape_udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``parse_signature`` of stored signatures; each distinct text of a batch is parsed once."""
    for s in parts:
        seen = {x: parse_signature(x or "") for x in set(s)}
        yield pd.DataFrame([seen[x] for x in s], columns=["params", "returns", "has_return_hint"])


def shape_literal(text: str) -> Column:
    """A query's shape as a literal; it is parsed once, on the driver."""
    params, returns, hint = parse_signature(text, query=True)
    return F.struct(F.lit(params).cast("array<string>").alias("params"), F.lit(returns).alias("returns"), F.lit(hint).alias("has_return_hint"))


def types_match(a: Column, b: Column) -> Column:
    """1 for equal types, a half where one is unknown, else 0."""
    return F.when(a == b, 1.0).when((a == "any") | (b == "any"), 0.5).otherwise(0.0)


def shape_score(query: Column, candidate: Column) -> Column:
    """How well a candidate's shape serves a query's, 0 to 100: half arity, half types."""
    q, c = query["params"], candidate["params"]
    qn, cn = F.size(q), F.size(c)
    star = F.array_contains(c, "*")
    gap = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(qn - cn) / F.greatest(qn, cn, F.lit(1)))
    arity = F.when(qn == cn, 1.0).when(star & (qn >= cn - 1), 0.9).otherwise(gap)
    both = F.least(qn, cn)
    slots = F.aggregate(F.zip_with(F.slice(q, 1, both), F.slice(c, 1, both), types_match), F.lit(0.0), lambda s, x: s + x)
    lacking = F.when(star, 0).otherwise(F.greatest(qn - cn, F.lit(0)))
    hinted = F.when(query["has_return_hint"], 1).otherwise(0)
    returned = F.when(query["has_return_hint"], types_match(query["returns"], candidate["returns"])).otherwise(0.0)
    count = both + lacking + hinted
    types = F.when(count > 0, (slots + returned) / count).otherwise(arity)
    blank = (qn == 0) & ~query["has_return_hint"]
    return F.when(blank, 0.0).otherwise(F.round(F.lit(50.0) * arity + F.lit(50.0) * types, 2))


def shape_score_py(query: Shape, candidate: Shape) -> float:
    """``shape_score`` in Python, for tests and driver-side use."""
    q, c = query[0], candidate[0]
    if not q and not query[2]:
        return 0.0

    def match(a: str, b: str) -> float:
        return 1.0 if a == b else 0.5 if "any" in (a, b) else 0.0

    star = "*" in c
    arity = 1.0 if len(q) == len(c) else 0.9 if star and len(q) >= len(c) - 1 else max(0.0, 1 - abs(len(q) - len(c)) / max(len(q), len(c), 1))
    slots = [match(a, b) for a, b in zip(q, c, strict=False)] + [0.0] * (0 if star else max(len(q) - len(c), 0))
    if query[2]:
        slots.append(match(query[1], candidate[1]))
    types = sum(slots) / len(slots) if slots else arity
    return round(50 * arity + 50 * types, 2)
