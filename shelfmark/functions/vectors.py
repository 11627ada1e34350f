"""Embedding text, content fingerprints and cosine scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_text(prefix: str = "") -> Column:
    """What is embedded of a record: its spaced name, its signature unless empty, its summary."""
    name = F.when(F.col(f"{prefix}qualname") != "", F.col(f"{prefix}qualname")).otherwise(F.col(f"{prefix}name"))
    signature = F.when(~F.col(f"{prefix}signature").isin("", "()"), F.col(f"{prefix}signature"))
    summary = F.when(F.col(f"{prefix}docstring") != "", F.col(f"{prefix}docstring"))
    return F.concat_ws(" — ", F.translate(name, "_.", "  "), signature, summary)


def fingerprint(file: Column, line: Column, text: Column) -> Column:
    """SHA-256 of file, line and text, parted by NUL."""
    nul = F.chr(F.lit(0))
    return F.sha2(F.concat(file, nul, line.cast("string"), nul, text), 256)


def dot(a: Column, b: Column) -> Column:
    """Sum of products."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for empty vectors, unequal lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def scale(cos: Column) -> Column:
    """A cosine as a score from 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (cos + 1) * 50))
