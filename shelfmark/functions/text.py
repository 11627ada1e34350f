"""Fuzzy string similarity, 0 to 100, by the longest common subsequence.

Each measure exists as a Column expression of built-ins, and as an Arrow UDF with the same
results; the first is interpreted (nested array folds) and suits a few thousand rows, the
second is what the operators use on distinct values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / total length; two empty strings are equal."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of the two sets of words; a subset scores 100."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, x - y, y - x
    if both and (not only_x or not only_y):
        return 100.0
    left, right = " ".join(sorted(only_x)), " ".join(sorted(only_y))
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    total_left, total_right = shared + gap + len(left), shared + gap + len(right)
    indel = len(left) + len(right) - 2 * lcs_length(left, right)
    best = 100.0 - 100.0 * indel / (total_left + total_right)
    if shared:
        best = max(best, 100.0 - 100.0 * (gap + len(left)) / (shared + total_left), 100.0 - 100.0 * (gap + len(right)) / (shared + total_right))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer, cut windows at both ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    if not n:
        return 100.0 if not m else 0.0
    if short in long:
        return 100.0
    best = 0.0
    for i in range(1 - n, m):
        window = long[max(i, 0) : i + n]
        if 200.0 * len(window) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    return best


@F.pandas_udf(DoubleType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """``token_set_ratio`` of two columns."""
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def partial_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """``partial_ratio`` of two columns."""
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two columns."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def lcs(a: Column, b: Column) -> Column:
    """LCS length as an expression: a fold over a's characters of rows of the usual table."""
    zeros = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(previous: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            value = F.when(F.substring(b, j, F.lit(1)) == x, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(previous, j), F.get(done, j - 1)))
            return F.concat(done, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    table = F.aggregate(F.split(a, ""), zeros, row, lambda last: F.element_at(last, -1))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(table)


def ratio_column(a: Column, b: Column) -> Column:
    """``ratio`` as an expression."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs(a, b) / total)


def words(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_set_column(a: Column, b: Column) -> Column:
    """``token_set_ratio`` as an expression."""
    x, y = words(a), words(b)
    both, only_x, only_y = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
    left, right = F.array_join(F.array_sort(only_x), " "), F.array_join(F.array_sort(only_y), " ")
    shared = F.length(F.array_join(both, " "))
    gap = F.when(shared > 0, 1).otherwise(0)
    la, lb = shared + gap + F.length(left), shared + gap + F.length(right)
    first = F.lit(100.0) - F.lit(100.0) * (F.length(left) + F.length(right) - 2 * lcs(left, right)) / (la + lb)
    second = F.lit(100.0) - F.lit(100.0) * (gap + F.length(left)) / (shared + la)
    third = F.lit(100.0) - F.lit(100.0) * (gap + F.length(right)) / (shared + lb)
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0))
        .when((F.size(both) > 0) & ((F.size(only_x) == 0) | (F.size(only_y) == 0)), F.lit(100.0))
        .when(shared == 0, first)
        .otherwise(F.greatest(first, second, third))
    )


def partial_column(a: Column, b: Column) -> Column:
    """``partial_ratio`` as an expression."""
    swap = F.length(a) <= F.length(b)
    short, long = F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)
    n = F.length(short)
    starts = F.sequence(F.lit(2) - n, F.length(long))
    scores = F.transform(starts, lambda i: ratio_column(short, F.substring(long, F.greatest(i, F.lit(1)), F.least(n, n + i - 1))))
    return F.when(n == 0, F.when(F.length(long) == 0, 100.0).otherwise(0.0)).otherwise(F.array_max(scores))


def spaced(name: Column) -> Column:
    """A name with spaces for underscores."""
    return F.translate(name, "_", " ")
