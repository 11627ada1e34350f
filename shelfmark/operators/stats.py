"""Inventory leaderboards: totals, languages, repeated names, biggest files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 10
CALL_OUT = 3


def grouped_counts(records: DataFrame) -> DataFrame:
    """All counts in one pass by grouping sets: kind (lang, name, file), key, n."""
    spread = records.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("lang", "name", "file")])).alias("x"))
    return spread.groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))


def languages(records: DataFrame) -> DataFrame:
    """Records by language, most first: lang, n. Never capped."""
    return records.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


def _ranked(counts: DataFrame, key: str, top: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), key).limit(max(0, top))


def top_names(records: DataFrame, top: int = TOP) -> DataFrame:
    """Names that occur twice or more, most first: name, n."""
    return _ranked(records.groupBy("name").agg(F.count("*").alias("n")).where("n >= 2"), "name", top)


def biggest_files(records: DataFrame, top: int = TOP) -> DataFrame:
    """Files of most records: file, n."""
    return _ranked(records.groupBy("file").agg(F.count("*").alias("n")), "file", top)


def totals(records: DataFrame) -> DataFrame:
    """One row: records, distinct files, whether there are none."""
    return records.agg(F.count("*").alias("total_functions"), F.count_distinct("file").alias("total_files"), (F.count("*") == 0).alias("is_empty"))


def call_out(records: DataFrame, least: int = CALL_OUT) -> DataFrame:
    """The most repeated name, if it occurs often enough: name, n."""
    return top_names(records, 1).where(F.col("n") >= least)


def by_language(records: DataFrame) -> DataFrame:
    """Records by language in order of language: lang, n."""
    return records.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")
