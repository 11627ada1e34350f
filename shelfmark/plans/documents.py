"""Results as JSON documents, one row each; keys keep their order and nulls are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import search, stale, stats
from shelfmark.schema import FIELDS, SCHEMA_VERSION

_NULLS = {"ignoreNullFields": "false"}


def _json(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns), _NULLS).alias("value"))


def _listed(df: DataFrame, item: Column, order: list[Column], name: str) -> DataFrame:
    """One row: count and the items as an array, in the given order."""
    rows = df.select(F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)]).alias("at"), item.alias("item"))
    held = rows.agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("at", "item"))).alias("items"))
    return held.select("count", F.transform("items", lambda x: x["item"]).alias(name))


def bare_record(of: str = "") -> Column:
    """A record without scores; its qualified name is never empty."""
    c = {f: F.col(f"{of}{f}") for f in FIELDS}
    shown = F.when(c["qualname"] != "", c["qualname"]).otherwise(c["name"])
    return F.struct(c["name"].alias("name"), shown.alias("qualname"), *[c[f].alias(f) for f in ("file", "line", "signature", "docstring", "lang")])


def find_document(hits: DataFrame, query: str = "", sig: str | None = None, intent: bool = False, semantic: bool = False) -> DataFrame:
    """Search results; a semantic hit has a breakdown of nulls."""
    if "breakdown" not in hits.columns:
        hits = hits.withColumn("breakdown", F.struct(*[F.lit(None).cast("double").alias(k) for k in ("name", "doc", "sig")]))
    parts = F.struct(*[F.round(F.col(f"breakdown.{k}"), 1).alias(k) for k in ("name", "doc", "sig")])
    shown = F.when(F.col("qualname") != "", F.col("qualname")).otherwise(F.col("name"))
    item = F.struct("name", shown.alias("qualname"), "file", "line", "signature", "docstring", "lang", F.round("score", 1).alias("score"), parts.alias("breakdown"))
    doc = _listed(hits, item, [-F.col("score"), F.col("file"), F.col("line")], "results")
    return _json(doc, F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(query).alias("query"), F.lit(sig).cast("string").alias("sig"), F.lit(intent).alias("intent"), F.lit(semantic).alias("semantic"), "count", "results")


def clusters_document(clusters: DataFrame, threshold: float) -> DataFrame:
    """Near-duplicate clusters."""
    members = F.transform("members", lambda m: F.struct(m["name"].alias("name"), F.when(m["qualname"] != "", m["qualname"]).otherwise(m["name"]).alias("qualname"), *[m[f].alias(f) for f in ("file", "line", "signature", "docstring", "lang")]))
    item = F.struct("size", F.round("score", 1).alias("score"), members.alias("members"))
    doc = _listed(clusters, item, [-F.col("size"), -F.col("score"), F.col("members")[0]["file"], F.col("members")[0]["line"]], "clusters")
    return _json(doc, F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(round(threshold, 1)).alias("threshold"), "count", "clusters")


def _board(df: DataFrame, key: str, name: str) -> DataFrame:
    return _listed(df, F.struct(key, F.col("n").alias("count")), [-F.col("n"), F.col(key)], name).select(name)


def stats_document(records: DataFrame, top: int = stats.TOP) -> DataFrame:
    """Totals and leaderboards."""
    parts = stats.totals(records).crossJoin(_board(stats.languages(records), "lang", "languages")).crossJoin(_board(stats.top_names(records, top), "name", "top_names")).crossJoin(_board(stats.biggest_files(records, top), "file", "biggest_files"))
    return _json(parts, F.lit(SCHEMA_VERSION).alias("schema_version"), "total_functions", "total_files", F.lit(top).alias("top"), "languages", "top_names", "biggest_files")


def stale_document(records: DataFrame, sources: DataFrame, ignore: tuple[str, ...] = (), lang: str | None = None) -> DataFrame:
    """Dead-code candidates with the counters of the scan."""
    found = stale.find_stale(records, sources, ignore, lang)
    doc = _listed(found, F.struct("references", bare_record().alias("function")), [F.col("file"), F.col("line"), F.col("name")], "candidates").crossJoin(stale.counters(records, ignore, lang))
    return _json(doc, F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(lang).cast("string").alias("lang"), F.lit(stale.patterns(ignore)).alias("ignore"), "scanned", "ignored", "count", "candidates")


def matches_document(matches: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Staged records and what they resemble."""
    item = F.struct(F.round("score", 1).alias("score"), bare_record("staged.").alias("staged"), bare_record("existing.").alias("existing"))
    doc = _listed(matches, item, [-F.col("score"), F.col("staged.file"), F.col("staged.line")], "matches")
    return _json(doc, F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(round(threshold, 1)).alias("threshold"), F.lit(strict).alias("strict"), "count", "matches")


def explained(hits: DataFrame) -> DataFrame:
    """Hits with parts, the signals that apply, best first."""
    return hits.withColumn("parts", search.parts(F.col("breakdown")))
