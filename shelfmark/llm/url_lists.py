"""URL filters by a temporal join with dated lists.

A list is a log of dated entries ``(pattern, kind, action, day)``: ``add`` or ``remove`` of a
``domain`` (its subdomains included) or a ``url`` (host and path, without query and fragment).
The log becomes validity intervals ``[valid_from, valid_to)``; each capture is then joined, as
of its fetch time, with the entries active at that time.

Defined cases: of several entries of one pattern at the same moment, ``remove`` wins; an entry
with a null pattern, kind or time is dropped; a capture with a null or unusable URL, or a null
fetch time, matches nothing and is kept; repeated captures each get a row; empty lists block
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import bloom

#: The list of the production query: kind, pattern, action, day.
ENTRIES = [
    ("domain", "cheap-pills.example.com", "add", "2023-02-01"),
    ("domain", "cheap-pills.example.com", "remove", "2023-06-15"),
    ("domain", "cheap-pills.example.com", "add", "2023-09-01"),
    ("domain", "adult-x.example.net", "add", "2022-11-20"),
    ("domain", "free-bets.example.com", "add", "2023-04-10"),
    ("domain", "free-bets.example.com", "remove", "2023-11-05"),
    ("domain", "spam-farm.example.org", "add", "2023-01-01"),
    ("domain", "blog.tionsh.example.net", "add", "2023-03-01"),
    ("domain", "blog.tionsh.example.net", "remove", "2023-03-20"),
    ("domain", "example.invalid", "add", "2023-01-01"),
    ("url", "ththre.example.com/fr/825", "add", "2023-01-05"),
    ("url", "therha.example.com/en/676", "add", "2023-08-01"),
    ("url", "therha.example.com/en/676", "remove", "2023-08-02"),
]


def entries(spark: SparkSession, rows: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """A list as a table: kind, pattern, action, at (timestamp)."""
    made = spark.createDataFrame(ENTRIES if rows is None else rows, "kind string, pattern string, action string, day string")
    return made.select("kind", "pattern", "action", F.try_to_timestamp("day").alias("at"))


def intervals(log: DataFrame) -> DataFrame:
    """Validity intervals of the log: kind, pattern, valid_from, valid_to (null: still valid)."""
    whole = log.where(F.col("kind").isNotNull() & F.col("pattern").isNotNull() & F.col("at").isNotNull())
    state = whole.groupBy("kind", F.lower("pattern").alias("pattern"), "at").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    by = Window.partitionBy("kind", "pattern").orderBy("at")
    turned = state.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(0))).where(F.col("on") != F.col("was"))
    return turned.withColumn("valid_to", F.lead("at").over(by)).where("on = 1").select("kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    """Host without user, port and case; '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    """Host and path in lower case, with neither query, fragment nor final slash."""
    bare = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^?#]*)", 1)
    return F.lower(F.regexp_replace(bare, r"/+$", ""))


def filter_captures(captures: DataFrame, log: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Every capture with what blocked it: id, url, fetched_at, blocked, kind, pattern, listed_at.

    A capture's candidates are its host, each parent domain of the host, and its host and path; they
    meet the intervals in an equi-join, with the fetch time as a residual range condition. A Bloom filter of 32 MB
    at the most holds back candidates that no interval names, so that a hot host or domain isn't shuffled. Of
    several active entries the one listed first is named, then the lower kind and pattern.
    """
    base = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"))
    parts = F.split(host_of(F.col("url")), r"\.")
    count = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("domain:"), F.concat_ws(".", F.slice(parts, i, count))))
    keys = F.concat(domains, F.array(F.concat(F.lit("url:"), path_of(F.col("url")))))
    spread = base.withColumn("key", F.explode(F.array_distinct(keys)))
    spans = intervals(log).select(F.concat_ws(":", "kind", "pattern").alias("key"), "kind", "pattern", "valid_from", "valid_to")
    active = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    # keys that no interval has aren't shuffled, such as the bare "com" that a third of all captures may have
    spread = spread.where(bloom.maybe_in(spans.select("key").distinct(), F.col("key")))
    hits = spread.join(spans, "key").where(active).groupBy(F.col("id").alias("m_id"), F.col("url").alias("m_url"), F.col("fetched_at").alias("m_at"))
    matched = hits.agg(F.min(F.struct("valid_from", "kind", "pattern")).alias("hit"))
    same = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("url") == F.col("m_url")) & (F.col("fetched_at") == F.col("m_at"))
    named = [F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched_at").alias(time_col)]
    return base.join(matched, same, "left").select(*named, F.col("hit").isNotNull().alias("blocked"), "hit.kind", "hit.pattern", F.col("hit.valid_from").alias("listed_at"))
