"""Dead-code candidates: names of an inventory that no source mentions outside of their own line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.globs import any_glob
from shelfmark.session import spread, written

DEFAULT_IGNORE = ("__*__", "main", "test_*", "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule")
#: Where Python's splitlines cuts.
LINES = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
TOKEN = r"(?U)\w+"
#: Runs of word characters and '$' that have a '$'.
DOLLAR = r"(?U)[\w$]*\$[\w$]*"
#: So many bytes of names are broadcast at the most.
HELD = 8 << 20


def lines(sources: DataFrame) -> DataFrame:
    """Sources (file, content) as numbered lines: file, line, text. No line follows a final line end."""
    # the last line end goes before the cut: a line that had the whole text beside it, to know its count, would cost as much as the text
    ended = F.regexp_replace("content", rf"(?:{LINES})\z", "")
    return sources.where("content <> ''").select("file", F.posexplode(F.split(ended, LINES)).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def reference_counts(names: DataFrame, sources: DataFrame) -> DataFrame:
    """How often each line mentions each name: file, line, token, n.

    Words are cut out of each line and joined with the names, so the cost is that of the bytes and not
    of bytes times names. A name with '$' is looked for in the runs that have its first word (or, of a
    name of '$' alone, any '$'), where \\b holds at both of its ends. Names of up to ``HELD`` bytes go to every
    task, so that other words are not shuffled.
    """
    wanted = written(names.select("name").where("name <> ''").distinct(), "names")
    plain, odd = wanted.where(~F.col("name").contains("$")), wanted.where(F.col("name").contains("$"))
    if (wanted.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0) <= HELD:
        plain = F.broadcast(plain)
    dealt = spread(sources, "file")
    text = lines(dealt)
    tokens = text.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token"))
    found = tokens.join(plain.withColumnRenamed("name", "token"), "token", "left_semi")
    counted = found.groupBy("file", "line", "token").agg(F.count("*").alias("n"))
    counted = counted.select("file", "line", "token", "n")
    if odd.isEmpty():
        return counted
    text = lines(dealt.where(F.col("content").contains("$")))
    # \b beside '$' needs a word character on its other side, or none beside a word character
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.col("name"), F.lit(r"\E\b"))
    key = F.coalesce(F.nullif(F.regexp_extract("name", TOKEN, 0), F.lit("")), F.lit("$"))
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(DOLLAR), F.lit(0)))
    held = text.where(F.col("text").contains("$")).select("file", "line", "text", F.explode(F.array_distinct(F.concat(F.array(F.lit("$")), F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(TOKEN), F.lit(0))))))).alias("key"))
    odd_hits = held.join(odd.withColumn("key", key), "key").where(F.col("text").contains(F.col("name")))
    odd_counts = odd_hits.select("file", "line", F.col("name").alias("token"), F.regexp_count("text", pattern).cast("bigint").alias("n")).where("n > 0")
    return counted.unionByName(odd_counts)


def with_references(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records with total (mentions anywhere), own (on their own line) and references, the rest."""
    counts = written(reference_counts(records, sources), "mentions")  # read twice, made once
    total = counts.groupBy(F.col("token").alias("name")).agg(F.sum("n").alias("total"))
    own = counts.groupBy("file", "line", F.col("token").alias("name")).agg(F.sum("n").alias("own"))
    joined = records.join(total, "name", "left").join(own, ["file", "line", "name"], "left")
    known = joined.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("own", F.coalesce("own", F.lit(0)))
    return known.withColumn("references", F.greatest(F.col("total") - F.col("own"), F.lit(0)))


def in_language(records: DataFrame, lang: str | None) -> DataFrame:
    """Records of one language, or all."""
    return records if lang is None else records.where(F.col("lang") == lang)


def patterns(extra: tuple[str, ...] = ()) -> list[str]:
    """The globs of names never reported."""
    return [*DEFAULT_IGNORE, *extra]


def find_stale(records: DataFrame, sources: DataFrame, ignore: tuple[str, ...] = (), lang: str | None = None) -> DataFrame:
    """Candidates in order of file, line and name: the record's columns and references, always 0."""
    own = in_language(records, lang)
    eligible = own.where(~any_glob(F.col("name"), patterns(ignore)))
    order = ["file", "line", "name"] + (["seq"] if "seq" in records.columns else [])
    return with_references(eligible, sources).where("references <= 0").drop("total", "own").withColumn("references", F.lit(0)).orderBy(*order)


def counters(records: DataFrame, ignore: tuple[str, ...] = (), lang: str | None = None) -> DataFrame:
    """One row: scanned (of the language, before the globs) and ignored."""
    flagged = in_language(records, lang).select(any_glob(F.col("name"), patterns(ignore)).alias("skip"))
    return flagged.agg(F.count("*").alias("scanned"), F.count_if("skip").alias("ignored"))
