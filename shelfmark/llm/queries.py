"""Queries and oracle SQL of the operators of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import fertility, langid, ngram_join, packing, pii, secret_scan, sharding, spiece, topk, url_lists


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near documents, its class of copies, and the number of its links."""
    return ngram_join.near_classes(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT DISTINCT doc_id AS id, list_sort(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM w),
o AS (SELECT s, len(s) AS n, min(id) AS rep, count(*) AS m, row_number() OVER (ORDER BY s) AS k FROM e WHERE len(s) > 0 GROUP BY s),
x AS (SELECT k, n, m, unnest(s) AS gram FROM o),
p AS (SELECT l.k AS a, r.k AS b, any_value(l.n) AS na, any_value(r.n) AS nb, any_value(r.m) AS m, count(*) AS shared FROM x l JOIN x r ON l.gram = r.gram AND l.k <> r.k GROUP BY 1, 2),
near AS (SELECT a, b, m FROM p WHERE shared >= 0.5 * (na + nb - shared)),
links AS (SELECT a, sum(m) AS links FROM near GROUP BY a),
reach AS (SELECT k, k AS other FROM o UNION SELECT reach.k, near.b FROM reach JOIN near ON reach.other = near.a),
class AS (SELECT reach.k, min(o.rep) AS class_id FROM reach JOIN o ON reach.other = o.k GROUP BY reach.k)
SELECT e.id AS doc_id, coalesce(class_id, e.id) AS class_id, coalesce(o.rep, e.id) AS copy_id, coalesce(o.m, 1) AS copies, (coalesce(links.links, 0) + coalesce(o.m, 1) - 1)::BIGINT AS links
FROM e LEFT JOIN o ON e.s = o.s LEFT JOIN links ON links.a = o.k LEFT JOIN class ON class.k = o.k
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placement of every conversation in packs."""
    return packing.pack_conversations(_table(spark, sf_dir, "conversations"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether decoding them gives its text again."""
    return spiece.encode(_table(spark, sf_dir, "documents"), check=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, redacted, with its spans."""
    return pii.redact(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and whether it is accepted."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest, among all embeddings, of every one whose id is divisible by 20."""
    out = topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", asked=F.col("vec_id") % 20 == 0)
    return out.select(F.col("query").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), F.round("score", 6).alias("score"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id, c.vec_id AS neighbour_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, neighbour_id) AS rank FROM s)
SELECT vec_id, rank::INTEGER AS rank, neighbour_id, round(score, 6) AS score FROM r WHERE rank <= 10
"""


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return fertility.quality(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, scored."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"), everything=True)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document under the rebalanced map."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def slot_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and bytes of each slot: what the map is rebalanced by."""
    return sharding.slot_bytes(_table(spark, sf_dir, "documents"))


SLOTS_SQL = f"""SELECT coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {sharding.SLOTS}, 0)::INTEGER AS slot, count(*) AS records,
sum(coalesce(octet_length(encode(text)), 0))::BIGINT AS bytes FROM documents GROUP BY 1"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures: the fetch time is derived from the id, since the table has none."""
    second = F.lit(1672531200) + (F.col("page_id") * 7919 % 365) * 86400 + F.col("page_id") % 86400
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(second).alias("fetched_at"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture, with the list entry that was active when it was fetched."""
    out = url_lists.filter_captures(captures(spark, sf_dir), url_lists.entries(spark))
    return out.select("page_id", "url", F.unix_seconds("fetched_at").alias("fetched_s"), "blocked", "kind", "pattern", F.coalesce(F.unix_seconds("listed_at"), F.lit(-1)).alias("listed_s"))


OP10_SQL = """
WITH log(kind, pattern, action, day) AS (VALUES {values}),
state AS (SELECT kind, lower(pattern) AS pattern, epoch(day::TIMESTAMP)::BIGINT AS at_s, min(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS is_on
          FROM log GROUP BY ALL),
turned AS (SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY kind, pattern ORDER BY at_s), 0) AS was FROM state) WHERE is_on <> was),
spans AS (SELECT * FROM (SELECT kind, pattern, at_s, is_on, lead(at_s) OVER (PARTITION BY kind, pattern ORDER BY at_s) AS to_s FROM turned) WHERE is_on = 1),
caps AS (SELECT page_id, url, (1672531200 + (page_id * 7919 % 365) * 86400 + page_id % 86400)::BIGINT AS fetched_s,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^?#]*)', 1), '/+$', '')) AS path
         FROM pages),
hits AS (SELECT page_id, min(struct_pack(at_s := at_s, kind := kind, pattern := pattern)) AS hit FROM caps JOIN spans
         ON ((kind = 'domain' AND (host = pattern OR ends_with(host, '.' || pattern))) OR (kind = 'url' AND path = pattern))
         AND fetched_s >= at_s AND (to_s IS NULL OR fetched_s < to_s) GROUP BY page_id)
SELECT caps.page_id, caps.url, fetched_s, hit IS NOT NULL AS blocked, hit.kind AS kind, hit.pattern AS pattern, coalesce(hit.at_s, -1)::BIGINT AS listed_s
FROM caps LEFT JOIN hits ON caps.page_id = hits.page_id
""".replace("{values}", ", ".join(str(x) for x in url_lists.ENTRIES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The query of each operator."""
    return {"op1_ngram_join": op1_ngram_join, "op2_packing": op2_packing, "op3_sentencepiece": op3_sentencepiece, "op4_pii": op4_pii, "op5_language_id": op5_language_id, "op6_topk": op6_topk, "op7_fertility": op7_fertility, "op8_secret_scan": op8_secret_scan, "op9_sharding": op9_sharding, "slot_bytes": slot_bytes, "op10_url_filter": op10_url_filter}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express."""
    return {"op1_ngram_join": OP1_SQL, "op6_topk": OP6_SQL, "slot_bytes": SLOTS_SQL, "op10_url_filter": OP10_SQL}
