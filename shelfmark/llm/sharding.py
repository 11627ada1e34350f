"""Sharding by fixed virtual slots.

A record's slot is a hash of its id, so it never changes; what changes is the small map from
slots to shards. The map is stored, a folder for each version: a new version edits the last one,
moving as few slots as rebalancing needs, and is written beside it.

Defined cases: a null id has slot 0; equal ids share a slot; a null or empty text has 0
bytes; an empty table gives an empty result and leaves the map as it is; of equally heavy shards and of equally large slots the lower
number is taken; a stored map of another number of slots is an error; other columns are kept out of
the result, so their names can't clash.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import shared_dir

SLOTS = 4096
SHARDS = 32


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of an id: the first 32 bits of its MD5, modulo the number of slots."""
    head = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce((head % slots).cast("int"), F.lit(0))


def slot_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Records and bytes of each slot that has any: slot, records, bytes."""
    return (
        docs.select(slot_of(F.col(id_col), slots).alias("slot"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("b"))
        .groupBy("slot")
        .agg(F.count("*").alias("records"), F.sum("b").alias("bytes"))
    )


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Version 1: equal runs of slots."""
    return [s * shards // slots for s in range(slots)]


def rebalance(current: list[int], load: dict[int, int], shards: int = SHARDS, tolerance: float = 0.05) -> list[int]:
    """The next version of a map: the heaviest shard gives its largest fitting slot to the lightest one.

    It ends when the heaviest shard is within ``tolerance`` of the mean or no move narrows the gap
    between the two. Shards beyond ``shards`` are emptied first. Ties go to the lower number.
    """
    new = list(current)
    total = [0] * max(shards, max(new, default=0) + 1)
    held: dict[int, list[tuple[int, int]]] = {}
    for slot, shard in enumerate(new):
        total[shard] += load.get(slot, 0)
        held.setdefault(shard, []).append((load.get(slot, 0), slot))
    light = [(total[s], s) for s in range(shards)]
    heapq.heapify(light)

    def give(size: int, slot: int, shard: int) -> None:
        total[new[slot]] -= size
        new[slot] = shard
        total[shard] += size
        held.setdefault(shard, []).append((size, slot))

    for shard in range(shards, len(total)):
        for size, slot in sorted(held.pop(shard, []), key=lambda x: (-x[0], x[1])):
            _, to = heapq.heappop(light)
            give(size, slot, to)
            heapq.heappush(light, (total[to], to))
    mean = sum(total) / max(shards, 1)
    for _ in range(len(new)):
        top = min(range(shards), key=lambda s: (-total[s], s))
        low = min(range(shards), key=lambda s: (total[s], s))
        gap = total[top] - total[low]
        if total[top] <= mean * (1 + tolerance):
            break
        fitting = [(size, -slot) for size, slot in held.get(top, []) if 0 < size < gap]
        if not fitting:
            break
        size, slot = max((x for x in fitting if x[0] <= gap / 2), default=min(fitting))
        slot = -slot
        held[top].remove((size, slot))
        give(size, slot, low)
    return new


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of the map stored in a folder, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        return []
    names = [(f.getPath(), f.getPath().getName()) for f in fs.listStatus(at)]
    return sorted(int(n.partition("=")[2]) for p, n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    """The shard of each slot in a stored version."""
    rows = spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}").orderBy("slot").collect()
    return [r["shard"] for r in rows]


def save_map(spark: SparkSession, path: str, version: int, mapping: list[int]) -> None:
    """Write a version beside the others; one that is there already is an error, so two writers can't both make it."""
    table = spark.createDataFrame(list(enumerate(mapping)), "slot int, shard int")
    table.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def advance(docs: DataFrame, path: str, slots: int = SLOTS, shards: int = SHARDS, tolerance: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Edit the stored map by the bytes of all slots; the number of the version to use.

    Without a stored map, the equal one is stored first. Where nothing has to move there is no new version. What
    reaches the driver is one number for each slot, whatever the size of the corpus.
    """
    spark = docs.sparkSession
    held = versions(spark, path)
    if not held:
        save_map(spark, path, 1, first_map(slots, shards))
        held = [1]
    last = load_map(spark, path, held[-1])
    if len(last) != slots:
        raise ValueError(f"the stored map has {len(last)} slots and not {slots}")
    load = {r["slot"]: r["bytes"] for r in slot_bytes(docs, id_col, text_col, slots).collect()}
    new = rebalance(last, load, shards, tolerance)
    if new == last:
        return held[-1]
    save_map(spark, path, held[-1] + 1, new)
    return held[-1] + 1


def assign(docs: DataFrame, path: str, version: int, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """The slot and shard of each record under a stored version: id, slot, shard, version.

    The map has ``slots`` rows, so it is broadcast.
    """
    table = docs.sparkSession.read.schema("slot int, shard int").parquet(f"{path}/version={version}")
    placed = docs.select(F.col(id_col).alias("_id"), slot_of(F.col(id_col), slots).alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(F.col("_id").alias(id_col), "slot", "shard", F.lit(version).alias("version"))


def shard_documents(docs: DataFrame, path: str | None = None, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Each document's place under the map stored at ``path``, which is edited by the documents' bytes; without a path a new one is stored."""
    path = path or f"{shared_dir(docs.sparkSession)}/shard-map-{uuid.uuid4().hex}"
    return assign(docs, path, advance(docs, path, slots, shards), slots=slots)
