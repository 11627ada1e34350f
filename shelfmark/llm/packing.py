"""Vector bin packing of training examples.

A pack has three limits at once: tokens, segments, and tokens that bear loss. Packs are filled
by the dot-product heuristic: of the examples that still fit, the next is the one whose
demands, as shares of the limits, have the greatest dot product with what the pack has left.

Examples are dealt by a hash of their id and demands into rooms of about ``ROOM`` examples, packed apart
from each other; a room leaves at most a few packs half full, whatever the size of the corpus. Equal rows
are counted before they are shuffled and dealt to rooms one by one, so no id fills a room.

A conversation beyond a limit is cut before a turn where it would exceed one, and at every ``TURNS``-th turn
number, so that a conversation of any length is cut by many tasks; a turn beyond a limit by itself is cut by
tokens. Each part has the tokens, segments and loss-bearing tokens of the turns that it holds. Other
examples beyond a limit (documents, whose tokens all bear loss) are cut into equal parts.

Defined cases: an example with no tokens (null or empty text) is placed with 0 tokens and takes
one segment; a turn with a null conversation is an example by itself; other null ids are ids like others; a
null turn number comes before all others; a role that isn't ``assistant`` bears no loss; negative or null demands count as 0; ties go to the
example of more tokens, then the lower hash, id and part; equal rows are examples apart; an empty table gives no packs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import ngram_join, spiece, textbuf
from shelfmark.session import written

TOKENS, SEGMENTS, LOSS = 4096, 16, 3072
ROOM = 2048
TURNS = 1024


def pack_room(demand: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """The pack of each row of demands [n, 3]; rows are in order of preference among equals.

    No row exceeds a limit by itself.
    """
    n = len(demand)
    share = demand / np.array(limits, float)
    order = np.arange(n)
    out = np.full(n, -1, np.int64)
    pack = 0
    while len(order):
        left = np.ones(3)
        live = order
        while len(live):
            d = share[live]
            fits = (d <= left + 1e-12).all(1)
            live = live[fits]
            if not len(live):
                break
            pick = live[int(np.argmax(d[fits] @ left))]
            out[pick] = pack
            left = left - share[pick]
            live = live[live != pick]
        order = order[out[order] < 0]
        pack += 1
    return out


def split_parts(tokens: int, segments: int, loss: int, limits: tuple[int, int, int]) -> list[tuple[int, int, int, int]]:
    """An example as parts within the limits: (first token, tokens, segments, loss-bearing tokens)."""
    tokens, segments, loss = max(tokens, 0), max(segments, 1), max(loss, 0)
    loss = min(loss, tokens)
    count = max(math.ceil(tokens / limits[0]), math.ceil(segments / limits[1]), math.ceil(loss / limits[2]), 1)
    while True:
        cut = [(tokens * k // count, tokens * (k + 1) // count) for k in range(count)]
        parts = [(a, b - a, max(1, segments * (k + 1) // count - segments * k // count), loss * (k + 1) // count - loss * k // count) for k, (a, b) in enumerate(cut)]
        if all(t <= limits[0] and s <= limits[1] and x <= limits[2] for _, t, s, x in parts):
            return parts
        count += 1


def _pack(batches: Iterator[pa.RecordBatch], limits: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Of (room, hash, id, first_turn, first, tokens, segments, loss) sorted: the placements of each room."""
    for batch, starts in ngram_join.groups(batches, "room"):
        room = batch.column("room").to_numpy()
        t, s, x, begin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", "segments", "loss", "first"))
        rows, part, first, demand, packs = [], [], [], [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own = [(k, p, *cut) for k in range(a, b) for p, cut in enumerate(split_parts(int(t[k]), int(s[k]), int(x[k]), limits))]
            own.sort(key=lambda o: (-o[3], o[0], o[1]))
            d = np.array([o[3:] for o in own], np.int64)
            packs.append(pack_room(d, limits))
            demand.append(d)
            rows += [o[0] for o in own]
            part += [o[1] for o in own]
            first += [o[2] for o in own]
        if rows:
            d = np.concatenate(demand)
            ids, turn = (batch.column(c).take(pa.array(rows)) for c in ("id", "first_turn"))
            columns = [pa.array(room[rows]), pa.array(np.concatenate(packs)), ids, turn, pa.array(part, pa.int32()), pa.array(begin[rows] + np.array(first, np.int64)), *(pa.array(np.ascontiguousarray(d[:, k])) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["room", "pack", "id", "first_turn", "part", "first_token", "tokens", "segments", "loss_tokens"])


def pack(examples: DataFrame, id_col: str, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), room: int = ROOM) -> DataFrame:
    """Placements of examples (id, tokens, segments, loss_tokens): room, pack, id, part, first_token, tokens, segments, loss_tokens.

    Examples that are parts of others may have ``first_turn`` and ``first_token``, where they begin; the placements then have ``first_turn`` too.
    """
    clean = [F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint").alias(a) for c, a in (("tokens", "tokens"), ("segments", "segments"), ("loss_tokens", "loss"))]
    parts = "first_turn" in examples.columns
    where = [F.col("first_turn").cast("bigint"), F.col("first_token").cast("bigint").alias("first")] if parts else [F.lit(None).cast("bigint").alias("first_turn"), F.lit(0).cast("bigint").alias("first")]
    base = examples.select(F.col(id_col).alias("id"), *where, *clean)
    rooms = max(1, round(base.count() / room))
    kind = base.schema["id"].dataType.simpleString()
    each = base.groupBy(*base.columns).count().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "count")))
    dealt = each.withColumn("hash", F.xxhash64(*base.columns, "copy")).withColumn("room", F.pmod("hash", F.lit(rooms)).cast("bigint")).drop("count", "copy")
    sorted_ = dealt.repartition("room").sortWithinPartitions("room", "hash", "id", "first_turn", "first")
    schema = f"room bigint, pack bigint, id {kind}, first_turn bigint, part int, first_token bigint, tokens bigint, segments bigint, loss_tokens bigint"
    placed = sorted_.mapInArrow(lambda it: _pack(it, limits), schema)
    return (placed if parts else placed.drop("first_turn")).withColumnRenamed("id", id_col)


def token_counts(texts: DataFrame, text_col: str = "text", path: str = spiece.MODEL) -> DataFrame:
    """All columns but the text, and n_tokens, the text's tokens (null or empty: 0)."""
    names = [c for c in texts.columns if c != text_col]
    base = texts.select(text_col, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = spiece.vocabulary(path)
        for batch in batches:
            data, offsets = textbuf.column(batch.column(0))
            count = [spiece.encode_texts(v, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1] for i, j in textbuf.chunks(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(count) if count else np.zeros(0, np.int64), pa.int64())], names=[*names, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != text_col)
    return base.mapInArrow(run, f"{fields}, n_tokens bigint")


def _cut(batches: Iterator[pa.RecordBatch], limits: tuple[int, int, int], joined: bool) -> Iterator[pa.RecordBatch]:
    """Turns (conv_id, block, turn, n_tokens, loss) in order to parts within the limits; without ``joined`` each turn is cut by itself."""
    names = ["conv_id", "first_turn", "first_token", "tokens", "segments", "loss_tokens"]
    part, key = None, None
    for batch in batches:
        out: list[tuple] = []
        for conv, block, turn, n, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "turn", "n_tokens", "loss")), strict=True):
            if part and (not joined or key != (conv, block) or part[3] + n > limits[0] or part[4] + 1 > limits[1] or part[5] + loss > limits[2]):
                out.append(tuple(part))
                part = None
            key = (conv, block)
            most = min(limits[0], limits[2]) if loss else limits[0]
            if n > most:  # the turn by itself is beyond a limit
                out += [(conv, turn, a, min(most, n - a), 1, min(most, n - a) if loss else 0) for a in range(0, n, most)]
            elif part:
                part[3:] = part[3] + n, part[4] + 1, part[5] + loss
            else:
                part = [conv, turn, 0, n, 1, loss]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field("conv_id").type if k == 0 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], names=names)
        last = batch
    if part:
        yield pa.RecordBatch.from_arrays([pa.array([x], last.schema.field("conv_id").type if k == 0 else pa.int64()) for k, x in enumerate(part)], names=names)


def conversation_examples(turns: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), path: str = spiece.MODEL) -> DataFrame:
    """Instruction data as examples within the limits: conv_id, first_turn, first_token (of that turn), tokens, segments (turns), loss_tokens (the assistant's tokens).

    Turns are counted once and written without their texts.
    """
    counted = token_counts(turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text"), path=path)
    block = F.floor(F.coalesce("turn", F.lit(0)) / TURNS).alias("block")
    counted = written(counted.select("conv_id", block, "turn", "n_tokens", F.when(F.col("role") == "assistant", F.col("n_tokens")).otherwise(F.lit(0)).alias("loss")), "turns")
    kind = counted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, first_turn bigint, first_token bigint, tokens bigint, segments bigint, loss_tokens bigint"
    alone = counted.where("conv_id IS NULL").mapInArrow(lambda it: _cut(it, limits, False), schema)
    sums = counted.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.when(F.bool_and(F.col("turn").isNotNull()), F.min("turn")).alias("first_turn"), F.lit(0).cast("bigint").alias("first_token"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss").alias("loss_tokens"))
    fit = (F.col("tokens") <= limits[0]) & (F.col("segments") <= limits[1]) & (F.col("loss_tokens") <= limits[2])
    long = counted.join(sums.where(~fit).select("conv_id"), "conv_id", "left_semi")
    order = ["conv_id", "block", "turn", "n_tokens", "loss"]
    cut = long.repartition("conv_id", "block").sortWithinPartitions(*order).mapInArrow(lambda it: _cut(it, limits, True), schema)
    return sums.where(fit).unionByName(cut).unionByName(alone)


def pack_conversations(turns: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """Placements of conversations; the examples are written once, then counted and packed."""
    return pack(written(conversation_examples(turns, limits), "examples"), "conv_id", limits)


def pack_documents(docs: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS)) -> DataFrame:
    """Placements of documents: one segment each, all tokens bear loss."""
    counted = token_counts(docs.select("doc_id", "text"))
    examples = counted.select("doc_id", F.col("n_tokens").alias("tokens"), F.lit(1).alias("segments"), F.col("n_tokens").alias("loss_tokens"))
    return pack(written(examples, "examples"), "doc_id", limits)
