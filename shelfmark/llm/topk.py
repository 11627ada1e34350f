"""Exact top-k search by distributed histogram selection.

Queries are vectors of the table, all of them or a stated set; each is scored against all others. A
histogram of each query's scores, summed over the blocks of the corpus, shows in which bin its k-th score
lies, and that bin is refined by the next histogram, round by round, until no query has more than ``CROWD`` times k
scores from its bin's lower edge up, or the bin is as narrow as float32 can tell apart, so that it holds ties. Scores
from that edge up pass a final filter, are scored again in float64, and ranked by the
score rounded to ``DIGITS`` digits, which makes exact ties equal; ties go to the lower id. Nothing of the size of
the corpus is broadcast or collected: blocks of vectors meet block by block.

Scores for the histograms are float32 products, off by less than ``SLOP``; edges are lowered by
that much, so no answer is lost. Of a block, a query's best k can be among its k best, and only they leave the block.

The score is the cosine. Defined cases: null vectors, null ids and vectors with a null or
non-finite entry or of another length than most are left out; a zero vector has score 0 with
all; a vector isn't its own neighbour, but an equal one of another id is; a repeated id keeps its
first vector in order of values; ids may be of any type that has an order; fewer than k others give as many rows; an
empty table, or one without queries, none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.ngram_join import groups
from shelfmark.session import written

K = 10
BLOCK = 8192
BINS = 64
CROWD = 4
DIGITS = 12
SLOP = 4e-6
ROWS = 256


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1; zero vectors stay."""
    norm = np.sqrt((v * v).sum(1))
    return v / np.where(norm > 0, norm, 1)[:, None]


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Of (block, id, asked, v) sorted by block: a row for each block."""
    for batch, starts in groups(batches, "block"):
        block = batch.column("block").to_numpy()
        asked = batch.column("asked").to_numpy(zero_copy_only=False)
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        v = unit(flat)
        ids = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), batch.column("id"))
        cut = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        columns = [pa.array(block[starts[:-1]]), ids, pa.array([asked[a:b].tobytes() for a, b in cut]), pa.array([v[a:b].tobytes() for a, b in cut])]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "asked", "vectors"])


def _queries(batches: Iterator[pa.RecordBatch], dim: int, count: int) -> Iterator[pa.RecordBatch]:
    """The queries of each block, dealt into blocks of queries: q_block, id, own block, place in it, vector."""
    for batch in batches:
        for r in range(batch.num_rows):
            at = np.flatnonzero(np.frombuffer(batch.column("asked")[r].as_py(), bool))
            block = batch.column("block")[r].as_py()
            v = _matrix(batch.column("vectors")[r].as_py(), dim)[at]
            columns = [pa.array((at + block) % count), batch.column("ids")[r].values.take(pa.array(at)), pa.array(np.full(len(at), block)), pa.array(at), pa.array([x.tobytes() for x in v], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["q_block", "id", "own", "place", "v"])


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of queries sorted by their block: a row for each block."""
    for batch, starts in groups(batches, "q_block"):
        ids = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), batch.column("id"))
        own, place = batch.column("own").to_numpy(), batch.column("place").to_numpy()
        cut = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        columns = [pa.array(batch.column("q_block").to_numpy()[starts[:-1]]), ids, *(pa.array([x[a:b].tobytes() for a, b in cut]) for x in (own, place)), pa.array([b"".join(batch.column("v")[a:].slice(0, b - a).to_pylist()) for a, b in cut])]
        yield pa.RecordBatch.from_arrays(columns, names=["q_block", "q_ids", "own", "place", "q_vectors"])


def _pairs_of(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each pair of blocks: the query block, its vectors, each query's place in the other block (-1: not there), that one's vectors."""
    for r in range(batch.num_rows):
        q, c = _matrix(batch.column("q_vectors")[r].as_py(), dim), _matrix(batch.column("c_vectors")[r].as_py(), dim)
        own, place = np.frombuffer(batch.column("own")[r].as_py(), np.int64), np.frombuffer(batch.column("place")[r].as_py(), np.int64)
        yield batch.column("q_block")[r].as_py(), q, np.where(own == batch.column("c_block")[r].as_py(), place, -1), c, r


def _scores(q: np.ndarray, c: np.ndarray, self_: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Score rows in slices; a vector's score with itself is below all."""
    c32 = c.astype(np.float32).T.copy()
    for a in range(0, len(q), ROWS):
        s = q[a : a + ROWS].astype(np.float32) @ c32
        here = np.flatnonzero(self_[a : a + ROWS] >= 0)
        s[here, self_[a : a + ROWS][here]] = -9
        yield a, s


def _histograms(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Counts of each query's scores in the bins of its range, of one pair of blocks."""
    for batch in batches:
        for block, q, self_, c, r in _pairs_of(batch, dim):
            low = np.frombuffer(batch.column("low")[r].as_py(), np.float64)
            width = batch.column("width")[r].as_py()
            count = np.zeros((len(q), BINS + 1), np.int32)
            for a, s in _scores(q, c, self_):
                n = len(s)
                bins = ((s - low[a : a + n, None].astype(np.float32)) * np.float32(BINS / width)).astype(np.int32)
                np.clip(bins, -1, BINS, out=bins)
                bins += np.arange(n, dtype=np.int32)[:, None] * (BINS + 2) + 1
                count[a : a + n] = np.bincount(bins.ravel(), minlength=n * (BINS + 2)).reshape(n, BINS + 2)[:, 1:]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([low.tobytes()]), pa.array([width]), pa.array([count.tobytes()])], names=["q_block", "low", "width", "count"])


def _located(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of histograms sorted by query block: the bin of each query's k-th score, as the next range, and how many scores reach it at the most."""
    for batch, starts in groups(batches, "q_block"):
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            low = np.frombuffer(batch.column("low")[int(a)].as_py(), np.float64)
            width = batch.column("width")[int(a)].as_py()
            total = np.zeros((len(low), BINS + 1), np.int64)
            for r in range(a, b):
                total += np.frombuffer(batch.column("count")[int(r)].as_py(), np.int32).reshape(len(low), BINS + 1)
            above = np.cumsum(total[:, ::-1], 1)[:, ::-1]
            at = np.maximum((above >= k).sum(1) - 1, 0)
            step = width / BINS
            new = np.where(above[:, 0] >= k, low + np.minimum(at, BINS - 1) * step - SLOP, low)
            crowd = np.take_along_axis(above, np.minimum(at, BINS - 1)[:, None], 1).max() if len(at) else 0
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("q_block")[int(a)].as_py()]), pa.array([new.tobytes()]), pa.array([step + 2 * SLOP]), pa.array([int(crowd)])], names=["q_block", "low", "width", "crowd"])


def _filtered(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The scores that can be among the k best, scored again in float64 in a fixed order."""
    for batch in batches:
        for _, q, self_, c, r in _pairs_of(batch, dim):
            low = np.frombuffer(batch.column("low")[r].as_py(), np.float64) - SLOP
            left, right = [], []
            for a, s in _scores(q, c, self_):
                n = len(s)
                edge = np.maximum(low[a : a + n].astype(np.float32), np.float32(-2))
                row, col = np.nonzero(s >= edge[:, None])
                if s.shape[1] > k and len(row):
                    crowded = np.flatnonzero(np.bincount(row, minlength=n) > k)
                    if len(crowded):
                        kth = np.partition(s[crowded], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - np.float32(2 * SLOP)
                        edge = edge.copy()
                        edge[crowded] = np.maximum(edge[crowded], kth)
                        good = s[row, col] >= edge[row]
                        row, col = row[good], col[good]
                left.append(row + a)
                right.append(col)
            i, j = np.concatenate(left), np.concatenate(right)
            score = np.zeros(len(i))
            for d in range(dim):  # one addition after another, so that equal pairs have equal scores everywhere
                score += q[i, d] * c[j, d]
            key = np.round(score, DIGITS)
            order = np.lexsort((j, -key, i))  # a block is sorted by id
            i, j, score, key = i[order], j[order], score[order], key[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            best = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            i, j, score, key = i[best], j[best], score[best], key[best]
            ids = [batch.column(x)[r].values.take(pa.array(at)) for x, at in (("q_ids", i), ("c_ids", j))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(score), pa.array(key)], names=["query", "id", "score", "key"])


def top_k(vectors: DataFrame, id_col: str, vector_col: str, k: int = K, block: int = BLOCK, asked: Column | None = None) -> DataFrame:
    """The k nearest of each vector for which ``asked`` is true (of all, without it) by cosine: query, rank, id, score."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    valid = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ask = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    base = vectors.select(F.col(id_col).alias("id"), v.alias("v"), ask.alias("asked")).where(F.col("id").isNotNull() & valid)
    kind = base.schema["id"].dataType.simpleString()
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.countDistinct("id").alias("n"), F.countDistinct(F.when(F.col("asked"), F.col("id"))).alias("q")).orderBy(F.desc("n"), "dim").first()
    schema = f"query {kind}, id {kind}, score double, key double"
    if sizes is None or sizes["dim"] == 0 or sizes["q"] == 0:
        return spark.createDataFrame([], schema).select("query", F.lit(1).alias("rank"), "id", "score")
    dim = int(sizes["dim"])
    count, q_count = (max(1, math.ceil(int(sizes[x]) / block)) for x in ("n", "q"))
    one = base.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    dealt = one.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("bigint"))
    packed = dealt.repartition(count, "block").sortWithinPartitions("block", "id").select("block", "id", "asked", "v")
    blocks = written(packed.mapInArrow(lambda it: _blocks(it, dim), f"block bigint, ids array<{kind}>, asked binary, vectors binary"), "blocks")
    listed = blocks.mapInArrow(lambda it: _queries(it, dim, q_count), f"q_block bigint, id {kind}, own bigint, place bigint, v binary")
    gathered = listed.repartition(q_count, "q_block").sortWithinPartitions("q_block")
    q = written(gathered.mapInArrow(_query_blocks, f"q_block bigint, q_ids array<{kind}>, own binary, place binary, q_vectors binary"), "queries")
    c = blocks.select(F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"), F.col("block").alias("c_block"))
    tasks = max(1, min(count * q_count, max(spark.sparkContext.defaultParallelism * 4, count * q_count // 4)))
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_count - 1).cast("bigint"))).alias("q_block")

    def meet(ranges: DataFrame) -> DataFrame:
        """Every block with every block of queries and its ranges: numbers are paired first, and fetch their vectors by equi-joins."""
        pairs = c.select("c_block", numbers).repartition(tasks, "q_block", "c_block")
        return pairs.join(q.join(ranges, "q_block"), "q_block").join(c, "c_block")

    width = 2.0 + 4 * SLOP

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [np.full(len(x.as_py()) // 8, -1.0 - 2 * SLOP).tobytes() for x in b.column("own")]
            yield pa.RecordBatch.from_arrays([b.column("q_block"), pa.array(low, pa.binary()), pa.array([width] * b.num_rows)], names=["q_block", "low", "width"])

    ranges = q.select("q_block", "own").mapInArrow(start, "q_block bigint, low binary, width double")
    while True:
        counts = meet(ranges).mapInArrow(lambda it: _histograms(it, dim), "q_block bigint, low binary, width double, count binary")
        located = counts.repartition("q_block").sortWithinPartitions("q_block").mapInArrow(lambda it: _located(it, k), "q_block bigint, low binary, width double, crowd bigint")
        found = written(located, "ranges")
        ranges = found.drop("crowd")
        seen = found.agg(F.max("crowd").alias("crowd"), F.max("width").alias("width")).first()
        if seen["crowd"] <= CROWD * k or seen["width"] <= 8 * SLOP:
            break
    best = meet(ranges).mapInArrow(lambda it: _filtered(it, dim, k), schema)
    order = Window.partitionBy("query").orderBy(F.desc("key"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
