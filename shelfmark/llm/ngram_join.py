"""N-gram Jaccard join with count-vector R-trees; no pair is lost.

A document is the set of its word n-grams (a word: see ``textbuf``), hashed to 64 bits; equal sets are
one from there on. The join has four steps, each linear in what it moves:

1. Which n-grams do two sets have, and how many sets has each? Occurrences are shuffled by hash and counted
   in ranges of it. n-grams that a large share of the sets of a chunk has (``hot``, a list of fixed size)
   are known from the first scan and never meet in a task.
2. A set of n of which s are shared can be near another only where s >= t n. Its shared n-grams in a global
   order (the rarest first) have a prefix of s - ceil(t n) + 1: near sets share one within both prefixes.
3. Sets are packed into R-tree nodes in the order of minwise hashes of their shared n-grams, so
   near ones lie together. Nodes that share a prefix n-gram are paired; no others can hold a near pair.
4. Within a node and between paired nodes, points (the counts of the shared n-grams by group) are
   joined top down: two sets share at most the sum of the coordinate minima of their points, two subtrees at most
   that of their maxima. Pairs not ruled out are verified on the sets.

Each pair of near sets is verified in one place, so links are counted and groups joined there,
and pairs needn't be moved. Nothing depends on a sample, and no list of partners has a bound.

Defined cases: texts without words (null, empty, punctuation) are near nothing; a text of fewer
than n words is one gram, all of its words; a null id is left out; repeated rows are one; an id
with several texts is a document for each, and one pairs never with itself; an empty table gives
no rows; other columns don't take part. Hashes have 64 bits, so two different n-grams or sets are taken for
one with a chance of 2^-64 for each pair of them (2^-48 and less between n-grams of a small corpus).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import bloom, textbuf
from shelfmark.session import written

N = 3
THRESHOLD = 0.5
LEAF = 16
#: Members and n-grams of a node at the most (a single set may be larger).
NODE, NODE_GRAMS = 512, 1 << 20
#: n-grams taken at once, and n-grams of a range that one task sorts.
CHUNK, RANGE = 1 << 20, 2 << 20
#: An n-gram that so many sets of a chunk (some 2,000) have may be hot; so many hot ones are broadcast (1 MB). That is room
#: for all that a 200th of the sets have; of the others a range gets that share of the sets at the most.
HOT_COUNT, HOT = 12, 1 << 17
#: Guests that one copy of a node meets.
GUESTS = 64
LOW = np.uint64((1 << 48) - 1)
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, 256, dtype=np.uint64)


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    h, row = textbuf.words(data, offsets)
    ends = np.cumsum(np.bincount(row, minlength=len(offsets) - 1)) if len(offsets) > 1 else []
    gram = np.zeros(len(h), np.uint64)
    for k in range(n):
        gram[: len(h) - k] += h[k:] * _A[200 + k]
    gram = textbuf.mix(gram)
    at = 0
    for end in ends:
        size = end - at
        if size >= n:
            yield np.unique(gram[at : end - n + 1])
        elif size:
            part = h[at:end] * _A[200 : 200 + size]
            yield textbuf.mix(np.add.reduce(part, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)
        at = end


def set_number(grams: np.ndarray) -> np.uint64:
    """A 64-bit hash of a set of n-grams, not 0; 0 for the empty set."""
    if not len(grams):
        return np.uint64(0)
    both = np.array([np.add.reduce(grams), np.add.reduce(textbuf.mix(grams ^ _B[255])), len(grams)], np.uint64)
    return max(np.uint64(1), textbuf.mix(np.array([np.add.reduce(textbuf.mix(both * _A[240:243]))], np.uint64))[0])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and sets of (id, text), some CHUNK n-grams at once."""
    ids, sets, total = [], [], 0
    for batch in batches:
        data, offsets = textbuf.column(batch.column(1))
        for i, j in textbuf.chunks(offsets):
            ids.append(batch.column(0).slice(i, j - i))
            sets += gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
            total += sum(map(len, sets[len(sets) - (j - i) :]))
            if total >= CHUNK:
                yield pa.concat_arrays(ids), sets
                ids, sets, total = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), sets


def _distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the different sets of a chunk: set numbers, lengths, n-grams."""
    number = np.array([set_number(g) for g in sets], np.uint64)
    _, first = np.unique(number, return_index=True)
    first = first[number[first] > 0]
    flat = np.concatenate([sets[k] for k in first]) if len(first) else np.zeros(0, np.uint64)
    return number[first], np.array([len(sets[k]) for k in first], np.int64), flat


def _signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(hot, id, sid, n) of each text; rows with hot: n-grams of many sets of a chunk, and how many."""
    textbuf.lean()
    names = ["hot", "id", "sid", "n"]
    for ids, sets in _sets(batches, n):
        sid = np.array([set_number(g) for g in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sid), bool)), ids, pa.array(sid), pa.array([len(g) for g in sets], pa.int32())], names=names)
        flat = np.sort(_distinct(sets)[2])
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(flat)])
        many = np.flatnonzero(count >= HOT_COUNT)
        if len(many):
            gram = flat[first[many]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(gram), bool)), pa.nulls(len(gram), ids.type), pa.array(gram.view(np.int64)), pa.array(count[many].astype(np.int32))], names=names)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Items of an array as binaries that end at these items."""
    size = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    offsets = (np.r_[0, ends] * size).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _items(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The items of binaries, and where each binary's begin; nulls have none."""
    raw = column.cast(pa.large_binary())
    if raw.null_count:
        raw = raw.fill_null(b"")
    _, offs, data = raw.buffers()
    at = np.frombuffer(offs, np.int64, len(raw) + 1, raw.offset * 8)
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(data, dtype, int(at[-1] - at[0]) // size, int(at[0])) if data is not None and at[-1] > at[0] else np.zeros(0, dtype)
    return flat, (at - at[0]) // size


def _slices(key: np.ndarray, sid: np.ndarray, *items: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Occurrences ordered by key and sid as a row for each key: key, and sids, counts, and the items of the occurrences."""
    run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
    keys = key[run]
    last = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) + 1
    ends = np.r_[run[1:], len(key)]
    return keys[last - 1], [_binary(sid[run], last), _binary((ends - run).astype(np.int32), last), *(_binary(x, ends[last - 1]) for x in items)]


def _low(grams: np.ndarray) -> np.ndarray:
    return grams.view(np.uint8).reshape(-1, 8)[:, :6]


_SLICE = "part bigint, known boolean, sids binary, counts binary, grams binary"


def _asked(batches: Iterator[pa.RecordBatch], n: int, bits: int, hot: object) -> Iterator[pa.RecordBatch]:
    """Occurrences by range of hash (their low 48 bits); those of hot n-grams, ``known``, go to ranges in turn and whole."""
    textbuf.lean()
    names = ["part", "known", "sids", "counts", "grams"]
    for turn, (_, sets) in enumerate(_sets(batches, n)):
        number, size, flat = _distinct(sets)
        if not len(flat):
            continue
        sid = np.repeat(number, size)
        warm = np.isin(flat, hot.value)
        ask = np.flatnonzero(~warm)
        part = (flat[ask] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ask), np.int64)
        order = np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")
        if len(order):
            keys, columns = _slices(part[order], sid[ask][order], _low(flat[ask][order]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.zeros(len(keys), bool)), *columns], names=names)
        if warm.any():
            # in runs of some sets, dealt over the ranges
            key = (np.arange(int(warm.sum())) >> 14) + turn * 8191 + int(number[0] >> np.uint64(40))
            keys, columns = _slices(key, sid[warm], _ident(flat[warm], bits))
            yield pa.RecordBatch.from_arrays([pa.array(keys % (1 << bits)), pa.array(np.ones(len(keys), bool)), *columns], names=names)


def _ident(grams: np.ndarray, bits: int) -> np.ndarray:
    """What of an n-gram's hash is kept: its range's number and the low 48 bits."""
    if bits >= 16:
        return grams
    return ((grams >> np.uint64(64 - bits)) << np.uint64(48) if bits else np.zeros(len(grams), np.uint64)) | grams & LOW


def _level(count: np.ndarray) -> np.ndarray:
    """A byte that grows with how many sets have an n-gram: exact below 64, then eight steps for each power of 2."""
    return np.where(count < 64, count, np.minimum(64 + 8 * (np.log2(np.maximum(count, 64)) - 6), 250)).astype(np.uint8)


def _shared(batches: Iterator[pa.RecordBatch], bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of slices sorted by range: the occurrences of n-grams that two sets have, with their level, by bucket of set numbers."""
    textbuf.lean()
    for batch, starts in groups(batches, "part"):
        part = batch.column("part").to_numpy()
        known = batch.column("known").to_numpy(zero_copy_only=False)
        sids, s_at = _items(batch.column("sids"), np.uint64)
        counts, _ = _items(batch.column("counts"), np.int32)
        raw, g_at = _items(batch.column("grams"), np.uint8)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            sid = [np.repeat(sids[s_at[k] : s_at[k + 1]], counts[s_at[k] : s_at[k + 1]]) for k in range(a, b)]
            owns, grams, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
            for k in np.flatnonzero(known[a:b]) + a:
                owns.append(sid[k - a])
                grams.append(np.frombuffer(raw[g_at[k] : g_at[k + 1]].tobytes(), np.uint64))
                levels.append(np.zeros(len(owns[-1]), np.uint8))
            asked = np.flatnonzero(~known[a:b]) + a
            own = np.concatenate([sid[k - a] for k in asked]) if len(asked) else None
            del sid
            if len(asked):
                low = np.zeros((len(own), 8), np.uint8)
                low[:, :6] = np.concatenate([raw[g_at[k] : g_at[k + 1]] for k in asked]).reshape(-1, 6)
                gram = low.view(np.uint64).ravel()
                del low
                order = np.argsort(gram)
                same = gram[order]
                same = same[1:] == same[:-1]
                order = order[np.r_[same, False] | np.r_[False, same]]
                gram, own = gram[order], own[order]
                order = np.lexsort((own, gram))
                gram, own = gram[order], own[order]
                new = np.r_[True, (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])][: len(gram)]
                gram, own = gram[new], own[new]
                first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
                count = np.diff(np.r_[first, len(gram)])
                count = np.repeat(count, count)
                two = count > 1
                owns.append(own[two])
                high = int(part[a]) << 48 if bits < 16 else (int(part[a]) >> (bits - 16)) << 48
                grams.append(gram[two] | np.uint64(high))
                levels.append(_level(count[two]))
            own, gram, level = np.concatenate(owns), np.concatenate(grams), np.concatenate(levels)
            if len(own):
                bucket = (own % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((own, bucket))
                keys, columns = _slices(bucket[order], own[order], gram[order], level[order])
                yield pa.RecordBatch.from_arrays([pa.array(keys), *columns], names=["bucket", "sids", "counts", "grams", "levels"])


def least_hash(flat: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A minwise hash of each set; none is empty."""
    return np.minimum.reduceat(textbuf.mix(flat ^ _B[seed]), at[:-1])


def _near_able(batches: Iterator[pa.RecordBatch], threshold: float, hot: object, bits: int) -> Iterator[pa.RecordBatch]:
    """Of slices and sets sorted by bucket: the sets that can be near another, their shared n-grams in the global order.

    Their prefix has ``p`` of them; ``m1`` and ``m2`` are minwise hashes.
    """
    textbuf.lean()
    ranks = _ident(hot.value, bits)
    place = np.argsort(ranks)
    for batch, starts in groups(batches, "bucket"):
        one, n = (batch.column(c).fill_null(0).to_numpy() for c in ("sid", "n"))
        is_set = batch.column("sid").is_valid().to_numpy(zero_copy_only=False)
        sids, s_at = _items(batch.column("sids"), np.uint64)
        counts, _ = _items(batch.column("counts"), np.int32)
        grams, g_at = _items(batch.column("grams"), np.uint64)
        levels, _ = _items(batch.column("levels"), np.uint8)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            here = np.flatnonzero(is_set[a:b]) + a
            sid = np.repeat(sids[s_at[a] : s_at[b]], counts[s_at[a] : s_at[b]])
            gram, level = grams[g_at[a] : g_at[b]], levels[g_at[a] : g_at[b]]
            if not len(sid) or not len(here):
                continue
            order = np.lexsort((gram, sid))
            sid, gram, level = sid[order], gram[order], level[order]
            new = np.r_[True, (sid[1:] != sid[:-1]) | (gram[1:] != gram[:-1])]
            sid, gram, level = sid[new], gram[new], level[new].astype(np.int64)
            first = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
            size = np.diff(np.r_[first, len(sid)])
            numbers = one[here].view(np.uint64)
            by = np.argsort(numbers)
            row = here[by[np.searchsorted(numbers[by], sid[first])]]
            need = np.ceil(threshold * n[row] - 1e-9).astype(np.int64)
            able = size >= need
            if not able.any():
                continue
            keep = np.repeat(able, size)
            gram, level, size, row, need = gram[keep], level[keep], size[able], row[able], need[able]
            at = np.r_[0, np.cumsum(size)]
            if len(ranks):  # the hot ones last, the most frequent of them at the very end
                spot = np.minimum(np.searchsorted(ranks[place], gram), len(ranks) - 1)
                level = np.where(ranks[place][spot] == gram, 256 + len(ranks) - place[spot], level)
            order = np.lexsort((gram, level, np.repeat(np.arange(len(size)), size)))
            hashes = [pa.array(least_hash(gram, at, k).view(np.int64)) for k in (0, 1)]
            take = pa.array(row)
            columns = [batch.column("sid").take(take), batch.column("rep").take(take), batch.column("n").take(take), batch.column("m").take(take), *hashes, pa.array((size - need + 1).astype(np.int32)), pa.array(size.astype(np.int32)), _binary(gram[order], at[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "rep", "n", "m", "m1", "m2", "p", "s", "grams"])


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by key, cut where a key ends: (batch, starts of its keys with the end)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            change = np.r_[0, change]
        if len(change):
            last = int(change[-1])
            whole = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
            for w in whole:
                k = w.column(key).to_numpy(zero_copy_only=False)
                yield w, np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        for w in pa.Table.from_batches(held).combine_chunks().to_batches():
            k = w.column(key).to_numpy(zero_copy_only=False)
            yield w, np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]


_MEMBERS = ("sid", "n", "m", "p", "s")


def _nodes(batches: Iterator[pa.RecordBatch], most: int, most_grams: int) -> Iterator[pa.RecordBatch]:
    """Sets sorted by minwise hashes to R-tree nodes, a row each; the next node begins with another m1 or beyond a bound."""
    held: list[pa.RecordBatch] = []
    state = {"m1": None, "rows": 0, "grams": 0}

    def made() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        n, s = whole.column("n").to_numpy(), whole.column("s").to_numpy()
        flat, _ = _items(whole.column("grams"), np.uint64)
        node = int(set_number(whole.column("sid").to_numpy().view(np.uint64)).view(np.int64))
        lists = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(c)) for c in (*_MEMBERS, "rep")]
        columns = [pa.array([node]), pa.array([int(s.sum())]), pa.array([int(n.min())]), pa.array([int(n.max())]), *lists, _binary(flat, np.array([len(flat)]))]
        return pa.RecordBatch.from_arrays(columns, names=["node", "w", "lo", "hi", *_MEMBERS, "rep", "grams"])

    for batch in batches:
        m1, s = batch.column("m1").to_numpy(), batch.column("s").to_numpy()
        start = 0
        for k in range(batch.num_rows):
            if state["rows"] and (m1[k] != state["m1"] or state["rows"] >= most or state["grams"] + s[k] > most_grams):
                if k > start:
                    held.append(batch.slice(start, k - start))
                yield made()
                held, start, state["rows"], state["grams"] = [], k, 0, 0
            state["m1"] = m1[k]
            state["rows"] += 1
            state["grams"] += int(s[k])
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield made()


class Members:
    """The sets of one node: numbers, sizes, weights, and shared n-grams."""

    def __init__(self, batch: pa.RecordBatch, k: int, prefix: str = "") -> None:
        self.sid, self.n, self.m, self.p, s = (batch.column(prefix + c)[k].values.to_numpy() for c in _MEMBERS)
        self.rep = batch.column(prefix + "rep")[k].values
        self.at = np.r_[0, np.cumsum(s)].astype(np.int64)
        self.flat = np.frombuffer(batch.column(prefix + "grams")[k].as_py(), np.uint64)

    def tree(self, width: int) -> CountTree:
        return CountTree(count_points(self.flat, self.at, width), self.n)


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix n-grams of each node: gram, node, w, lo, hi."""
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("node", "w", "lo", "hi")]
        for k in range(batch.num_rows):
            own = Members(batch, k)
            gram = np.unique(textbuf.gather(own.flat, own.at[:-1], own.p.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *(pa.array(np.full(len(gram), c[k])) for c in columns)], names=["gram", "node", "w", "lo", "hi"])


WIDE = 256


def _met(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of routes sorted by n-gram: pairs of nodes whose sizes agree, the one of more n-grams first."""
    for batch, starts in groups(batches, "gram"):
        node, w, lo, hi = (batch.column(c).to_numpy() for c in ("node", "w", "lo", "hi"))
        count = np.diff(starts)
        left, right = [starts[:-1][count == 2]], [starts[:-1][count == 2] + 1]
        for g in np.flatnonzero(count > 2):
            i, j = int(starts[g]), int(starts[g + 1])
            for a in range(i, j, WIDE):
                x = np.arange(a, min(a + WIDE, j))
                near = (hi[x, None] >= threshold * lo[i:j]) & (hi[i:j] >= threshold * lo[x, None]) & (x[:, None] < np.arange(i, j))
                r, c = np.nonzero(near)
                left.append(x[r])
                right.append(c + i)
        i, j = np.concatenate(left), np.concatenate(right)
        good = (hi[i] >= threshold * lo[j]) & (hi[j] >= threshold * lo[i]) & (node[i] != node[j])
        i, j = i[good], j[good]
        swap = (w[j] > w[i]) | (w[j] == w[i]) & (node[j] < node[i])
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pairs = np.unique(np.stack([node[i], node[j]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["host", "guest"])


class CountTree:
    """An R-tree, packed bottom up, over count vectors.

    Points are ordered by set size, then by their fullest coordinates, and cut into nodes of LEAF. A
    node keeps the maximum of each coordinate and the range of set sizes: for a point q no member can
    share more than sum(min(q, maxima)) n-grams with it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> None:
        half = points[:, : max(1, points.shape[1] // 2)].sum(1)
        self.order = np.lexsort((points.argmax(1), half, sizes))
        top = points[self.order]
        low = high = sizes[self.order].astype(np.int64)
        self.leaf, self.levels = leaf, [(top, low, high)]
        while len(top) > 1:
            at = np.arange(0, len(top), leaf)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def _children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of nodes of a level, and which node each belongs to; above the root there is the root."""
        if level >= len(self.levels):
            return nodes, np.arange(len(nodes))
        start = nodes * self.leaf
        count = np.minimum(start + self.leaf, len(self.levels[level - 1][1])) - start
        of = np.repeat(np.arange(len(nodes)), count)
        return start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), of

    def join(self, other: CountTree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (i of this, j of other) whose bound reaches the threshold; with itself i before j in the tree's order."""
        same = self is other
        a = b = np.zeros(min(1, len(self.order), len(other.order)), np.int64)
        for level in range(max(len(self.levels), len(other.levels)) - 1, -1, -1):
            (top, low, high), (tops, lows, highs) = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            keep = np.ones(len(a), bool) if not same else a <= b if level else a < b
            keep &= (high[a] >= threshold * lows[b]) & (highs[b] >= threshold * low[a])
            a, b = a[keep], b[keep]
            need = threshold / (1 + threshold) * (low[a] + lows[b]) - 1e-9
            step = max(1, (1 << 22) // top.shape[1])
            shared = [np.minimum(top[a[k : k + step]], tops[b[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(a), step)]
            good = np.concatenate(shared) >= need if shared else np.zeros(0, bool)
            a, b = a[good], b[good]
            if level:
                a, of = self._children(level, a)
                b, of_b = other._children(level, b[of])
                a = a[of_b]
        return self.order[a], other.order[b]


def count_points(flat: np.ndarray, at: np.ndarray, groups_: int) -> np.ndarray:
    """The count of each group of n-grams in each set; ``groups_`` is a power of two."""
    m = len(at) - 1
    row = np.repeat(np.arange(m), np.diff(at))
    cell = row * groups_ + (flat & np.uint64(groups_ - 1)).astype(np.int64)
    return np.bincount(cell, minlength=m * groups_).reshape(m, groups_).astype(np.int32)


def overlaps(i: np.ndarray, j: np.ndarray, x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray) -> np.ndarray:
    """How many n-grams sets i of one collection have in common with sets j of another."""
    shared = np.zeros(len(i), np.int64)
    if not len(i):
        return shared
    vocabulary, number = np.unique(np.r_[x, y], return_inverse=True)
    nx, ny = number[: len(x)], number[len(x) :]
    mark = np.zeros(len(vocabulary), np.int8)
    order = np.argsort(i, kind="stable")
    first = np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]])
    for lo, hi in zip(first, np.r_[first[1:], len(i)], strict=True):
        k = i[order[lo]]
        mark[nx[x_at[k] : x_at[k + 1]]] = 1
        part = j[order[lo:hi]]
        length = y_at[part + 1] - y_at[part]
        hits = np.r_[0, np.cumsum(mark[textbuf.gather(ny, y_at[part], length)], dtype=np.int64)]
        ends = np.cumsum(length)
        shared[order[lo:hi]] = hits[ends] - hits[ends - length]
        mark[nx[x_at[k] : x_at[k + 1]]] = 0
    return shared


def tree_pairs(one: Members, two: Members, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All near pairs of sets of two nodes, or of a node with itself: first, second, n-grams in common."""
    width = 1 << int(np.clip(np.ceil(np.log2(2 * np.median(np.diff(one.at)) + 1)), 5, 11))
    tree = one.tree(width)
    i, j = tree.join(tree if one is two else two.tree(width), threshold)
    shared = overlaps(i, j, one.flat, one.at, two.flat, two.at)
    good = (shared >= threshold * (one.n[i].astype(np.int64) + two.n[j] - shared) - 1e-9) & (one.sid[i] != two.sid[j])
    return i[good], j[good], shared[good]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The places of pairs that connect all that the pairs (i, j) of n rows connect: one fewer than each component has rows."""
    root = list(range(n))
    keep = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(k)
    return np.array(keep, np.int64)


def _linked(batches: Iterator[pa.RecordBatch], threshold: float, whole: bool) -> Iterator[pa.RecordBatch]:
    """Of hosts sorted so that each is followed by its guests: links of each set (sid, links), and edges (a, b, jaccard).

    Edges are those of a forest, or with ``whole`` all near pairs.
    """
    textbuf.lean()
    host, key = None, None
    for batch in batches:
        hosts, salts = batch.column("host").to_numpy(), batch.column("salt").to_numpy()
        guests = batch.column("is_guest").to_numpy(zero_copy_only=False)
        for k in range(batch.num_rows):
            guest = Members(batch, k)
            if not guests[k]:
                host, key = guest, (hosts[k], salts[k])
                if salts[k]:
                    continue  # its own pairs are found by copy 0
            if key != (hosts[k], salts[k]):
                raise ValueError("a guest without its host")
            i, j, shared = tree_pairs(host, guest, threshold)
            if not len(i):
                continue
            union = host.n[i].astype(np.int64) + guest.n[j] - shared
            sums = np.zeros(len(host.n) + len(guest.n), np.int64)
            np.add.at(sums, i, guest.m[j])
            np.add.at(sums, len(host.n) + j, host.m[i])
            number = np.r_[host.sid, guest.sid]
            has = np.flatnonzero(sums)
            some = np.arange(len(i)) if whole else forest(i, j if guest is host else j + len(host.n), len(sums))
            reps = host.rep.type
            blank = len(has)
            a = pa.concat_arrays([pa.nulls(blank, reps), host.rep.take(pa.array(i[some]))])
            b = pa.concat_arrays([pa.nulls(blank, reps), guest.rep.take(pa.array(j[some]))])
            score = pa.array(np.r_[np.full(blank, np.nan), (shared / union)[some]], from_pandas=True)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(number[has]), pa.nulls(len(some), pa.int64())]), pa.concat_arrays([pa.array(sums[has]), pa.nulls(len(some), pa.int64())]), a, b, score], names=["sid", "links", "a", "b", "jaccard"])


class Near:
    """The near sets of a table: ``entries`` (id, sid, n), ``sets`` (sid, n, m, rep), ``found`` (sid, links or a, b, jaccard)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, whole: bool = False, node: int = NODE, node_grams: int = NODE_GRAMS) -> None:
        spark = docs.sparkSession
        base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
        kind = base.schema["id"].dataType.simpleString()
        signed = written(base.mapInArrow(lambda it: _signatures(it, n), f"hot boolean, id {kind}, sid bigint, n int"), "signatures")
        self.entries = signed.where(~F.col("hot")).select("id", "sid", "n").distinct()
        self.sets = written(self.entries.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.count("*").alias("m"), F.min("id").alias("rep")), "sets")
        ranked = signed.where("hot").groupBy("sid").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "sid").limit(HOT).toPandas()
        hot = spark.sparkContext.broadcast(ranked["sid"].to_numpy(np.int64).view(np.uint64))
        total = self.sets.agg(F.coalesce(F.sum(F.col("n").cast("bigint")), F.lit(0))).first()[0]
        bits = max(0, int(np.ceil(np.log2(max(1, total / RANGE)))))
        buckets = 1 << bits
        asked = base.where(F.col("text").isNotNull()).mapInArrow(lambda it: _asked(it, n, bits, hot), _SLICE)
        slices = asked.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: _shared(it, bits, buckets), "bucket bigint, sids binary, counts binary, grams binary, levels binary")
        # unsigned remainders, as in _shared: buckets is a power of two
        rows = self.sets.select(F.col("sid").bitwiseAND(buckets - 1).alias("bucket"), *[F.lit(None).cast("binary").alias(c) for c in ("sids", "counts", "grams", "levels")], "sid", "n", F.col("m").cast("int").alias("m"), "rep")
        slices = slices.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("sid", "bigint"), ("n", "int"), ("m", "int"), ("rep", kind))])
        both = slices.unionByName(rows).repartition("bucket").sortWithinPartitions("bucket")
        able = written(both.mapInArrow(lambda it: _near_able(it, threshold, hot, bits), f"sid bigint, rep {kind}, n int, m int, m1 bigint, m2 bigint, p int, s int, grams binary"), "able")
        order = ["m1", "m2", "sid"]
        packed = able.repartitionByRange(*order).sortWithinPartitions(*order)
        lists = "sid array<bigint>, n array<int>, m array<int>, p array<int>, s array<int>"
        nodes = written(packed.mapInArrow(lambda it: _nodes(it, node, node_grams), f"node bigint, w bigint, lo bigint, hi bigint, {lists}, rep array<{kind}>, grams binary"), "nodes")
        routes = nodes.mapInArrow(_routes, "gram bigint, node bigint, w bigint, lo bigint, hi bigint")
        met = routes.repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda it: _met(it, threshold), "host bigint, guest bigint").distinct()
        # a node that meets many others is copied
        copies = F.ceil(F.count("*").over(Window.partitionBy("host")) / GUESTS)
        met = written(met.withColumn("salt", F.pmod(F.xxhash64("guest"), copies).cast("int")), "met")
        body = [*_MEMBERS, "rep", "grams"]
        at = met.where("salt > 0").select("host", "salt").distinct().withColumnRenamed("host", "node")
        hosts = nodes.select("node", F.lit(0).alias("salt"), *body).unionByName(nodes.join(at, "node").select("node", "salt", *body))
        guests = nodes.join(met.withColumnRenamed("guest", "node"), "node").select("host", "salt", F.lit(True).alias("is_guest"), *body)
        all_ = hosts.select(F.col("node").alias("host"), "salt", F.lit(False).alias("is_guest"), *body).unionByName(guests)
        ordered = all_.repartition("host", "salt").sortWithinPartitions("host", "salt", "is_guest")
        self.found = written(ordered.mapInArrow(lambda it: _linked(it, threshold, whole), f"sid bigint, links bigint, a {kind}, b {kind}, jaccard double"), "found")
        self.edges = self.found.where("a IS NOT NULL").select("a", "b", "jaccard")

    def classes(self) -> DataFrame:
        """Each document of words: id, sid, rep, m, class_id."""
        heads = components(self.edges).withColumnRenamed("id", "rep")
        found = self.sets.select("sid", "m", "rep").join(heads, "rep", "left").withColumn("class_id", F.coalesce("head", "rep")).drop("head")
        return self.entries.where("n > 0").select("id", "sid").join(found, "sid")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: id, class_id, copy_id, copies, links.

    ``class_id`` is the least id of all documents that are joined to this one by near pairs, ``copy_id`` the least of
    those of an equal set, ``copies`` their number, and ``links`` the number of documents that are near this one, its
    copies among them. A document without words is a class and a copy by itself, without links.
    """
    near = Near(docs, id_col, text_col, n, threshold)
    links = near.found.where("sid IS NOT NULL").groupBy("sid").agg(F.sum("links").alias("l"))
    held = near.classes().join(links, "sid", "left")
    held = held.select(F.col("id").alias(id_col), "class_id", F.col("rep").alias("copy_id"), F.col("m").alias("copies"), (F.coalesce("l", F.lit(0)) + F.col("m") - 1).alias("links"))
    blank = near.entries.where("n = 0").select("id").distinct()
    return held.unionByName(blank.select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("links")))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, node: int = NODE, node_grams: int = NODE_GRAMS) -> DataFrame:
    """All pairs of near sets, each by the least id that has it: a, b, jaccard, with a < b. Copies are in ``near_classes``.

    Where two sets have the same least id (one of several texts) they are no pair.
    """
    near = Near(docs, id_col, text_col, n, threshold, True, node, node_grams).edges.where("a != b")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of pairs (a, b): id, head, the least id of the component.

    Labels go to the least of each neighbourhood and then jump along themselves, so rounds grow with
    the logarithm of the longest path; each round is written to the shared folder.
    """
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("head")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), "head"), "b").groupBy(F.col("a").alias("id")).agg(F.min("head").alias("near"))
        low = labels.join(seen, "id").select("id", F.least("head", "near").alias("low"), "head")
        jump = labels.select(F.col("id").alias("low"), F.col("head").alias("far"))
        new = written(low.join(jump, "low").select("id", F.least("low", "far").alias("head"), (F.least("low", "far") != F.col("head")).alias("moved")), "labels")
        labels = new.select("id", "head")
        if new.where("moved").isEmpty():
            return labels


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that of the least id, with all its columns.

    Rows of a null id and texts without words are kept. An id of several texts stays where it is the least of any
    of their classes. Rows of one id and text are one: of those that differ in other columns, the one of least hash.
    """
    classes = Near(docs, id_col, text_col, n, threshold).classes()
    gone = classes.groupBy("id").agg(F.max("class_id").alias("c")).where("c < id").select(F.col("id").alias(id_col))
    repeated = docs.groupBy(id_col).count().where(f"count > 1 AND `{id_col}` IS NOT NULL").select(id_col).join(gone, id_col, "left_anti")
    gone, repeated = written(gone, "gone"), written(repeated, "repeated")
    leaving = gone.unionByName(repeated)
    # texts that can't leave aren't shuffled
    doubtful = F.coalesce(bloom.maybe_in(leaving, F.col(id_col)), F.lit(False))
    free, held = docs.where(~doubtful), docs.where(doubtful)
    rank = "rank"
    while rank.lower() in (c.lower() for c in docs.columns):
        rank += "_"
    by = Window.partitionBy(id_col, text_col).orderBy(F.xxhash64(*docs.columns))
    once = held.join(repeated, id_col, "left_semi").withColumn(rank, F.row_number().over(by)).where(F.col(rank) == 1)
    rest = held.join(leaving, id_col, "left_anti")
    return free.unionByName(rest.select(docs.columns)).unionByName(once.select(docs.columns))
