"""SentencePiece encoding and decoding by vectorised merge rounds.

The distinct words of a batch are laid out as one flat array of symbols. In each round every
word finds the least rank among its adjacent pairs by a segmented minimum, merges all leftmost
non-overlapping occurrences of that pair at once, and the array is compacted; a word leaves
when no pair of it merges. The ids equal those of the sentencepiece library.

Taking several occurrences at once equals taking them one by one unless a merged symbol forms
a pair of lower rank with a neighbour. The pieces for which that can be are known from the
vocabulary; a word that makes one in a round merges only its leftmost occurrence.

Supported: BPE models with identity normalisation, a dummy prefix, escaped white space and byte
fallback. Defined cases: a null text gives null ids; an empty text gives an empty array (as in
the library); special pieces in a text are ordinary text; ids out of range or null can't be
decoded and are skipped; control pieces decode to nothing; texts of any length are whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textbuf

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = np.iinfo(np.int32).max
NORMAL, UNKNOWN, BYTE = 1, 2, 6
SPACE = 0x20


class Vocabulary:
    """The tables of one model: ranks of symbol pairs, bytes of pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not trained.byte_fallback:
            raise ValueError("only BPE models with identity normalisation, dummy prefix and byte fallback")
        self.size = len(proto.pieces)
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any("▁" in p.lstrip("▁") for p in normal):
            raise ValueError("pieces that span words are not supported")
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        order = {s: r for r, s in enumerate(sorted({-s for _, s in normal.values()}))}
        symbols = {p: i for p, (i, _) in normal.items()}
        for p in normal:
            for c in p:
                symbols.setdefault(c, len(symbols) + self.size)
        self.newline_apart = not any("\n" in p and len(p) > 1 for p in normal)
        # an internal symbol without a piece of its own falls back to bytes
        self.char_id = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.char_id[ord(c)] = i
        self.char_id[SPACE] = self.char_id[0x2581]
        self.extra = {i: c.encode() for c, i in symbols.items() if i >= self.size}
        keys, merged, rank, lowered = [], [], [], np.zeros(self.size, bool)
        own = {symbols[p]: order[-s] for p, (_, s) in normal.items()}
        for p, (i, s) in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is None or b is None:
                    continue
                keys.append(a << 32 | b)
                merged.append(i)
                rank.append(order[-s])
                for part, text in ((a, p[:k]), (b, p[k:])):
                    if len(text) > 1 and own[part] > order[-s]:
                        lowered[part] = True
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.lowered = lowered
        self.bits = 20
        self._fill(np.array(keys, np.int64)[at], np.array(merged, np.int32)[at], np.array(rank, np.int32)[at])
        text = [b"" if p.type not in (NORMAL, BYTE) else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace("▁", " ").encode() for p in proto.pieces]
        for i, p in enumerate(proto.pieces):
            if p.type == UNKNOWN:
                text[i] = b" \xe2\x81\x87 "
        self.piece_len = np.array([len(t) for t in text], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[self.byte_id] = True

    def _fill(self, keys: np.ndarray, merged: np.ndarray, rank: np.ndarray) -> None:
        """An open hash table: slot -> key, rank, merged symbol."""
        n = 1 << self.bits
        self.slot_key, self.slot_rank, self.slot_merged = np.full(n, -1, np.int64), np.full(n, NONE, np.int32), np.zeros(n, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.slot_key[s] < 0
            _, first = np.unique(s[free], return_index=True)
            put = left[free][first]
            self.slot_key[slot[put]], self.slot_rank[slot[put]], self.slot_merged[slot[put]] = keys[put], rank[put], merged[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & (n - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair's rank; -1 where the pair doesn't merge."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        held = self.slot_key[slot]
        out = np.where(held == keys, slot, -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slot_key[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = slot[open_[same]]
            open_ = open_[~same & (held >= 0)]
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str = MODEL) -> Vocabulary:
    """The tables of a model file, made once in each worker."""
    return Vocabulary(path)


textbuf.CACHES.append(vocabulary.cache_clear)


def _due(v: Vocabulary, sym: np.ndarray, w: np.ndarray, rank: np.ndarray, at: np.ndarray, new: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether each of the merges ``low`` makes a pair, with the symbols beside it, of a rank no greater than its own."""
    n = len(sym)
    here, made, own = at[low], new[low], rank[at[low]]
    joined = np.flatnonzero((low > 0) & (at[np.maximum(low - 1, 0)] == here - 2))
    left = np.where(here > 0, sym[here - 1], -1)
    left[joined] = new[low[joined] - 1]
    back = np.where(here > 0, here - 1, 0)
    out = np.zeros(len(low), bool)
    for one, two, same in ((left, made, (here > 0) & (w[back] == w[here])), (made, sym[np.minimum(here + 2, n - 1)], (here + 2 < n) & (w[np.minimum(here + 2, n - 1)] == w[here]))):
        k = np.flatnonzero(same)
        slot = v.ranks(one[k], two[k])
        out[k] |= (slot >= 0) & (np.where(slot >= 0, v.slot_rank[slot], NONE) <= own[k])
    return out


def merge_words(v: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of each word, in order: (symbols, word of each). ``word`` is ascending."""
    done_s, done_w = [], []
    sym, w = symbols.copy(), word.copy()
    slot = np.full(len(sym), -1, np.int64)
    if len(sym) > 1:
        same = np.flatnonzero(w[1:] == w[:-1])
        slot[same] = v.ranks(sym[same], sym[same + 1])
    while len(sym):
        rank = np.where(slot >= 0, v.slot_rank[slot], NONE)
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        size = np.diff(np.r_[first, len(w)])
        least = np.minimum.reduceat(rank, first)
        live = np.repeat(least != NONE, size)
        done_s.append(sym[~live])
        done_w.append(w[~live])
        if not live.all():
            sym, w, slot, rank = sym[live], w[live], slot[live], rank[live]
            least, size = least[least != NONE], size[least != NONE]
            if not len(sym):
                break
        hit = rank == np.repeat(least, size)
        at = np.flatnonzero(hit)
        run = np.r_[True, at[1:] != at[:-1] + 1]
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
        new = v.slot_merged[slot[at]]
        low = np.flatnonzero(v.lowered[new])
        if len(low):
            # of a word's merges only those up to the first after which a lesser or equal pair is due
            due = low[_due(v, sym, w, rank, at, new, low)]
            if len(due):
                _, first_due = np.unique(w[at[due]], return_index=True)
                stop = due[first_due]
                word_of = np.searchsorted(w[at[stop]], w[at])
                held = word_of < len(stop)
                held[held] = w[at[stop[word_of[held]]]] == w[at[held]]
                later = np.zeros(len(at), bool)
                later[held] = np.flatnonzero(held) > stop[word_of[held]]
                at, new = at[~later], new[~later]
        sym[at] = new
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        now = (np.cumsum(keep) - 1)[at]
        sym, w, slot = sym[keep], w[keep], slot[keep]
        slot[now] = -1
        touched = np.zeros(len(sym) + 1, bool)
        touched[now] = touched[now - 1] = True  # place -1 is the spare one
        redo = np.flatnonzero(touched[: len(sym) - 1])
        joined = w[redo] == w[redo + 1]
        slot[redo[~joined]] = -1
        redo = redo[joined]
        slot[redo] = v.ranks(sym[redo], sym[redo + 1])
    if not done_s:
        return sym, w
    s, w = np.concatenate(done_s), np.concatenate(done_w)
    order = np.argsort(w, kind="stable")
    return s[order], w[order]


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point and first byte of each character of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    wide = np.r_[data, np.zeros(3, np.uint8)].astype(np.int32)
    b = wide[at]
    code = b.copy()
    for lo, hi, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        m = np.flatnonzero((b >= lo) & (b < hi))
        if len(m):
            c = b[m] & mask
            for k in range(1, more + 1):
                c = c << 6 | wide[at[m] + k] & 0x3F
            code[m] = c
    return code, at


def _finish(v: Vocabulary, sym: np.ndarray, word: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte fallback: symbols without a piece become the pieces of their bytes."""
    bad = (sym < 0) | (sym >= v.size)
    if not bad.any():
        return sym, word
    length = np.where(bad, end - start, 1)
    out = np.repeat(sym, length)
    lost = np.repeat(bad, length)
    out[lost] = v.byte_id[textbuf.gather(data, start[bad], (end - start)[bad])]
    return out, np.repeat(word, length)


def encode_spans(v: Vocabulary, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each span of bytes, in order: (ids, number of ids of each span)."""
    length = e - s
    flat = textbuf.gather(data, s, length)
    code, at = characters(flat)
    word = np.repeat(np.arange(len(s)), length)[at]
    sym = v.char_id[code]
    # a character that has no symbol never merges: as itself it gets a number of its own below 0
    unknown = sym < 0
    sym[unknown] = -1 - np.arange(int(unknown.sum()), dtype=np.int32)
    lone = np.flatnonzero(unknown)
    width = np.diff(np.r_[at, len(flat)])
    out, where = merge_words(v, sym, word)
    bad = np.flatnonzero((out < 0) | (out >= v.size))
    if len(bad):
        start, end = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
        own = out[bad] < 0
        spot = lone[-1 - out[bad[own]]]
        start[bad[own]], end[bad[own]] = at[spot], at[spot] + width[spot]
        extra = bad[~own]
        if len(extra):
            more = [v.extra[int(x)] for x in out[extra]]
            sizes = np.array([len(x) for x in more])
            base = len(flat) + np.cumsum(sizes) - sizes
            flat = np.r_[flat, np.frombuffer(b"".join(more), np.uint8)]
            start[extra], end[extra] = base, base + sizes
        out, where = _finish(v, out, where, start, end, flat)
    return out.astype(np.int32), np.bincount(where, minlength=len(s))


def units(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that begin with the dummy prefix: bytes, starts, ends, row of each.

    A word is a run of spaces and what follows up to the next space; as no piece goes on after a
    letter with a space, words merge apart from each other.
    """
    length = np.diff(offsets)
    rows = np.flatnonzero(length > 0)
    out = np.empty(len(data) + len(rows), np.uint8)
    first = offsets[rows] + np.arange(len(rows))
    mark = np.zeros(len(out), bool)
    mark[first] = True
    out[mark] = SPACE
    out[~mark] = data
    gap = out == SPACE
    if len(out) > 2:
        bar = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x96) & (out[2:] == 0x81))
        for k in range(3):
            gap[bar + k] = True
    head = mark.copy()
    head[1:] |= gap[1:] & ~gap[:-1]
    if v.newline_apart:
        line = out == 10
        head |= line
        head[1:] |= line[:-1]
    s = np.flatnonzero(head)
    e = np.r_[s[1:], len(out)]
    return out, s, e, rows[np.searchsorted(first, s, side="right") - 1]


def distinct_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span for each distinct byte string, and the number of each span among them."""
    h = textbuf.hash_spans(data, s, e)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    length = e - s
    other = first[number]
    if not np.array_equal(length, length[other]) or not np.array_equal(data, textbuf.gather(data, s[other], length)):
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(s, e, strict=True)])
        _, first = np.unique(number, return_index=True)
    return first, number


def encode_texts(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each text."""
    buf, s, e, row = units(v, data, offsets)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    first, number = distinct_spans(buf, s, e)
    ids, count = encode_spans(v, buf, s[first], e[first])
    at = np.cumsum(count) - count
    n = count[number]
    flat = textbuf.gather(ids, at[number], n)
    return flat, np.bincount(row, weights=n, minlength=len(offsets) - 1).astype(np.int64)


def decode_ids(v: Vocabulary, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; the space of the dummy prefix is dropped."""
    row = np.repeat(np.arange(len(count)), count)
    good = (ids >= 0) & (ids < v.size)
    ids, row = ids[good], row[good]
    length = v.piece_len[ids]
    data = textbuf.gather(v.piece_bytes, v.piece_at[ids], length)
    size = np.bincount(row, weights=length, minlength=len(count)).astype(np.int64)
    offsets = np.r_[0, np.cumsum(size)]
    begin = offsets[:-1][size > 0]
    dropped = begin[data[begin] == SPACE]
    keep = np.ones(len(data), bool)
    keep[dropped] = False
    lost = np.searchsorted(dropped, offsets)
    return data[keep], offsets - lost


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, check: bool) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        data, offsets = textbuf.column(batch.column(1))
        null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        for i, j in textbuf.chunks(offsets):
            part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            flat, count = encode_texts(v, part, local)
            ends = np.r_[0, np.cumsum(count)].astype(np.int32)
            mask = pa.array(null[i:j])
            columns = [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=mask), pa.array(count.astype(np.int32), mask=null[i:j])]
            if check:
                back, at = decode_ids(v, flat, count)
                same = np.diff(at) == np.diff(local)
                if not (same.all() and np.array_equal(back, part)):
                    same = np.array([back[at[k] : at[k + 1]].tobytes() == part[local[k] : local[k + 1]].tobytes() for k in range(j - i)], bool)
                columns.append(pa.array(same, mask=null[i:j]))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "n_tokens", "round_trip"][: len(columns)])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, check: bool = False) -> DataFrame:
    """Ids of each text: id, ids, n_tokens, and with ``check`` round_trip (decoding gives the text again)."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, n_tokens int" + ", round_trip boolean" * check
    return base.mapInArrow(lambda it: _encode_batches(it, path, check), schema).withColumnRenamed("id", id_col)


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        lists = batch.column(1)
        null = lists.is_null().to_numpy(zero_copy_only=False)
        count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        data, offsets = decode_ids(v, flat, count)
        text = [None if null[k] else data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in range(len(count))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["id", "text"])


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """The text of each list of ids: id, text. Bytes that aren't UTF-8 become U+FFFD."""
    base = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(lambda it: _decode_batches(it, path), f"id {kind}, text string").withColumnRenamed("id", id_col)
