"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A document is parsed into
phrases, each the longest match with the training text from where the last one ended; the
fewer phrases, the closer the language. The count is normalised to bits for each character,
``phrases * log2(length of the training text) / length of the document``; the least wins.

All documents of a batch are parsed at once: normalised text is cut into segments that step
through the automaton's dense transition table together, one table look-up for each symbol
and language. The cuts leave no trace: each segment is then entered again in the state the one before it
ended in, until both parses begin a phrase at the same symbol, from where on they are the same.

Normalised text: case folded, all but letters (ASCII letters and bytes from 0x80) one space.

Defined cases: a null or empty text, or one without letters, has no language (null, 0
symbols) and is rejected as ``no letters``; a tie goes to the first language by name; training
rows with a null or blank language or text are left out; with no training text at all every
document is rejected as ``no model``; texts are parsed whole, however long; repeated rows are
judged alike.
"""

from __future__ import annotations

import functools
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import textbuf

#: Symbols that one lane steps through; results don't depend on it.
SEGMENT = 256
#: Bound on the labelled text: rows of each language, characters of each row, and normalised bytes of each language.
TRAIN_ROWS = 64
TRAIN_BYTES = 24_000
#: Bound on the tables that are broadcast; beyond it each language's training text gets shorter by the same factor.
MODEL_BYTES = 256 << 20
#: A document is rejected where its best language needs this many times the bits that held-out text of it needs.
SLACK = 2.0
#: Shorter documents are noisy; their limit is (1 + SHORT / symbols) times as high.
SHORT = 20.0

_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with single spaces between, and the offsets of each text, at most one space at a text's start dropped."""
    out = _CLASS[textbuf.fold(data)]
    keep = np.ones(len(out), bool)
    gap = out == 0x20
    keep[1:] = ~(gap[1:] & gap[:-1])
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = ~gap[starts]
    return out[keep], np.r_[0, np.cumsum(keep)][offsets]


class Automaton:
    """The suffix automaton of a byte string: for each state its transitions."""

    def __init__(self, text: bytes) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Model:
    """Automata of all languages as dense tables over the symbols of the training texts."""

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.langs, self.texts = sorted(texts), texts
        used = sorted(set().union(*[set(t) for t in texts.values()])) if texts else []
        # symbol 0: none (padding); 1: one that no training text has
        self.symbol = np.ones(256, np.uint8)
        for k, b in enumerate(used):
            self.symbol[b] = k + 2
        self.width = len(used) + 2
        self.bits = [float(np.log2(max(len(texts[x]), 2))) for x in self.langs]
        self.limit: dict[str, float] = {}
        self.tables = [self._table(Automaton(texts[x])) for x in self.langs]

    def _table(self, automaton: Automaton) -> np.ndarray:
        """(state, symbol) -> next state's row, times 2, plus 1 where a phrase begins with the symbol.

        At the root no phrase is under way; a symbol unseen there is a phrase of its own.
        """
        w = self.width
        root = np.ones(w, np.int64)
        root[0] = 0
        for b, to in automaton.next[0].items():
            root[self.symbol[b]] = to * w << 1 | 1
        table = np.tile(root, (len(automaton.next), 1))
        for state, edges in enumerate(automaton.next):
            if state:
                table[state, 0] = state * w << 1
                for b, to in edges.items():
                    table[state, self.symbol[b]] = to * w << 1
        return table.astype(np.int32).ravel()

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of phrases of each normalised text in each language: [text, language]."""
        size = np.diff(offsets)
        n = len(size)
        out = np.zeros((n, len(self.langs)), np.int64)
        pieces = -(-size // SEGMENT)
        total = int(pieces.sum())
        if not total:
            return out
        row = np.repeat(np.arange(n), pieces)
        place = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][row] + place * SEGMENT
        length = np.minimum(offsets[1:][row] - start, SEGMENT)
        order = np.argsort(-length, kind="stable")
        where = np.empty(total, np.int64)
        where[order] = np.arange(total)
        # the lanes that go on from another, and those others
        later = where[place > 0]
        before = where[np.flatnonzero(place > 0) - 1]
        start, length, row = start[order], length[order], row[order]
        codes = np.r_[self.symbol[data], np.zeros(SEGMENT, np.uint8)].astype(np.int32)
        longest = int(length[0])
        active = np.searchsorted(-length, -np.arange(longest), side="left")  # segments longer than t
        states = [np.zeros(total, np.int32) for _ in self.langs]
        begins = [np.zeros((longest, total), bool) for _ in self.langs]
        for t in range(longest):
            k = int(active[t])
            sym = codes[start[:k] + t]
            for table, state, begin in zip(self.tables, states, begins, strict=True):
                s = state[:k]
                s += sym
                v = table[s]
                np.not_equal(v & 1, 0, out=begin[t, :k])
                np.right_shift(v, 1, out=s)
        for x, (table, state, begin) in enumerate(zip(self.tables, states, begins, strict=True)):
            count = begin.sum(0, dtype=np.int64)
            count += self._entered(table, codes, start, length, state, begin, later, before)
            out[:, x] = np.bincount(row, weights=count, minlength=n)
        return out

    @staticmethod
    def _entered(table: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray, begin: np.ndarray, later: np.ndarray, before: np.ndarray) -> np.ndarray:
        """What each segment's count changes by as it is entered in the state that the one before it ended in.

        A segment in which the two parses don't meet ends in another state, so the next one is entered again.
        """
        change = np.zeros(len(state), np.int64)
        end = state.copy()
        after = np.full(len(state), -1)
        after[before] = later
        lanes, entry = later, end[before]
        used = np.full(len(state), -1, np.int64)
        while len(lanes):
            now = lanes
            used[lanes] = entry
            live, s, delta = lanes, entry, np.zeros(len(lanes), np.int64)
            left = np.arange(len(lanes))
            for t in range(len(begin)):
                over = length[live] <= t
                if over.any():
                    end[live[over]] = s[over]
                    change[live[over]] = delta[left[over]]
                    live, s, left = live[~over], s[~over], left[~over]
                if not len(live):
                    break
                v = table[s + codes[start[live] + t]]
                first, other = (v & 1) != 0, begin[t, live]
                met = first & other
                if met.any():
                    change[live[met]] = delta[left[met]]
                    end[live[met]] = state[live[met]]
                    live, v, left, first, other = live[~met], v[~met], left[~met], first[~met], other[~met]
                delta[left] += first.astype(np.int64) - other
                s = v >> 1
            if len(live):
                end[live] = s
                change[live] = delta[left]
            # those that follow a segment that ends otherwise than they were entered
            again = now[(after[now] >= 0)]
            again = again[end[again] != used[after[again]]]
            lanes, entry = after[again], end[again]
        return change

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of raw texts: best language's number (-1: none), its bits a symbol, the lead over the next, symbols."""
        norm, at = normalise(data, offsets)
        size = np.diff(at)
        if not self.langs:
            nan = np.full(len(size), np.nan)
            return np.full(len(size), -1), nan, nan, size
        bits = self.phrases(norm, at) * np.array(self.bits) / np.maximum(size, 1)[:, None]
        best = np.where(size > 0, bits.argmin(1), -1)
        ranked = np.sort(bits, 1)
        lead = ranked[:, 1] - ranked[:, 0] if len(self.langs) > 1 else np.full(len(size), np.inf)
        return best, np.where(size > 0, ranked[:, 0], np.nan), np.where(size > 0, lead, np.nan), size

    def reason(self, best: np.ndarray, bits: np.ndarray, size: np.ndarray) -> list[str | None]:
        """Why a document is rejected; null where it isn't."""
        limits = np.array([self.limit.get(x, np.inf) for x in self.langs] + [np.inf])
        over = bits > limits[best] * (1 + SHORT / np.maximum(size, 1))
        return ["no model" if not self.langs else "no letters" if not n else "no language" if o else None for n, o in zip(size, over, strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Model:
    """A model of a bounded sample: of each language the ``rows`` documents of least hashed id, each up to ``most`` characters.

    Of these every fourth is held out; the rest, up to ``most`` normalised bytes, make the automaton. The
    limit of a language is SLACK times the median bits a symbol of its held-out documents of 200
    symbols or more that are parsed as that language.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(F.trim("lang") != "")
    by = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labelled.where("id IS NOT NULL").distinct().withColumn("n", F.row_number().over(by)).where(F.col("n") <= rows).collect()
    wanted = {(r["id"], r["lang"]): r["n"] for r in chosen}
    if not wanted:
        return Model({})
    found = docs.select(F.col(id_col).alias("id"), F.substring(text_col, 1, most).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isin([k[0] for k in wanted]) & F.col("text").isNotNull())
    texts: dict[str, list[tuple[int, bytes, str]]] = {}
    for r in found.distinct().collect():
        n = wanted.get((r["id"], r["lang"]))
        if n is not None:
            raw = r["text"].encode("utf-8", "replace")
            data, _ = normalise(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            texts.setdefault(r["lang"], []).append((n, data.tobytes(), r["text"]))
    parts, held = {}, []
    for lang, got in texts.items():
        got.sort()
        used = [t for n, t, _ in got if n % 4 or len(got) < 4]
        parts[lang] = b" ".join(used)[:most]
        held += [(lang, raw) for n, _, raw in got if n % 4 == 0 and len(got) >= 4]
    # twice as many states as symbols at the most, for each a row as wide as the alphabet
    size = sum(8 * len(t) * (len(set(b"".join(parts.values()))) + 2) for t in parts.values())
    if size > MODEL_BYTES:
        parts = {k: t[: int(len(t) * MODEL_BYTES / size)] for k, t in parts.items()}
    model = Model({k: t for k, t in parts.items() if t.strip()})
    if held and model.langs:
        data, offsets = textbuf.column(pa.array([t for _, t in held]))
        best, bits, _, size = model.judge(data, offsets)
        for x, lang in enumerate(model.langs):
            own = [b for (y, _), k, b, n in zip(held, best, bits, size, strict=True) if y == lang and k == x and n >= 200]
            if own:
                model.limit[lang] = SLACK * float(np.median(own))
    return model


@functools.lru_cache(maxsize=1)
def _load(key: str, holder: object) -> Model:
    return pickle.loads(holder.value)


textbuf.CACHES.append(_load.cache_clear)


class _Shipped:
    """A model as a broadcast variable of MODEL_BYTES at the most; loaded once in each worker."""

    def __init__(self, docs: DataFrame, model: Model) -> None:
        self.key = uuid.uuid4().hex
        self.held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def get(self) -> Model:
        return _load(self.key, self.held)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each document's language: id, language, bits, lead, symbols, reason (null: accepted), accepted."""
    shipped = _Shipped(docs, model or train(docs, id_col, text_col, lang_col))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.get()
        names = np.array([*m.langs, None], object)
        for batch in batches:
            data, offsets = textbuf.column(batch.column(1))
            for i, j in textbuf.chunks(offsets):
                best, bits, lead, size = m.judge(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                why = m.reason(best, bits, size)
                columns = [batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(bits, from_pandas=True), pa.array(lead, from_pandas=True), pa.array(size, pa.int64()), pa.array(why, pa.string()), pa.array([w is None for w in why])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "language", "bits", "lead", "symbols", "reason", "accepted"])

    return base.mapInArrow(run, f"id {kind}, language string, bits double, lead double, symbols bigint, reason string, accepted boolean").withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that have a language, with all their columns."""
    shipped = _Shipped(docs, model or train(docs, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.get()
        for batch in batches:
            data, offsets = textbuf.column(batch.column(at))
            for i, j in textbuf.chunks(offsets):
                best, bits, _, size = m.judge(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield batch.slice(i, j - i).filter(pa.array([w is None for w in m.reason(best, bits, size)]))

    return docs.mapInArrow(run, docs.schema)
