"""Quality rules from tokeniser fertility.

Public vocabularies measure each document: characters per token, share of byte-fallback
tokens, entropy of the document's tokens. Each language (each script where the language is
null) has bands for each measure by octave of the number of tokens, since all measures vary more,
and entropy is less, in short documents: the median plus or minus a multiple of the median deviation, of all
documents of any length. A document outside a band is rejected.

Bands of few documents are drawn to wider ones: an octave's median and deviation are averaged with those of all
lengths of its language, and these with those of all documents, each of which weighs as much as ``PRIOR``
documents. The deviation allowed is ``k * MAD * (1 + SHORT / tokens)``.

Defined cases: a null, empty or blank text has 0 tokens, null measures, and is rejected as
``empty``; a null or empty language is judged by the script that most of the letters have (``none`` without letters; of
two with as many the first of ``SCRIPTS``); equal rows are judged alike; other columns don't take part.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from shelfmark.llm import spiece, textbuf
from shelfmark.session import written

PIECES = spiece.MODEL
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEASURES = ("chars_per_token", "byte_share", "entropy", "chars_per_token_2")
BINS = 1000
#: As wide as it takes to keep all documents labelled good (3,409 of sf0.1; of 571 bad ones 397 go).
K = 12.0
SHORT = 20.0
#: Text that tokenises well is no junk by itself: only this many times the median is too much.
TIMES = 3.0
PRIOR = 50.0
#: Scripts and the code points that they have.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x137F),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)),
}
_RANGES = sorted((lo, hi, k) for k, spans in enumerate(SCRIPTS.values()) for lo, hi in spans)
_STARTS, _ENDS, _SCRIPT = (np.array(x) for x in zip(*_RANGES, strict=True))
#: The least deviation of each measure: bands are never narrower than K times this.
FLOOR = {"chars_per_token": 0.05, "byte_share": 0.01, "entropy": 0.05, "chars_per_token_2": 0.05}
#: A band's sides that reject: low, high.
SIDES = {"chars_per_token": (True, True), "byte_share": (False, True), "entropy": (True, False), "chars_per_token_2": (True, True)}


@functools.lru_cache(maxsize=4)
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Token counts of words seen by this worker, by vocabulary; emptied when it holds SEEN words.
_seen: dict[str, dict[bytes, int]] = {}
SEEN = 1 << 17
textbuf.CACHES += [_ranks.cache_clear, _seen.clear]


def _token_counts(path: str, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The number of tokens of each word in a byte-level vocabulary."""
    encode, seen = _ranks(path).encode_ordinary, _seen.setdefault(path, {})
    if len(seen) > SEEN:
        seen.clear()
    raw, out = buf.tobytes(), np.empty(len(s), np.int64)
    for k, (a, b) in enumerate(zip(s.tolist(), e.tolist(), strict=True)):
        word = raw[a:b]
        n = seen.get(word)
        if n is None:
            n = seen[word] = len(encode(word.decode("utf-8", "replace")))
        out[k] = n
    return out


def _entropy(flat: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Entropy in bits of the tokens of each row."""
    out = np.full(len(n), np.nan)
    keys = np.sort(row.astype(np.int64) << 20 | flat)
    if not len(keys):
        return out
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[first, len(keys)]).astype(float)
    part = np.bincount(keys[first] >> 20, weights=count * np.log2(count), minlength=len(n))
    has = n > 0
    out[has] = np.log2(n[has]) - part[has] / n[has]
    return out


def measure_texts(data: np.ndarray, offsets: np.ndarray, pieces: str = PIECES, ranks: str = RANKS) -> dict[str, np.ndarray]:
    """The measures of each text of a buffer; all texts whole."""
    v = spiece.vocabulary(pieces)
    rows = len(offsets) - 1
    chars = np.add.reduceat(np.r_[((data & 0xC0) != 0x80), False].astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) if rows else np.zeros(0, np.int64)
    buf, s, e, row = spiece.units(v, data, offsets)
    empty = np.zeros(rows)
    if not len(s):
        nan = np.full(rows, np.nan)
        return {"chars": chars, "tokens": empty.astype(np.int64), **dict.fromkeys(MEASURES, nan)}
    first, number = spiece.distinct_spans(buf, s, e)
    ids, count = spiece.encode_spans(v, buf, s[first], e[first])
    at = np.cumsum(count) - count
    n = count[number]
    flat = textbuf.gather(ids, at[number], n)
    token_row = np.repeat(row, n)
    tokens = np.bincount(token_row, minlength=rows)
    fallback = np.bincount(token_row, weights=v.is_byte[flat] & (flat != v.byte_id[10]) & (flat != v.byte_id[9]) & (flat != v.byte_id[13]), minlength=rows)
    second = _token_counts(ranks, buf, s[first], e[first])
    tokens2 = np.bincount(row, weights=second[number], minlength=rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "chars": chars,
            "tokens": tokens,
            "chars_per_token": np.where(tokens > 0, chars / tokens, np.nan),
            "byte_share": np.where(tokens > 0, fallback / tokens, np.nan),
            "entropy": _entropy(flat, token_row, tokens),
            "chars_per_token_2": np.where(tokens2 > 0, chars / tokens2, np.nan),
        }


def scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The script that most letters of each text have."""
    n, kinds = len(offsets) - 1, len(SCRIPTS)
    code, at = spiece.characters(data)
    spot = np.searchsorted(_STARTS, code, side="right") - 1
    good = np.flatnonzero((spot >= 0) & (code <= _ENDS[spot]))
    row = np.searchsorted(offsets, at[good], side="right") - 1
    count = np.bincount(row * kinds + _SCRIPT[spot[good]], minlength=n * kinds).reshape(n, kinds)
    return np.where(count.any(1), np.array([*SCRIPTS])[count.argmax(1)] if n else "", "none")


def _measured(batch: pa.RecordBatch, text: int, lang: int, pieces: str, ranks: str) -> Iterator[tuple[int, int, dict[str, np.ndarray], list[str]]]:
    data, offsets = textbuf.column(batch.column(text))
    langs = batch.column(lang).to_pylist()
    for i, j in textbuf.chunks(offsets):
        part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        m = measure_texts(part, local, pieces, ranks)
        blank = np.bincount(np.searchsorted(local, np.flatnonzero(part > 0x20), side="right") - 1, minlength=j - i) == 0
        m["tokens"] = np.where(blank, 0, m["tokens"])
        for k in MEASURES:
            m[k] = np.where(blank, np.nan, m[k])
        script = scripts(part, local) if not all(langs[i:j]) else None
        yield i, j, m, [x if x else f"script:{script[k]}" for k, x in enumerate(langs[i:j])]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """The measures of each document: id, grp, chars, tokens, and each of MEASURES."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, m, grp in _measured(batch, 1, 2, pieces, ranks):
                columns = [batch.column(0).slice(i, j - i), pa.array(grp), pa.array(m["chars"], pa.int64()), pa.array(m["tokens"], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m[k], pa.float64(), from_pandas=True) for k in MEASURES)], names=["id", "grp", "chars", "tokens", *MEASURES])

    return base.mapInArrow(run, f"id {kind}, grp string, chars bigint, tokens bigint, " + ", ".join(f"{k} double" for k in MEASURES))


def _median(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The lower median of a value that has counts, for each key: exact over all counts."""
    by = Window.partitionBy(*keys)
    seen = counts.withColumn("upto", F.sum("n").over(by.orderBy(value))).withColumn("total", F.sum("n").over(by))
    return seen.where(F.col("upto") * 2 >= F.col("total")).groupBy(*keys).agg(F.min(value).alias("median"), F.first("total").alias("total"))


def bands(measures: DataFrame) -> DataFrame:
    """Median and median deviation of each measure in each group: grp, measure, octave (of tokens; -1: of all), median, mad, total.

    Values are counted in bins of 1/BINS (characters per token 10/BINS, entropy 20/BINS), over all documents that have
    tokens; the group '' is that of all documents.
    """
    octaves = F.explode(F.array(F.floor(F.log2("tokens")).cast("int"), F.lit(-1))).alias("octave")
    long = measures.where("tokens > 0").select("grp", "tokens", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in MEASURES]), F.array(*MEASURES))).alias("measure", "x")).where("x IS NOT NULL")
    step = F.when(F.col("measure").startswith("chars"), 10.0 / BINS).when(F.col("measure") == "entropy", 20.0 / BINS).otherwise(1.0 / BINS)
    counts = long.select("grp", "measure", octaves, F.round(F.col("x") / step).cast("bigint").alias("bin")).groupBy("grp", "measure", "octave", "bin").agg(F.count("*").alias("n"))
    counts = counts.unionByName(counts.groupBy(F.lit("").alias("grp"), "measure", "octave", "bin").agg(F.sum("n").alias("n")))
    keys = ["grp", "measure", "octave"]
    mid = _median(counts, keys, "bin")
    away = counts.join(mid.select(*keys, F.col("median").alias("mid")), keys).groupBy(*keys, F.abs(F.col("bin") - F.col("mid")).alias("away")).agg(F.sum("n").alias("n"))
    spread = _median(away, keys, "away")
    return mid.join(spread.select(*keys, F.col("median").alias("mad")), keys).select(*keys, (F.col("median") * step).alias("median"), (F.col("mad") * step).alias("mad"), "total")


Bands = dict[tuple[str, str, int], tuple[float, float]]


def drawn(found: dict[tuple[str, str, int], tuple[float, float, int]]) -> Bands:
    """Bands (group, measure, octave) of medians, deviations and counts, those of few documents drawn to wider ones."""
    out: Bands = {}
    for key in sorted(found, key=lambda k: (k[0] != "", k[2] != -1, k)):  # all documents first, then all lengths
        grp, measure, octave = key
        median, mad, n = found[key]
        wider = out.get((grp, measure, -1)) if octave >= 0 else out.get(("", measure, -1)) if grp else None
        if wider:
            median, mad = ((n * a + PRIOR * b) / (n + PRIOR) for a, b in zip((median, mad), wider, strict=True))
        out[key] = (median, max(mad, FLOOR[measure]))
    return out


def band_table(measures: DataFrame) -> Bands:
    """The bands on the driver: a few numbers for each language."""
    return drawn({(r["grp"], r["measure"], r["octave"]): (r["median"], r["mad"], r["total"]) for r in bands(measures).collect()})


def _limits(median: float, mad: float, tokens: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
    room = k * mad * (1 + SHORT / np.maximum(tokens, 1))
    return median - room, np.maximum(median + room, TIMES * median)


def reasons(m: dict[str, np.ndarray], grp: list[str], table: Bands, k: float = K) -> list[list[str]]:
    """The rules that each document breaks."""
    n = len(grp)
    out: list[list[str]] = [[] for _ in range(n)]
    for i in np.flatnonzero(m["tokens"] == 0):
        out[i].append("empty")
    names, number = np.unique(np.array(grp, object).astype(str), return_inverse=True) if n else (np.zeros(0, str), np.zeros(0, np.int64))
    octave = np.floor(np.log2(np.maximum(m["tokens"], 1))).astype(np.int64)
    cell = np.where(m["tokens"] > 0, number * 64 + octave, -1)
    for c in np.unique(cell[cell >= 0]):
        at = np.flatnonzero(cell == c)
        g, o = str(names[c // 64]), int(c % 64)
        for name in MEASURES:
            band = next((table[key] for key in ((g, name, o), (g, name, -1), ("", name, o), ("", name, -1)) if key in table), None)
            if band is None:
                continue
            low, high = _limits(*band, m["tokens"][at], k)
            x = m[name][at]
            for side, bad in (("low", SIDES[name][0] & (x < low)), ("high", SIDES[name][1] & (x > high))):
                for i in at[bad]:
                    out[i].append(f"{name}_{side}")
    return out


def judge(measures: DataFrame, k: float = K) -> DataFrame:
    """Each measured document with the rules it breaks: ... reasons, keep."""
    table = band_table(measures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", *MEASURES)}
            why = reasons(m, batch.column("grp").to_pylist(), table, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(why, pa.list_(pa.string())), pa.array([not w for w in why])], names=[*batch.schema.names, "reasons", "keep"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measures.schema)
    return measures.mapInArrow(run, f"{fields}, reasons array<string>, keep boolean")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: str = PIECES, ranks: str = RANKS, k: float = K) -> DataFrame:
    """Measures and verdict of every document; the measures are written once, then read for bands and verdicts."""
    found = written(measure(docs, id_col, text_col, lang_col, pieces, ranks), "fertility")
    return judge(found, k).withColumnRenamed("id", id_col)


def kept(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", pieces: str = PIECES, ranks: str = RANKS, k: float = K) -> DataFrame:
    """The rows that no rule rejects, with all their columns.

    Each text is measured once: the rows are written beside their measures, then read for bands and
    verdicts; no row is shuffled. The added columns get a prefix that no column of docs has.
    """
    names, prefix = docs.columns, "m_"
    while any(c.lower().startswith(prefix) for c in names):
        prefix += "_"
    at_text, at_lang = names.index(text_col), names.index(lang_col)
    added = ["grp", "tokens", *MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, m, grp in _measured(batch, at_text, at_lang, pieces, ranks):
                columns = [pa.array(grp, pa.string()), pa.array(m["tokens"], pa.int64()), *(pa.array(m[c], pa.float64(), from_pandas=True) for c in MEASURES)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *columns], names=[*names, *(prefix + c for c in added)])

    schema = StructType([*docs.schema.fields, *(StructField(prefix + c, t) for c, t in zip(added, [StringType(), LongType(), *[DoubleType()] * len(MEASURES)], strict=True))])
    beside = written(docs.mapInArrow(run, schema), "measured")
    table = band_table(beside.select(*[F.col(prefix + c).alias(c) for c in added]))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = {c: batch.column(prefix + c).to_numpy(zero_copy_only=False) for c in added[1:]}
            keep = np.array([not w for w in reasons(m, batch.column(prefix + "grp").to_pylist(), table, k)], bool)
            yield batch.select(names).filter(pa.array(keep))

    return beside.mapInArrow(sift, docs.schema)
