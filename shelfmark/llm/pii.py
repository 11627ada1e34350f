"""Personal data by weak supervision.

Candidates for spans are found over whole texts: runs of a type's form, and two capitalised words
where the first is a known given name or a form of address stands before them. Labelers - strict formats, check digits,
gazetteers, the words around, the edges of the span - each vote for, against, or abstain. Vote
patterns are counted over all documents; expectation-maximisation on the counts estimates, for
each labeler and type, how often it is right, and gives each pattern a probability. A logistic
span classifier is trained on those probabilities, on a bounded sample of spans, and its
decisions redact the texts.

Types: email, phone, ip, card, ssn, iban, person. A span becomes its type in brackets,
``[EMAIL]``; text outside of spans is left as it is.

Defined cases: a null text stays null, an empty one empty, both without spans; overlapping
candidates: the first in order of types at the leftmost place; equal rows give equal rows; with
no candidates in the whole table the model's prior decides and nothing changes; other columns
don't take part. Offsets count characters of the original text.
"""

from __future__ import annotations

import ipaddress
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textbuf
from shelfmark.session import written

TYPES = ("email", "ip", "ssn", "card", "phone", "iban", "person")
LABELERS = ("format", "check", "gazetteer", "context", "edges")
#: Spans that the classifier is trained on, those of least hash; everything else covers all documents.
TRAIN_SPANS = 20_000
THRESHOLD = 0.5
AROUND = 48
SHAPES = 5

GIVEN = frozenset(
    """james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah
    charles karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew
    donna joshua michelle kenneth carol kevin amanda brian melissa george deborah edward stephanie ronald rebecca timothy sharon jason laura
    jeffrey cynthia ryan dorothy jacob amy gary kathleen nicholas angela eric shirley jonathan brenda stephen emma larry anna justin pamela
    pierre jean michel camille sophie claire nicolas philippe isabelle juan carlos jose luis maria carmen ana javier miguel hans klaus
    jurgen wolfgang sabine ursula petra stefan katrin""".split()
)
#: Given names are looked for as runs of these, so that no quote, dash or space beyond ASCII can hide one.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: First bytes of the characters beyond ASCII that may be digits.
_DIGIT_LEAD = np.isin(np.arange(256), sorted({chr(c).encode()[0] for c in range(128, 0x110000) if chr(c).isdecimal()}))
_GIVEN_HASH = np.sort(textbuf.words(*textbuf.column(pa.array([" ".join(sorted(GIVEN))])))[0])
PROVIDERS = frozenset("gmail yahoo hotmail outlook icloud proton aol gmx mail web orange free".split())
_TLD = frozenset("com org net edu gov io co uk de fr es it eu info biz us ca au jp cn in nl ch at be br mx".split())
_CUES = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel", "kontakt"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "contact", "appel", "anruf", "llam", "whatsapp"),
    "ip": ("ip", "host", "address", "server", "login", "adresse", "client"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "carte", "karte", "tarjeta", "amex"),
    "ssn": ("ssn", "social", "security", "tax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "person": ("mr", "mrs", "ms", "dr", "name", "dear", "by", "herr", "frau", "madame", "monsieur", "señor", "nombre", "nom"),
}
_AGAINST = ("version", "release", "isbn", "issn", "order", "invoice", "commit", "sha", "md5", "doi", "ticket", "serial", "build", "article", "rfc")
_EMAIL = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|0\d(?:[ .-]\d{2}){4}(?!\w))"
    r")|(?<!\w)(?P<plus>\((?:\d{2,4})\) ?\d{3,4}[ .-]\d{3,4}(?!\w))"
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Titles and forms of address: a name after one is a candidate whatever the given name is.
TITLES = frozenset("mr mrs ms miss dr prof sir dear herr frau monsieur madame mme señor señora sr sra don doña".split())
#: The same where the name is told: "name is", "named", "signed".
TELLING = ("my name is", "name:", "named", "signed", "signed by", "je m'appelle", "ich heiße", "me llamo", "mi nombre es", "mein name ist", "mon nom est")
#: Words, as runs of ASCII letters, of which one is in every form of address but "señor" and "señora".
_ADDRESS = {t for t in TITLES if t.isascii()} | {"name", "named", "signed", "appelle", "hei", "llamo", "nombre", "nom"}
_TITLE_HASH = np.sort(textbuf.words(*textbuf.column(pa.array([" ".join(sorted(_ADDRESS))])))[0])
_BEFORE = re.compile(r"(?:\b(?:" + "|".join(sorted(TITLES)) + r")\.?|" + "|".join(re.escape(x) for x in TELLING) + r")\s+$")
#: Matches nothing but looks ahead, so that a title or the first word of a sentence doesn't take the name after it along.
_PERSON = re.compile(r"(?<!\w)(?=([A-Z]\w+)( (?:[A-Z]\.? )?[A-Z]\w+)(?!\w))")


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """The check digits of an IBAN: modulo 97."""
    flat = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def addressed(text: str, start: int) -> bool:
    """Whether a title or the like stands before a place."""
    return _BEFORE.search(text[max(0, start - 24) : start].lower()) is not None


def candidates(text: str, named: bool = True) -> list[tuple[int, int, str]]:
    """Spans that may be personal data: (start, end, type), disjoint and in order. ``named``: given names or forms of address occur."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    for m in _NUMBER.finditer(text):
        kind = m.lastgroup or "phone"
        found.append((*m.span(), "phone" if kind == "plus" else kind))
    if any(c.isdigit() for c in text):
        found += [(*m.span(), "iban") for m in _IBAN.finditer(text)]
    if named:
        found += [(m.start(1), m.end(2), "person") for m in _PERSON.finditer(text) if m[1].lower() in GIVEN or addressed(text, m.start(1)) and m[1].lower() not in TITLES]
    found.sort(key=lambda x: (x[0], TYPES.index(x[2])))
    out, end = [], 0
    for span in found:
        if span[0] >= end:
            out.append(span)
            end = span[1]
    return out


def votes(text: str, start: int, end: int, kind: str) -> list[int]:
    """The votes of all labelers on a span: 1 for, -1 against, 0 abstaining."""
    span = text[start:end]
    digits = re.sub(r"\D", "", span)
    near = text[max(0, start - AROUND) : start].lower() + " " + text[end : end + AROUND].lower()
    before, after = text[start - 1 : start], text[end : end + 1]
    form = check = gazetteer = 0
    if kind == "email":
        host = span.rpartition("@")[2].lower().split(".")
        form = 1 if re.fullmatch(r"[a-z]{2,}", host[-1]) and len(span) <= 254 else -1
        gazetteer = 1 if host[-1] in _TLD or host[0].rstrip("0123456789") in PROVIDERS else 0
    elif kind == "ip":
        parts = span.split(".")
        good = all(int(p) < 256 and (p == "0" or p[0] != "0") for p in parts)
        form = 1 if good else -1
        if good:
            check = 1 if any(int(p) > 31 for p in parts) else -1 if all(int(p) < 16 for p in parts) else 0
            gazetteer = -1 if ipaddress.ip_address(plain := ".".join(str(int(p)) for p in parts)).is_loopback or plain in ("0.0.0.0", "255.255.255.255") else 0
    elif kind == "card":
        form = 1 if len(digits) in (15, 16) and digits != digits[0] * len(digits) else -1
        check = 1 if luhn(digits) else 0
        gazetteer = 1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65", digits) else 0
    elif kind == "ssn":
        form = -1 if len(set(digits)) == 1 or digits in "0123456789" else 1
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "phone":
        form = 1 if 9 <= len(digits) <= 15 and ("+" in span or "(" in span or re.search(r"\d[ .-]\d", span)) else -1
        gazetteer = 1 if re.match(r"\+(1|33|34|44|49|39|31|32|41|43|351|52|55|61|81|86|91)\D", span) else 0
    elif kind == "iban":
        form = 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1
        check = 1 if iban_valid(span) else -1
    else:
        form = 1 if re.fullmatch(r"[^\W\d_]+(?: [A-Z]\.?)? [^\W\d_]+", span) and not span.isupper() else -1
        gazetteer = 1 if re.match(r"\w+", span)[0].lower() in GIVEN else -1
    words = set(re.findall(r"[^\W\d_]+", near))
    if kind == "person":
        words |= {"name"} if addressed(text, start) else set()
    context = 1 if any(c in words or any(w.startswith(c) for w in words if len(c) > 3) for c in _CUES[kind]) else 0
    if kind != "person" and any(w in words for w in _AGAINST):
        context = -1
    edges = -1 if before in ("/", "=", "#", "_") or after in ("/", "=", "_") or before == "-" and kind != "email" else 0
    return [form, check, gazetteer, context, edges]


def features(text: str, start: int, end: int, kind: str, vote: list[int]) -> list[float]:
    """What the span classifier sees: type, votes, shape."""
    span = text[start:end]
    n = max(len(span), 1)
    shape = [min(n, 40) / 40, sum(c.isdigit() for c in span) / n, sum(c.isupper() for c in span) / n, float("+" in span or "(" in span), float(" " in span)]
    return [float(kind == t) for t in TYPES] + [float(v > 0) for v in vote] + [float(v < 0) for v in vote] + shape


@dataclass
class Model:
    """Weights of the span classifier, and the reliabilities that labelled its training spans."""

    weights: np.ndarray
    right: np.ndarray  # [type, labeler]: votes for among the non-abstaining votes on true spans
    wrong: np.ndarray  # the same on false spans
    prior: np.ndarray  # [type]

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        """The probability that spans of these features are personal data."""
        if not rows:
            return np.zeros(0)
        x = np.c_[np.array(rows), np.ones(len(rows))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _posterior(kind: np.ndarray, vote: np.ndarray, right: np.ndarray, wrong: np.ndarray, prior: np.ndarray) -> np.ndarray:
    yes, no = np.log(prior[kind]), np.log1p(-prior[kind])
    a, b = right[kind], wrong[kind]
    yes = yes + np.where(vote > 0, np.log(a), np.where(vote < 0, np.log1p(-a), 0)).sum(1)
    no = no + np.where(vote > 0, np.log(b), np.where(vote < 0, np.log1p(-b), 0)).sum(1)
    return 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))


def estimate(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 60, strength: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reliabilities by expectation-maximisation over vote patterns with counts.

    Each labeler begins, and is held by ``strength`` pseudo-votes, at 0.8 for true and 0.2 for false
    spans; without that the two could change places. Priors are held at 0.5 by as many, and end
    between 0.1 and 0.9, reliabilities between 0.05 and 0.95: votes can always turn a decision.
    """
    t, labelers = len(TYPES), vote.shape[1] if vote.ndim == 2 else len(LABELERS)
    right, wrong, prior = np.full((t, labelers), 0.8), np.full((t, labelers), 0.2), np.full(t, 0.5)
    for _ in range(rounds):
        p = _posterior(kind, vote, right, wrong, prior) if len(kind) else np.zeros(0)
        for k in range(t):
            own = kind == k
            w1, w0 = (p * count)[own], ((1 - p) * count)[own]
            up, down = (vote[own] > 0), (vote[own] < 0)
            right[k] = (0.8 * strength + w1 @ up) / (strength + w1 @ (up | down))
            wrong[k] = (0.2 * strength + w0 @ up) / (strength + w0 @ (up | down))
            prior[k] = (0.5 * strength + w1.sum()) / (strength + count[own].sum())
    return np.clip(right, 0.05, 0.95), np.clip(wrong, 0.05, 0.95), np.clip(prior, 0.1, 0.9)


def every_pattern(right: np.ndarray, wrong: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all possible vote patterns, without shape, so that the classifier knows votes the corpus lacks."""
    vote = np.array(list(itertools.product((-1, 0, 1), repeat=len(LABELERS))))
    kind = np.repeat(np.arange(len(TYPES)), len(vote))
    vote = np.tile(vote, (len(TYPES), 1))
    x = np.c_[np.eye(len(TYPES))[kind], vote > 0, vote < 0, np.zeros((len(kind), SHAPES))].astype(float)
    return x, _posterior(kind, vote, right, wrong, prior)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, ridge: float = 1e-4) -> np.ndarray:
    """Weighted logistic regression on soft labels by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _hits(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, str, bool]]:
    """Rows that may have candidates: number, text, whether a given name or a form of address occurs. Others are passed over by their bytes."""
    values = batch.column(at)
    data, offsets = textbuf.column(values)
    for i, j in textbuf.chunks(offsets):
        part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        rows = np.zeros(j - i, bool)
        spot = np.flatnonzero((part >= 48) & (part < 58) | (part == 64) | _DIGIT_LEAD[part])
        rows[np.searchsorted(local, spot, side="right") - 1] = True
        h, row = textbuf.words(part, local, _LETTER)
        named = np.zeros(j - i, bool)
        near = np.minimum(np.searchsorted(_GIVEN_HASH, h), len(_GIVEN_HASH) - 1)
        named[row[_GIVEN_HASH[near] == h]] = True
        near = np.minimum(np.searchsorted(_TITLE_HASH, h), len(_TITLE_HASH) - 1)
        named[row[_TITLE_HASH[near] == h]] = True
        if len(part) > 2:  # the end of "señor"
            tilde = np.flatnonzero((part[:-2] == 0xC3) & ((part[1:-1] == 0xB1) | (part[1:-1] == 0x91)) & ((part[2:] | 0x20) == 111))
            named[np.searchsorted(local, tilde, side="right") - 1] = True
        # the Kelvin sign is a k in lower case
        kelvin = np.flatnonzero((part[:-2] == 0xE2) & (part[1:-1] == 0x84) & (part[2:] == 0xAA)) if len(part) > 2 else []
        named[np.searchsorted(local, kelvin, side="right") - 1] = True
        for k in np.flatnonzero(rows | named):
            yield int(k) + i, values[int(k) + i].as_py(), bool(named[k])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, vote, feat = [], [], []
        for _, text, named in _hits(batch, 0):
            for s, e, kind in candidates(text, named):
                v = votes(text, s, e, kind)
                kinds.append(TYPES.index(kind))
                vote.append(v)
                feat.append(features(text, s, e, kind, v))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(vote, pa.list_(pa.int32())), pa.array(feat, pa.list_(pa.float64()))], names=["kind", "votes", "features"])


def train(docs: DataFrame, text_col: str = "text", most: int = TRAIN_SPANS) -> Model:
    """A model of all documents' vote patterns. The driver gets the distinct patterns, and ``most`` distinct spans' features at most."""
    spans = docs.select(F.col(text_col).alias("text")).mapInArrow(_scan, "kind int, votes array<int>, features array<double>")
    seen = written(spans.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "pii-spans")
    patterns = seen.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    kind = np.array([r["kind"] for r in patterns], int)
    vote = np.array([r["votes"] for r in patterns], int).reshape(len(patterns), len(LABELERS))
    right, wrong, prior = estimate(kind, vote, np.array([r["n"] for r in patterns], float))
    sample = seen.orderBy(F.xxhash64("kind", "features"), "features").limit(most).collect()
    x = np.array([r["features"] for r in sample], float).reshape(len(sample), 2 * len(LABELERS) + len(TYPES) + SHAPES)
    y = _posterior(np.array([r["kind"] for r in sample], int), np.array([r["votes"] for r in sample], int).reshape(len(sample), len(LABELERS)), right, wrong, prior)
    more, label = every_pattern(right, wrong, prior)
    # the corpus and the patterns weigh as much as each other
    weight = np.r_[np.full(len(x), 1 / max(len(x), 1)), np.full(len(more), 1 / len(more))]
    weights = fit(np.r_[x, more], np.r_[y, label], weight)
    return Model(weights, right, wrong, prior)


def redact_text(text: str, model: Model, named: bool = True, threshold: float = THRESHOLD) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its spans replaced, and the spans."""
    found = candidates(text, named)
    rows = [features(text, s, e, k, votes(text, s, e, k)) for s, e, k in found]
    keep = [x for x, p in zip(found, model.probability(rows), strict=True) if p > threshold]
    out, at = [], 0
    for s, e, k in keep:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]]), keep


def _redacted(batch: pa.RecordBatch, at: int, model: Model, threshold: float) -> tuple[pa.Array, dict[int, list[tuple[int, int, str]]]]:
    new, spans = {}, {}
    for k, text, named in _hits(batch, at):
        changed, found = redact_text(text, model, named, threshold)
        if found:
            new[k], spans[k] = changed, found
    column = batch.column(at)
    if new:
        values = column.to_pylist()
        for k, text in new.items():
            values[k] = text
        column = pa.array(values, column.type)
    return column, spans


SPANS = "array<struct<start:int,end:int,type:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))


def redact(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every document redacted: id, text, spans, n_spans."""
    model = model or train(docs, text_col)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = _redacted(batch, 1, model, threshold)
            rows = [[{"start": s, "end": e, "type": t} for s, e, t in spans.get(k, [])] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(rows, _SPAN_TYPE), pa.array([len(r) for r in rows], pa.int32())], names=["id", "text", "spans", "n_spans"])

    return base.mapInArrow(run, f"id {kind}, text string, spans {SPANS}, n_spans int").withColumnRenamed("id", id_col)


def cleaned(docs: DataFrame, model: Model | None = None, text_col: str = "text", chars_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with redacted texts and all their columns; ``chars_col`` is counted again where the text changed."""
    model = model or train(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = _redacted(batch, at, model, threshold)
            columns = list(batch.columns)
            columns[at] = text
            if chars_col in batch.schema.names and spans:
                k = batch.schema.names.index(chars_col)
                count = columns[k].to_pylist()
                for row in spans:
                    count[row] = len(text[row].as_py())
                columns[k] = pa.array(count, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
