"""Secret scans with a character convolutional network in numpy.

Candidates are the values of assignments to key-like names, whatever their length and characters, and all other
runs of at least ``LEAST`` key-like characters with a digit or a capital inside (a shorter or plainer run
without a name has nothing that tells it from a word); they are found over whole texts, and
the network sees each with the characters around it. One convolution over
character embeddings, the maximum over the span and the maximum over its surroundings, and a
logistic output: small enough to be trained here, on labelled findings.

Scores are calibrated on held-out findings (Platt's sigmoid), and the threshold is the highest
that still has a recall of ``RECALL`` there; a held-out secret that is no candidate counts as missed.

Labelled findings may be given as rows of (before, candidate, after, label); else they are made by a
seeded generator of key formats (hex, base64, prefixed keys, signed tokens, passwords in
assignments of 6 to 32 characters) and of look-alikes (checksums, UUIDs, versions, paths, numbers, identifiers, data,
and plain values of such assignments).

Defined cases: null and empty texts have no candidates; a run within the value of a named assignment is part of that; a candidate longer than ``WIDEST`` is judged by
the highest score of its windows of that width, and reported whole; a result row is a candidate that scores at or
above the threshold, or with ``everything`` each candidate; null ids are kept; equal rows report alike; other
columns don't take part. The secret itself is never in the result, only its place and a digest.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textbuf

LEAST = 16
WIDEST = 64
#: Windows overlap by WIDEST - STEP: a key of up to 56 characters is whole in one, a longer one fills all but 7 of one.
STEP = 8
CONTEXT = 24
WIDTH = WIDEST + 2 * CONTEXT
RECALL = 0.98
FINDINGS = 6000
FILTERS, KERNEL, EMBED = 24, 5, 8

_KEY = np.zeros(256, bool)
_KEY[48:58] = _KEY[65:91] = _KEY[97:123] = True
for _c in b"+/=_-.~":
    _KEY[_c] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Symbols: 0 padding, then printable ASCII, then one for control bytes, one for others.
_SYMBOL = np.full(256, 97, np.int64)
_SYMBOL[32:127] = np.arange(1, 96)
_SYMBOL[:32] = 96


_NAME = re.compile(rb"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|credentials?|auth(?:orization)?|(?:api|access|private|client|secret|encryption|signing)[ _-]?key|[a-z0-9]_key|(?<![a-z])key)")
_VALUE = re.compile(rb"""[A-Za-z0-9_]{0,24}["']?[ \t]{0,3}(?:=>|:=|=|:)[ \t]{0,3}(?:(?:Bearer|Basic)[ ]+)?(?:"([^"\n]{4,})"|'([^'\n]{4,})'|([^\s"',;]{4,}))""")


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of key-like characters; edge punctuation isn't part of one."""
    s, e = textbuf.spans(_KEY[data], offsets[:-1])
    keep = e - s >= LEAST
    s, e = s[keep], e[keep]
    for _ in range(3):  # trailing dots and dashes, and the sign of an assignment
        s = s + np.isin(data[s], np.frombuffer(b"=.-/~", np.uint8))
        e = e - np.isin(data[e - 1], np.frombuffer(b".-/~", np.uint8)) if len(e) else e
    marks = _DIGIT[data]
    upper = (data >= 65) & (data < 91)
    if len(data):
        marks[1:] |= upper[1:] & (data[:-1] >= 97) & (data[:-1] < 123)  # a capital after a small letter
    marks = np.r_[0, np.cumsum(marks)]
    keep = (e - s >= LEAST) & (marks[np.maximum(e, s)] > marks[np.minimum(s + 1, len(data))] - _DIGIT[data[s]])
    return s[keep], e[keep]


def _named(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """The values of assignments to key-like names; none goes over the end of its text."""
    raw, out = data.tobytes(), []
    for m in _NAME.finditer(raw):
        k = int(np.searchsorted(offsets, m.start(), side="right"))
        end = int(offsets[k])
        if m.end() <= end and (v := _VALUE.match(raw, m.end(), end)):
            a, b = v.span(v.lastindex)
            out.append((a, b))
    return out


def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of candidates in the bytes of many texts, in order."""
    s, e = _runs(data, offsets)
    named = np.array(sorted(set(_named(data, offsets))), np.int64).reshape(-1, 2)
    if len(named):
        # names within a value, and runs within one, are part of it
        ends = np.maximum.accumulate(named[:, 1])
        named = named[np.r_[True, named[1:, 1] > ends[:-1]]]
        k = np.searchsorted(named[:, 0], s, side="right") - 1
        inside = (k >= 0) & (e <= named[np.maximum(k, 0), 1])
        s, e = np.r_[s[~inside], named[:, 0]], np.r_[e[~inside], named[:, 1]]
        order = np.lexsort((e, s))
        s, e = s[order], e[order]
    return s, e


def windows(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates as parts of at most WIDEST bytes, one every STEP bytes and one at the end: number of the candidate, start, end."""
    count = np.maximum(0, -(-(e - s - WIDEST) // STEP)) + 1
    of = np.repeat(np.arange(len(s)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(np.minimum(s[of] + k * STEP, e[of] - WIDEST), s[of])
    return of, start, np.minimum(start + WIDEST, e[of])


def view(data: np.ndarray, s: np.ndarray, e: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The symbols of each window with its surroundings, [n, WIDTH]; ``low`` and ``high`` bound its text."""
    place = np.arange(WIDTH) - CONTEXT
    at = s[:, None] + place
    good = (at >= low[:, None]) & (at < high[:, None]) & (place < (e - s)[:, None] + CONTEXT)
    return np.where(good, _SYMBOL[data[np.clip(at, 0, max(len(data) - 1, 0))]], 0)


@dataclass
class Network:
    """Weights, calibration and threshold."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _forward(self, x: np.ndarray, size: np.ndarray) -> tuple:
        """Scores and what the backward pass needs."""
        n = len(x)
        emb = self.embed[x]
        place = np.arange(WIDTH)
        inside = (place >= CONTEXT) & (place < CONTEXT + np.minimum(size, WIDEST)[:, None])
        emb = np.concatenate([emb, inside[:, :, None].astype(emb.dtype)], 2)
        steps = WIDTH - KERNEL + 1
        window = np.lib.stride_tricks.sliding_window_view(emb, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(n * steps, -1)
        act = (window @ self.conv + self.bias).reshape(n, steps, FILTERS)
        act = np.maximum(act, 0)
        core = inside[:, KERNEL // 2 : KERNEL // 2 + steps]
        a, b = np.where(core[:, :, None], act, -1), np.where(core[:, :, None], -1, act)
        ia, ib = a.argmax(1), b.argmax(1)
        mean = np.where(core[:, :, None], act, 0).sum(1) / np.maximum(core.sum(1), 1)[:, None]
        pa_, pb = np.take_along_axis(act, ia[:, None], 1)[:, 0], np.take_along_axis(act, ib[:, None], 1)[:, 0]
        hidden = np.concatenate([pa_, pb, mean, np.minimum(size, WIDEST)[:, None] / WIDEST], 1)
        return hidden @ self.out + self.out_bias, hidden, act, ia, ib, core, window, x

    def raw(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Uncalibrated scores."""
        return np.concatenate([self._forward(x[k : k + 512], size[k : k + 512])[0] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of being a secret."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x, size) + self.shift, -30, 30)))


def train_network(x: np.ndarray, size: np.ndarray, y: np.ndarray, epochs: int = 6, seed: int = 5, recall: float = RECALL, found: np.ndarray | None = None) -> Network:
    """Adam on three quarters of the findings; calibration and threshold on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 4], order[len(x) // 4 :]
    wide = (EMBED + 1) * KERNEL
    net = Network(rng.normal(0, 0.5, (98, EMBED)), rng.normal(0, (2 / wide) ** 0.5, (wide, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS + 1), 0.0)
    net.embed[0] = 0
    params = [net.embed, net.conv, net.bias, net.out, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            z, hidden, act, ia, ib, core, window, xs = net._forward(x[batch], size[batch])
            n, steps = len(batch), act.shape[1]
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / n
            dh = dz[:, None] * net.out
            da = np.zeros_like(act)
            rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None]
            np.add.at(da, (rows, ia, cols), dh[:, :FILTERS])
            np.add.at(da, (rows, ib, cols), dh[:, FILTERS : 2 * FILTERS])
            da += np.where(core[:, :, None], (dh[:, 2 * FILTERS : 3 * FILTERS] / np.maximum(core.sum(1), 1)[:, None])[:, None], 0)
            da *= act > 0
            flat = da.reshape(n * steps, FILTERS)
            dwin = (flat @ net.conv.T).reshape(n, steps, KERNEL, EMBED + 1)
            demb = np.zeros((n, WIDTH, EMBED))
            for k in range(KERNEL):
                demb[:, k : k + steps] += dwin[:, :, k, :EMBED]
            dtable = np.zeros_like(net.embed)
            np.add.at(dtable, xs, demb)
            dtable[0] = 0
            grads = [dtable, window.T @ flat, flat.sum(0), hidden.T @ dz, np.array([dz.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            net.out_bias = float(params[4][0])
    calibrate(net, x[held], size[held], y[held], recall, None if found is None else found[held])
    return net


def calibrate(net: Network, x: np.ndarray, size: np.ndarray, y: np.ndarray, recall: float = RECALL, found: np.ndarray | None = None) -> None:
    """Platt's sigmoid by Newton's method, with his soft targets; then the highest threshold of that recall.

    ``found``: which findings are candidates; the others are missed at any threshold.
    """
    raw = net.raw(x, size)
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    design, w = np.c_[raw, np.ones(len(raw))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w = w - np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (p - target))
    net.scale, net.shift = float(w[0]), float(w[1])
    right = net.probability(x, size)
    right = np.sort((right if found is None else np.where(found, right, 0))[y > 0])
    net.threshold = float(right[int(len(right) * (1 - recall))]) if len(right) else 0.5


def _word(r: random.Random) -> str:
    return "".join(r.choice(("the", "an", "re", "on", "st", "er", "la", "de", "ion", "ein", "sch", "que", "mo", "ta")) for _ in range(r.randint(1, 4)))


def labelled_findings(count: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Made-up findings: (before, candidate, after, label), half of them secrets."""
    r = random.Random(seed)
    chars = string.ascii_letters + string.digits

    def text(n: int, of: str) -> str:
        return "".join(r.choice(of) for _ in range(n))

    def prose() -> str:
        return " ".join(_word(r) for _ in range(5))

    def hexa(n: int) -> str:
        return text(n, r.choice(("0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF")))

    names = ("token", "secret", "api_key", "apikey", "API_KEY", "password", "passwd", "access_key", "auth", "client_secret", "private_key", "Authorization: Bearer", "TOKEN", "key", "SECRET_KEY")
    plain = ("commit", "sha256", "md5", "checksum", "etag", "id", "uuid", "version", "file", "path", "isbn", "digest", "rev", "image", "build", "ref", "see")
    rows = []
    for k in range(count):
        secret = k % 2 == 0
        if secret:
            kind = r.randrange(8)
            body = [lambda: hexa(r.choice((32, 40, 40, 48, 64))), lambda: base64.b64encode(r.randbytes(r.randint(18, 48))).decode(), lambda: r.choice(("sk_live_", "pk_", "ghp_", "AKIA", "xoxb-", "key-", "AIza")) + text(r.randint(16, 36), chars), lambda: "eyJ" + text(30, chars) + "." + text(30, chars) + "." + text(20, chars), lambda: text(r.randint(16, 40), chars), lambda: text(r.randint(16, 32), chars + "_-~"), *[lambda: r.choice((text(r.randint(8, 15), chars), text(r.randint(8, 20), chars + "!@#$%^&*"), r.choice(plain).title() + text(r.randint(2, 5), string.digits + "!@#$") + text(r.randint(2, 6), chars)))] * 2][kind]()
            named = kind not in (2, 3) or r.random() < 0.6
            lead = r.choice(names) + r.choice((" = ", "=", ": ", ' = "', '="', "='", ' : "', *[" "] * (len(body) > 24))) if named else r.choice((" ", '"', "'", "= "))
        else:
            body = [
                lambda: hexa(r.choice((32, 40, 64))),
                lambda: "-".join(hexa(n).lower() for n in (8, 4, 4, 4, 12)),
                lambda: "/".join(_word(r) for _ in range(4)) + str(r.randint(0, 99)) + r.choice((".py", ".html", ".jpg", "")),
                lambda: text(r.randint(16, 20), string.digits),
                lambda: text(16, string.digits),
                lambda: f"{_word(r)}{r.randint(0, 99)}.{_word(r)}." + r.choice(("com", "net", "org")),
                lambda: "_".join(_word(r) for _ in range(3)) + "_" + str(r.randint(1, 2024)),
                lambda: f"{_word(r)}-{_word(r)}-{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}" + r.choice((".tar.gz", "-linux", "-release")),
                lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-00",
                lambda: _word(r) + _word(r) + _word(r) + _word(r) + str(r.randint(0, 9)),
                lambda: f"{_word(r)}.{r.randint(1, 99)}" + "." + _word(r) + ".example.com",
                lambda: "=" * r.randint(10, 20) + str(r.randint(1, 9)) + "-" * 10,
                *[lambda: r.choice(("required", "optional", "None", "true", "false", "null", "changed", "string", "expired", "enabled", "os.environ", "getpass()", "${TOKEN}", "<secret>", "********", "config.token", "see below", _word(r), _word(r) + _word(r), " ".join(_word(r) for _ in range(3))))] * 4,
                lambda: _word(r).title() + _word(r).title() + _word(r).title() + _word(r).title() + _word(r).title(),
            ][which := r.randrange(17)]()
            lead = r.choice(names) + r.choice((" = ", "=", ": ", ' = "', '="')) if 12 <= which < 16 else r.choice(plain) + r.choice((" ", ": ", "=", ' "', "/")) if r.random() < 0.6 or len(body) in (32, 40, 64) else r.choice((" ", " ", "@", "\n"))
        close = '"' if '"' in lead else "'" if "'" in lead else ""
        head, tail = prose() + r.choice((" ", "\n", ". ")) + lead, close + r.choice((" ", "\n", ", ", "!! ", ". ")) + prose()
        if r.random() < 0.15:
            head, body, tail = head.upper(), body.upper(), tail.upper()
        rows.append((head, body, tail, int(secret)))
    return rows


def views_of(rows: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Network input of labelled findings, of a long one its first window: symbols, sizes, labels."""
    data, offsets = textbuf.column(pa.array([a + b + c for a, b, c, _ in rows], pa.string()))
    s = offsets[:-1] + np.array([len(a.encode()) for a, _, _, _ in rows], np.int64)
    size = np.minimum([len(b.encode()) for _, b, _, _ in rows], WIDEST)
    return view(data, s, s + size, offsets[:-1], offsets[1:]), size, np.array([y for *_, y in rows], float)


def candidate_of(rows: list[tuple[str, str, str, int]]) -> np.ndarray:
    """Whether a candidate of the finding's text overlaps the finding."""
    data, offsets = textbuf.column(pa.array([a + b + c for a, b, c, _ in rows], pa.string()))
    start = offsets[:-1] + np.array([len(a.encode()) for a, _, _, _ in rows], np.int64)
    end = start + np.array([len(b.encode()) for _, b, _, _ in rows], np.int64)
    s, e = find(data, offsets)
    row = np.searchsorted(offsets, s, side="right") - 1
    out = np.zeros(len(rows), bool)
    out[row[(s < end[row]) & (e > start[row])]] = True
    return out


def train(findings: DataFrame | None = None, most: int = FINDINGS, recall: float = RECALL) -> Network:
    """A network trained on ``most`` labelled findings (before, candidate, after, label), those of least hash."""
    if findings is None:
        rows = labelled_findings(most)
    else:
        named = findings.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "candidate", "after")], F.col("label").cast("int").alias("label")).where("label IS NOT NULL")
        rows = [tuple(r) for r in named.orderBy(F.xxhash64("before", "candidate", "after"), "before", "candidate", "after", "label").limit(most).collect()]
    return train_network(*views_of(rows), recall=recall, found=candidate_of(rows))


def scan_texts(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All candidates of many texts: row, start and end in bytes of the buffer, probability."""
    s, e = find(data, offsets)
    row = np.searchsorted(offsets, s, side="right") - 1
    of, ws, we = windows(s, e)
    p = np.zeros(len(s))
    for k in range(0, len(of), 4096):
        part = slice(k, k + 4096)
        own = row[of[part]]
        np.maximum.at(p, of[part], net.probability(view(data, ws[part], we[part], offsets[own], offsets[own + 1]), (we - ws)[part]))
    return row, s, e, p


def scan(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text", everything: bool = False) -> DataFrame:
    """Findings: id, start and length in characters, score, secret, sha256 of the candidate."""
    net = net or train()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbuf.column(batch.column(1))
            for i, j in textbuf.chunks(offsets):
                part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, s, e, p = scan_texts(net, part, local)
                secret = p >= net.threshold
                if not everything:
                    row, s, e, p, secret = row[secret], s[secret], e[secret], p[secret], secret[secret]
                if not len(row):
                    continue
                chars = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]
                digest = [hashlib.sha256(part[a:b].tobytes()).hexdigest() for a, b in zip(s, e, strict=True)]
                columns = [batch.column(0).take(pa.array(row + i)), pa.array((chars[s] - chars[local[row]]).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(p), pa.array(secret), pa.array(digest)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "score", "secret", "sha256"])

    return base.mapInArrow(run, f"id {kind}, start int, length int, score double, secret boolean, sha256 string").withColumnRenamed("id", id_col)
