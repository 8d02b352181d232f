"""Personal data by patterns and by a character network.

Four patterns find what is written by the rules (the base). A character-level bidirectional LSTM with CRF transitions, in
numpy, learns from labelled spans and finds what is written otherwise. It reads overlapping windows of a text. Spans that a
window cuts are joined with those of its neighbours, and a choice over the whole text keeps the most convincing ones that
don't overlap each other or the base.

A span holds a digit, an @ or a spelled-out one, such as (at); ``fits`` and ``reconcile`` drop others. So the result is that
of reading every window, though ``find_spans`` computes only those that can have a part in it: windows with such a sign and
all windows that a cut span found in another one reaches, again and again. A span of the rest holds no sign, meets no cut
span, and so is neither kept nor joined, nor tells against another.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base. None backtracks over more than one candidate.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_AT = re.compile(r"@|[\[(]at[\])]")
#: What every span holds.
_SIGN = re.compile(rf"{_ANCHOR.pattern}|{_AT.pattern}")

#: Characters of a window, and from one window's start to the next one's.
WINDOW, STRIDE = 96, 48
#: Units of the network each way, and labelled windows a class that it learns from at most.
UNITS, SAMPLE = 24, 250
#: Steps of the training, however many windows there are.
STEPS = 600
#: Least probability at each character of a span that is kept.
LEAST = 0.9
_SYMBOLS = 130  # ASCII as it is, other characters, nothing
_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches by their @: a local part can't hold one, so each @ ends at most one."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not _LOCAL_END.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def fits(kind: int, span: str) -> bool:
    """What a span has to be besides its shape, however it is written: parts of an address at most 255, digits of a card with their check, as many digits as a phone number has."""
    if kind == 0:
        return bool(_AT.search(span))
    if kind == 1:
        parts = [p.lstrip("0") for p in re.findall("[0-9]+", span)]
        return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    digits = "".join(_DIGIT.findall(span))
    return 12 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def base_spans(text: str | None, checked: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of the spans that the patterns find, each kind on its own, leftmost first and without overlaps. Unless ``checked``, cards needn't pass their check."""
    text, out = text or "", []
    if not _ANCHOR.search(text):
        return out
    out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if fits(1, m.group()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and (fits(2, m.group()) or not checked and 12 <= len(_DIGIT.findall(m.group())) <= 19):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if fits(3, m.group()):
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, 128).astype(np.uint8)


def _marked(codes: np.ndarray) -> np.ndarray:
    return (codes >= 48) & (codes <= 57) | (codes == 64)


def windows(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows of a text that hold a digit or an @; the last window ends with the text."""
    return _holding(np.flatnonzero(_marked(codes)), len(codes))


def _last(n: int) -> int:
    """The number of the last window of a text of ``n`` characters."""
    return max(0, -(-(n - WINDOW) // STRIDE)) if n > WINDOW else 0


def _holding(at: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of a text of ``n`` characters that hold one of the positions ``at``."""
    if not len(at):
        return at
    last = _last(n)
    # A position lies in the window that starts at its stride and, if it reaches so far, in earlier ones.
    numbers = np.unique(np.concatenate([np.clip(at // STRIDE - k, 0, last) for k in range(WINDOW // STRIDE)] + [np.minimum(at // STRIDE, last)]))
    return numbers * STRIDE


def signed_windows(text: str, codes: np.ndarray) -> list[int]:
    """Starts of the windows of a text that hold a digit, an @ or a part of a spelled-out one."""
    spelled = [i for m in _AT.finditer(text) for i in range(m.start(), m.end())]
    return _holding(np.concatenate([np.flatnonzero(_marked(codes)), np.array(spelled, np.int64)]), len(codes)).tolist()


def touching_windows(start: int, end: int, n: int) -> range:
    """Starts of the windows of a text of ``n`` characters that overlap a span or end or start where it does."""
    first = max(0, -(-(start - WINDOW) // STRIDE))
    return range(first * STRIDE, min(end // STRIDE, _last(n)) * STRIDE + 1, STRIDE)


class Model:
    """Weights of the two LSTMs, the emissions and the transitions, as float32 arrays."""

    def __init__(self, seed: int = 0, units: int = UNITS):
        r = np.random.default_rng(seed)
        self.p = {}
        for way in "fb":
            self.p["x" + way] = r.normal(0, 0.3, (_SYMBOLS, 4 * units)).astype(np.float32)
            self.p["h" + way] = r.normal(0, 1 / np.sqrt(units), (units, 4 * units)).astype(np.float32)
            self.p["b" + way] = np.repeat(np.array([0, 1, 0, 0], np.float32), units)
        self.p["o"] = r.normal(0, 0.3, (2 * units, _TAGS)).astype(np.float32)
        self.p["ob"] = np.zeros(_TAGS, np.float32)
        self.p["t"] = np.zeros((_TAGS, _TAGS), np.float32)
        self.p["s"] = np.zeros(_TAGS, np.float32)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and first tags that may be; inside follows only begin or inside of its kind. A window may open within a span."""
    t = np.ones((_TAGS, _TAGS), bool)
    for k in range(len(KINDS)):
        t[:, 2 + 2 * k] = False
        t[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return t, np.ones(_TAGS, bool)


_MAY, _MAY_START = _allowed()
_NEVER = np.float32(-1e4)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run_lstm(p: dict, way: str, x: np.ndarray, keep: bool):
    """Hidden states (steps, windows, units) of codes (windows, steps); with ``keep`` also what the gradient needs."""
    n, steps = x.shape
    units = p["h" + way].shape[0]
    h, c = np.zeros((n, units), np.float32), np.zeros((n, units), np.float32)
    out, cache = np.zeros((steps, n, units), np.float32), []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = p["x" + way][x[:, t]] + h @ p["h" + way] + p["b" + way]
        gates = _sigmoid(z[:, : 3 * units])
        i, f, o, g = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :], np.tanh(z[:, 3 * units :])
        before, c = (h, c), f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            cache.append((t, before, i, f, o, g, tc))
    return out, cache


def _back_lstm(p: dict, way: str, x: np.ndarray, d_out: np.ndarray, cache, grad: dict) -> None:
    units = p["h" + way].shape[0]
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    every = np.zeros((*d_out.shape[:2], 4 * units), np.float32)
    for t, (h0, c0), i, f, o, g, tc in reversed(cache):
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        grad["h" + way] += h0.T @ dz
        grad["b" + way] += dz.sum(0)
        every[t] = dz
        dh, dc = dz @ p["h" + way].T, dc * f
    codes, rows = x.T.ravel(), every.reshape(-1, 4 * units)
    order = np.argsort(codes, kind="stable")
    held, first = np.unique(codes[order], return_index=True)
    grad["x" + way][held] += np.add.reduceat(rows[order], first)


def _emissions(p: dict, x: np.ndarray, keep: bool = False):
    forward, fc = _run_lstm(p, "f", x, keep)
    backward, bc = _run_lstm(p, "b", x, keep)
    h = np.concatenate([forward, backward], 2)
    return h @ p["o"] + p["ob"], h, fc, bc


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _marginals(p: dict, e: np.ndarray):
    """Forward and backward scores of the CRF, log partition values, and the transitions in use."""
    steps, n, _ = e.shape
    t = np.where(_MAY, p["t"], _NEVER)
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[0] = e[0] + np.where(_MAY_START, p["s"], _NEVER)
    for k in range(1, steps):
        a[k] = e[k] + _lse(a[k - 1][:, :, None] + t, 1)
    for k in range(steps - 2, -1, -1):
        b[k] = _lse(t + (e[k + 1] + b[k + 1])[:, None, :], 2)
    return a, b, _lse(a[-1], 1), t


def _loss(p: dict, x: np.ndarray, y: np.ndarray):
    """Negative log-likelihood a window and its gradient."""
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    e, h, fc, bc = _emissions(p, x, True)
    steps, n, _ = e.shape
    a, b, z, t = _marginals(p, e)
    every, rows = y.T, np.arange(n)
    gold = p["s"][every[0]] + e[np.arange(steps)[:, None], rows[None, :], every].sum(0) + t[every[:-1], every[1:]].sum(0)
    de = np.exp(a + b - z[None, :, None])
    first = de[0].copy()
    for k in range(steps - 1):
        pair = np.exp(a[k][:, :, None] + t + (e[k + 1] + b[k + 1])[:, None, :] - z[:, None, None])
        grad["t"] += pair.sum(0)
    np.subtract.at(grad["t"], (every[:-1].ravel(), every[1:].ravel()), 1)
    grad["t"][~_MAY] = 0
    de[np.arange(steps)[:, None], rows[None, :], every] -= 1
    np.subtract.at(first, (rows, every[0]), 1)
    grad["s"] = first.sum(0)
    grad["o"] = np.einsum("tnu,tng->ug", h, de)
    grad["ob"] = de.sum((0, 1))
    dh = de @ p["o"].T
    units = p["hf"].shape[0]
    _back_lstm(p, "f", x, dh[:, :, :units], fc, grad)
    _back_lstm(p, "b", x, dh[:, :, units:], bc, grad)
    return float((z - gold).mean()), {k: (g / n).astype(np.float32) for k, g in grad.items()}


def train(texts: list[str], spans: list[list[tuple[int, int, int]]], steps: int = STEPS, size: int = 64, rate: float = 0.01, seed: int = 0) -> Model:
    """A model from windows of text with labelled spans (start, kind, end), by ``steps`` steps of Adam; the order of the examples doesn't matter."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], spans[i]))
    model = Model(seed)
    if not order:
        return model
    x, y = np.full((len(order), WINDOW), 129, np.uint8), np.zeros((len(order), WINDOW), np.int64)
    for row, i in enumerate(order):
        codes = _codes(texts[i][:WINDOW])
        x[row, : len(codes)] = codes
        for s, kind, e in spans[i]:
            y[row, max(0, s) : e] = 2 + 2 * kind
            if s >= 0:
                y[row, s] = 1 + 2 * kind
    r = np.random.default_rng(seed)
    mean, var = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step, parts = 0, []
    while step < steps:
        parts = parts or np.array_split(r.permutation(len(order)), -(-len(order) // size))
        part, step = parts.pop(), step + 1
        _, grad = _loss(model.p, x[part], y[part])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            var[k] += 0.01 * (g * g - var[k])
            model.p[k] -= rate * (1 - 0.9 * step / steps) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    return model


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (windows, steps) by Viterbi, and the probability of each character's tag kind."""
    p = model.p
    e = _emissions(p, x)[0]
    e = e + np.where((np.arange(_TAGS) > 0) & (x.T == 129)[:, :, None], _NEVER, 0)
    steps, n, _ = e.shape
    a, b, z, t = _marginals(p, e)
    best, back = e[0] + np.where(_MAY_START, p["s"], _NEVER), np.zeros((steps, n, _TAGS), np.int8)
    for k in range(1, steps):
        paths = best[:, :, None] + t
        back[k] = paths.argmax(1)
        best = e[k] + paths.max(1)
    tags = np.zeros((steps, n), np.int64)
    tags[-1] = best.argmax(1)
    for k in range(steps - 1, 0, -1):
        tags[k - 1] = back[k][np.arange(n), tags[k]]
    chance = np.exp(a + b - z[None, :, None])
    kinds = np.concatenate([chance[:, :, :1], chance[:, :, 1::2] + chance[:, :, 2::2]], 2)
    return tags.T, kinds[np.arange(steps)[:, None], np.arange(n)[None, :], (tags + 1) // 2].T


def _runs(tags: np.ndarray, sure: np.ndarray, start: int, length: int):
    """Spans of one window: (start, end, kind, confidence, open to the left, open to the right)."""
    out, at = [], 0
    n = min(WINDOW, length - start)
    while at < n:
        if not tags[at]:
            at += 1
            continue
        kind, end = (tags[at] - 1) // 2, at + 1
        while end < n and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((start + at, start + end, int(kind), float(sure[at:end].min()), at == 0 and start > 0, end == n and start + n < length))
        at = end
    return out


def reconcile(found: list[tuple], base: list[tuple[int, int, int]], text: str, least: float = LEAST) -> list[tuple[int, int, int, float]]:
    """Spans (start, kind, end, confidence) of the windows of one text, joined where a window cut them, and of those that overlap the most convincing choice. A span that doesn't fit its kind is none."""
    whole, opened = {}, []
    for s, e, kind, sure, left, right in sorted(found):
        if left or right:
            opened.append((s, e, kind, sure))
        elif sure > whole.get((s, e, kind), 0):
            whole[s, e, kind] = sure
    # A cut span counts only joined with a neighbour's: closed ones that it overlaps tell more, two cut ones make one.
    joined = []
    for s, e, kind, sure in opened:
        if joined and joined[-1][2] == kind and s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]), kind, min(sure, joined[-1][3]))
        else:
            joined.append((s, e, kind, sure))
    closed: list[tuple] = [([], []) for _ in KINDS]  # of each kind the starts, and the furthest end so far
    for a, b, kind in sorted(whole):
        starts, far = closed[kind]
        starts.append(a)
        far.append(max(b, far[-1]) if far else b)
    for s, e, kind, sure in joined:
        starts, far = closed[kind]
        before = bisect.bisect_left(starts, e)
        if not (before and far[before - 1] > s):
            whole.setdefault((s, e, kind), sure)
    firm = sorted((s, e) for s, _, e in base)
    fixed, reach = [s for s, _ in firm], list(np.maximum.accumulate([e for _, e in firm])) if firm else []
    options = []
    for (s, e, kind), sure in whole.items():
        before = bisect.bisect_left(fixed, e)
        if sure >= least and not (before and reach[before - 1] > s) and _SIGN.search(text, s, e) and fits(kind, text[s:e]):
            options.append((e, s, kind, sure))
    options.sort()
    ends, value, take = [o[0] for o in options], [0.0], []
    for i, (e, s, kind, sure) in enumerate(options):
        before = bisect.bisect_right(ends, s, 0, i)
        gain = value[before] + sure * (e - s)
        take.append(before if gain > value[-1] else None)
        value.append(max(gain, value[-1]))
    out, i = [], len(options)
    while i:
        if take[i - 1] is None:
            i -= 1
        else:
            e, s, kind, sure = options[i - 1]
            out.append((s, kind, e, sure))
            i = take[i - 1]
    return out[::-1]


def find_spans(model: Model | None, texts: list[str | None], least: float = LEAST) -> list[list[tuple[int, int, int, float, bool]]]:
    """(start, kind, end, confidence, of the base) of each text in order, as if every window was read (see above). Windows of all the texts go through the network together, equal ones once."""
    base = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    held: dict[bytes, list] = {}
    codes: dict[int, np.ndarray] = {}
    read: dict[int, set] = {}
    more: list[tuple] = []

    def flush():
        rows = list(held)
        x = np.full((len(rows), WINDOW), 129, np.uint8)
        for i, row in enumerate(rows):
            x[i, : len(row)] = np.frombuffer(row, np.uint8)
        tags, sure = decode(model, x)
        for i in np.flatnonzero(tags.any(1)):
            for doc, start in held[rows[i]]:
                runs = _runs(tags[i], sure[i], start, len(codes[doc]))
                found[doc] += runs
                more.extend((doc, s, e) for s, e, _, _, left, right in runs if left or right)
        held.clear()

    def ask(doc, start):
        if start not in read[doc]:
            read[doc].add(start)
            held.setdefault(codes[doc][start : start + WINDOW].tobytes(), []).append((doc, start))
            if len(held) >= 512:
                flush()

    for doc, text in enumerate(texts if model else ()):
        if text and _SIGN.search(text):
            codes[doc], read[doc] = _codes(text), set()
            for start in signed_windows(text, codes[doc]):
                ask(doc, start)
    while held or more:
        if held:
            flush()
        cut, more[:] = list(more), []
        for doc, s, e in cut:
            for start in touching_windows(s, e, len(codes[doc])):
                ask(doc, start)
    return [sorted([(s, k, e, 1.0, True) for s, k, e in b] + [(s, k, e, c, False) for s, k, e, c in (reconcile(f, b, t or "", least) if f else [])]) for b, f, t in zip(base, found, texts)]


_SPANS = "array<struct<start: bigint, kind: string, end: bigint, confidence: double, base: boolean>>"


def detect(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, spans) of each row: personal data in order of start and kind, ends exclusive, in code points.

    Base spans have confidence 1; without a model they are all there is. A null or empty text has none; repeated rows come
    back as often as they come in; texts are read whole, whatever their length; other columns are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("confidence", pa.float64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            spans = find_spans(held.value, batch.column(1).to_pylist(), least)
            rows = [[{"start": s, "kind": KINDS[k], "end": e, "confidence": c, "base": b} for s, k, e, c, b in one] for one in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, spans {_SPANS}")


def _rewritten(text: str, spans: list[tuple[int, int, int]], r: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The same window with its spans written otherwise: spelled-out signs, other separators."""
    out, at, moved = "", 0, []
    for s, kind, e in spans:
        span = text[max(0, s) : e]
        way = int(r.integers(3))
        if kind == 0:
            span = span.replace("@", (" (at) ", " [at] ", " @ ")[way]).replace(".", (".", " [dot] ", ".")[way])
        elif kind == 1:
            span = span.replace(".", ("[.]", " . ", "(.)")[way])
        elif kind == 2:
            span = (".", "/", "  ")[way].join(re.findall(".{1,4}", re.sub(r"[ -]", "", span)))
        else:
            span = (span.replace("+", "00", 1), span.replace("+", "", 1), re.sub(r"[ ()-]+", "/", span))[way]
        out += text[at : max(0, s)]
        moved.append((len(out) if s >= 0 else -1, kind, len(out) + len(span)))
        out, at = out + span, e
    out = (out + text[at:])[:WINDOW]
    return out, [(s, k, min(e, WINDOW)) for s, k, e in moved if s < WINDOW]


def _plain_numbers(text: str, r: np.random.Generator) -> str:
    """A window without spans in which some words are numbers that are no personal data: years, amounts, versions, times, dates, hashes."""
    n = lambda a, b: str(int(r.integers(a, b)))
    forms = [lambda: n(1800, 2100), lambda: n(0, 100000), lambda: f"{n(0, 1000)}.{n(0, 100)}", lambda: f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", lambda: f"{n(0, 24)}:{n(10, 60)}", lambda: f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}", lambda: bytes(r.integers(0, 256, 20).tolist()).hex(), lambda: f"${n(1, 10**6)}", lambda: n(1, 99) + "%", lambda: "@" + "".join(chr(97 + int(c)) for c in r.integers(0, 26, 6)), lambda: n(10**5, 10**9)]
    return re.sub(r"\S+", lambda m: forms[int(r.integers(len(forms)))]() if r.random() < 0.2 else m.group(), text)[:WINDOW]


def labelled_windows(docs: DataFrame, most: int = SAMPLE, text_col: str = "text") -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``most`` distinct windows of each kind of base span, of none among digits, and of none at all, chosen by hash from all rows."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text, checked=False)  # the network learns shapes; ``fits`` checks what it finds
                starts = windows(_codes(text)).tolist() if _ANCHOR.search(text) else []
                if len(text) > 2 * WINDOW:
                    starts.append(len(text) // 2)  # what surrounds no number
                edges, reach = [s for s, _, _ in base], list(np.maximum.accumulate([e for _, _, e in base])) if base else []
                for s in set(starts):
                    first, last = bisect.bisect_right(reach, s), bisect.bisect_left(edges, s + WINDOW)
                    held, taken = [], s
                    for a, k, e in base[first:last]:
                        if a >= taken or (a < s and not held):  # of overlapping ones the first
                            held.append(f"{a - s}:{k}:{min(e - s, WINDOW)}")
                            taken = e
                    window = text[s : s + WINDOW]
                    kind = int(held[0].split(":")[1]) if held else 4 if _ANCHOR.search(window) else 5
                    rows.append((kind, window, ",".join(held)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.string()))], ["kind", "window", "spans"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind int, window string, spans string").distinct()
    order = W.partitionBy("kind").orderBy(F.xxhash64("window"), "window", "spans")
    rows = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("window", "spans").collect()
    return sorted((r.window, [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]) for r in rows)


def fit(docs: DataFrame, most: int = SAMPLE, steps: int = STEPS, seed: int = 0) -> Model | None:
    """A model that learns from spans of the base's shapes, as they stand and written otherwise, and from numbers that are none.

    At most six times ``most`` windows come to the driver (``labelled_windows``). None if the table holds no text to learn from.
    """
    rows = labelled_windows(docs, most)
    if not any(spans for _, spans in rows):
        return None
    r = np.random.default_rng(seed)
    texts, spans = [], []
    for window, held in rows:
        texts.append(window)
        spans.append(held)
        if held:
            for _ in range(2):
                w, h = _rewritten(window, held, r)
                texts.append(w)
                spans.append(h)
        else:
            texts.append(_plain_numbers(window, r))
            spans.append([])
    return train(texts, spans, steps, seed=seed)


def digest(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    """Base spans of one kind."""
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
