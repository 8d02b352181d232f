"""Hard negatives, phrases and personal data against plain versions."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import hard_negatives, phrases, pii, queries

SF = "/root/testdata/sf0.001"

# --- hard negatives -------------------------------------------------------------------------------------------------


def _mined(rows, low=30, high=90, positives=5, negatives=10):
    """Rows (vec_id, label, vector) by comparing each anchor with all others, in integers."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  the shorter one is filled up with zeros
    out = []
    for a, label, v in {(i, k, tuple(x)) for i, k, x in rows if i % 100 == 0}:
        scored = sorted(((-dot(v, w), j, k == label) for j, k, w in rows if j != a))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [(t, n) for t, n, same in sorted((-dot(v, w), j, k == label) for j, k, w in rows) if not same and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n) in enumerate(fits, 1)]
    return sorted(out)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label bigint, v array<bigint>")


@pytest.mark.parametrize("block, tile", [(16384, 4096), (2, 7)])
@pytest.mark.parametrize("scale", [30, 4 * 10**8])
def test_mining_by_brute_force(spark, monkeypatch, block, tile, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", tile)
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 3)
    r = np.random.default_rng(block + scale)
    rows = [(int(i), int(r.integers(0, 3)), r.integers(-2, 4, int(r.choice([4, 4, 4, 2]))).tolist()) for i in range(-100, 520, 4)]
    rows = [(i, k, [x * scale for x in v]) for i, k, v in rows] + [(100, 1, [scale] * 4), (200, 2, [0, 0, 0, 0]), (300, 0, [])]
    rows += rows[5:9] + [rows[0]]  # repeated rows, an anchor among them
    got = hard_negatives.mine(_vectors(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect())) == _mined(rows) and _mined(rows)


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int, score string"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], 1, "x"), (1, [0.5, 0.2], 1, "x"), (2, [0.3, 0.1], 2, "x"), (3, [nan, 1.0], 2, "x"), (4, [1.0, inf], 2, "x"), (5, [1.0, None], 2, "x"), (6, None, 2, "x"), (7, [0.3, 0.1], None, "x"), (None, [0.3, 0.1], 2, "x"), (8, [-0.001, 0.0], 2, "x")]
    taken = hard_negatives.quantize(spark.createDataFrame(rows, schema))
    assert sorted((x.vec_id, x.v) for x in taken.collect()) == [(0, [128, 64]), (1, [128, 51]), (2, [76, 25]), (8, [-1, 0])]
    assert [tuple(x) for x in hard_negatives.mine(taken).collect()] == [(0, 1, 1, 2, 128 * 128 + 64 * 51, 128 * 76 + 64 * 25)]
    for none in (spark.createDataFrame([], schema), spark.createDataFrame(rows[1:3], schema)):
        out = hard_negatives.mine(hard_negatives.quantize(none))
        assert out.collect() == [] and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# --- phrases --------------------------------------------------------------------------------------------------------


def _phrases(rows, most=3, least=10, top=2000, covered=50):
    """Rows (lang, text) by counting every n-gram of every piece."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", text or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (x, q), b in f.items() if x == lang and len(p) < len(q) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        score, _, l, r = min((math.floor(Fraction(10**6 * a * a, f[lang, p[:k]] * f[lang, p[k:]])), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("most, slices", [(3, 8 << 20), (2, 200), (5, 300)])
def test_phrases_by_brute_force(spark, monkeypatch, most, slices):
    monkeypatch.setattr(phrases, "SLICE_TEXT", slices)
    r = np.random.default_rng(most)
    words = ["a", "B", "b", "É", "é", "the", "THE", "x.y", "中文", "q\x00", "\x1f", "t u", "o'k", "-"]
    rows = []
    for i in range(150):
        text = "".join(str(r.choice(words, p=np.array([9, 4, 4, 2, 2, 9, 4, 1, 2, 1, 1, 1, 1, 1]) / 42)) + str(r.choice([" ", "\t ", "  ", ", ", "\n", "\x0b", "! "], p=[0.7, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])) for _ in range(int(r.integers(0, 40))))
        rows.append((str(r.choice(["en", "fr", "und"])) if i % 7 else None, text if i % 11 else None))
    rows += [("en", ""), ("xx", "one two three")] + [("de", "ja nein ja nein ja")] * 12
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("clash")).withColumn("word", F.lit(1)).repartition(3)
    got = phrases.mine_phrases(df, most_words=most, top=25)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == _phrases(rows, most, top=25)


def test_no_phrases(spark):
    for rows in ([], [("en", None), (None, "...")], [("en", "too few")]):
        assert phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000, [4_000_000_000, 3_000_000_000], [5_000_000_000, 3_000_000_000])], "f bigint, pre array<bigint>, suf array<bigint>").select(phrases._cuts(2).alias("c")).first()["c"]
    assert (row.score, row.l, row.r) == (10**6 * 9 * 10**18 // (4 * 5 * 10**18), 4_000_000_000, 5_000_000_000)


# --- personal data --------------------------------------------------------------------------------------------------

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain_spans(text):
    """The contract's patterns as they stand, and its conditions."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.findall("[0-9]", m.group())
            twice = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split(".")) or kind == 2 and 12 <= len(digits) <= 19 and sum(twice) % 10 == 0 or kind == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_by_the_patterns():
    r = np.random.default_rng(3)
    bits = ["a", "é中", "@", ".", "..", "-", "+", " ", "  ", "(", ")", "1", "22", "255", "256", "007", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-0100", "x@y.z", "a.b@c-d.e.f", "1.2.3.4", "\n", "%_", "00"]
    hits = Counter()
    for _ in range(20000):
        text = "".join(str(r.choice(bits)) for _ in range(int(r.integers(0, 12))))
        want = _plain_spans(text)
        hits.update(k for _, k, _ in want)
        assert pii.base_spans(text) == want, text
    assert min(hits[k] for k in range(4)) > 100


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "+1" + "(" * 300_000, "a@" * 100_000, "1 " * 150_000, "0" * 20 + ".0.0.0"):
        assert [k for _, k, _ in pii.base_spans(text)] in ([], [1], [1] * 37500)


def test_gradients():
    r = np.random.default_rng(0)
    model = pii.Model(1, units=3)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = r.integers(0, pii._SYMBOLS, (4, 7)).astype(np.uint8), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [2, 2, 0, 5, 6, 6, 0], [7, 8, 0, 0, 1, 0, 0]])
    _, grad = pii._loss(p, x, y)
    for name in p:
        for _ in range(4):
            at = tuple(int(r.integers(0, n)) for n in p[name].shape)
            if name == "t" and not pii._MAY[at]:
                continue
            if name in ("xf", "xb"):
                at = (int(x[r.integers(0, 4), r.integers(0, 7)]), at[1])
            keep, values = p[name][at], []
            for e in (1e-3, -1e-3):
                p[name][at] = keep + e
                values.append(pii._loss(p, x, y)[0])
            p[name][at] = keep
            assert abs((values[0] - values[1]) / 2e-3 - grad[name][at]) < 2e-3, name


def test_windows_hold_every_mark():
    r = np.random.default_rng(2)
    for n in [0, 1, 5, 95, 96, 97, 143, 144, 145, 1000]:
        for p in (0, 0.01, 0.5):
            codes = np.where(r.random(n) < p, 49, 97).astype(np.uint8)
            starts = pii.windows(codes)
            marks = np.flatnonzero(codes == 49)
            every = [s for s in range(0, max(1, n - pii.WINDOW + pii.STRIDE), pii.STRIDE) if (codes[s : s + pii.WINDOW] == 49).any()]
            assert starts.tolist() == every and all(any(s <= m < s + pii.WINDOW for s in starts) for m in marks)


def test_reconciliation():
    text = "x" * 40 + "1" * 200
    cut = [(40, 96, 2, 0.99, False, True), (48, 144, 2, 0.98, True, True), (96, 192, 2, 0.97, True, True), (144, 240, 2, 0.99, True, False)]
    fits = pii.fits
    try:
        pii.fits = lambda *_: True
        assert pii.reconcile(cut, [], text) == [(40, 2, 240, 0.97)]
        whole = [(50, 60, 0, 0.95, False, False), (50, 60, 0, 0.99, False, False), (55, 80, 3, 0.96, False, False), (79, 90, 1, 0.97, False, False), (100, 110, 1, 0.5, False, False)]
        assert pii.reconcile(whole, [], text) == [(55, 3, 80, 0.96)] or pii.reconcile(whole, [], text) == [(50, 0, 60, 0.99), (79, 1, 90, 0.97)]
        assert sum(c * (e - s) for s, _, e, c in pii.reconcile(whole, [], text)) == max(0.96 * 25, 0.99 * 10 + 0.97 * 11)
        assert pii.reconcile(whole, [(58, 0, 62)], text) == [(79, 1, 90, 0.97)]
        assert pii.reconcile([(0, 20, 0, 0.99, False, False)], [], text) == []  # neither a digit nor an @
    finally:
        pii.fits = fits


@pytest.fixture(scope="module")
def halves(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


@pytest.fixture(scope="module")
def model(halves):
    return pii.fit(halves[0])


def test_spans_written_otherwise_are_found_on_the_held_out_half(halves, model):
    r = np.random.default_rng(9)
    right = there = 0
    windows = pii.labelled_windows(halves[1])
    around = [w for w, s in windows if not s and not re.search("[0-9@]", w)]
    for window, spans in windows:
        inner = [s for s in spans if s[0] > 4 and s[2] < pii.WINDOW - 20]
        if not inner:
            continue
        text, moved = pii._rewritten(window, inner[:1], r)
        (start, kind, end), before = moved[0], around[there][:60] + " "
        whole = before + text + " " + around[-1 - there]
        if not pii.fits(kind, text[start:end]):
            continue
        got = {(s - len(before), k, e - len(before)) for s, k, e, *_ in pii.find_spans(model, [whole])[0]}
        there += 1
        right += (start, kind, end) in got
    assert there > 30 and right >= 0.5 * there, (there, right)


def test_clean_numbers_are_left_alone(halves, model):
    r = np.random.default_rng(4)
    texts = [" ".join(pii._plain_numbers(w, r) for _ in range(3)) for w, s in pii.labelled_windows(halves[1]) if not s][:300]
    spans = [pii.find_spans(model, [t])[0] for t in texts]
    added = sum(not b for x in spans for *_, b in x)
    assert len(texts) > 50 and added <= 0.02 * len(texts)


def test_op13_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op13_pii(spark, SF).collect()
    model, texts = pii.fit(docs), {x.doc_id: x.text for x in docs.collect()}
    added = 0
    for x in rows:
        text = texts[x.doc_id] or ""
        base = _plain_spans(text)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        digest = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert x.base_sha256 == hashlib.sha256(digest(base).encode()).hexdigest()
        found = []
        for start in range(0, max(1, len(text) - pii.WINDOW + pii.STRIDE), pii.STRIDE):  # each window by itself
            window = text[start : start + pii.WINDOW]
            if model and re.search("[0-9@]", window):
                codes = np.full((1, pii.WINDOW), 129, np.uint8)
                codes[0, : len(window)] = pii._codes(window)
                tags, sure = pii.decode(model, codes)
                found += pii._runs(tags[0], sure[0], start, len(text))
        more = [(s, k, e) for s, k, e, _ in pii.reconcile(found, base, text)] if found else []
        added += len(more)
        assert x.spans == digest(sorted(base + more))
    assert len(rows) == len(texts)


def test_odd_texts_and_tables(spark, model):
    rows = [(1, None), (2, ""), (3, "no number"), (4, "a@b.co"), (4, "a@b.co"), (None, "call +1 555 555 0100"), (5, "x" * 300_000 + " 10.0.0.1 " + "y" * 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("clash")).withColumn("n_email", F.lit(1))
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.base)) for r in pii.detect(df, model).collect()}
    assert got == {(1, ()), (2, ()), (3, ()), (4, (("email", 0, 6),)), (None, (("phone", 5, 20),)), (5, (("ip", 300001, 300009),))}
    assert pii.detect(df, None).count() == 7
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.fit(none) is None and pii.detect(none, None).collect() == []
