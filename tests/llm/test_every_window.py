"""The network's result is that of reading every window of a text."""

import numpy as np
import pytest

from stratalog.llm import pii


def every_window(model, text, least):
    base, found = pii.base_spans(text), []
    for start in range(0, max(1, len(text) - pii.WINDOW + pii.STRIDE), pii.STRIDE):
        codes = np.full((1, pii.WINDOW), 129, np.uint8)
        own = pii._codes(text[start : start + pii.WINDOW])
        codes[0, : len(own)] = own
        tags, sure = pii.decode(model, codes)
        found += pii._runs(tags[0], sure[0], start, len(text))
    return sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e, _ in pii.reconcile(found, base, text, least)])


def texts(n):
    r = np.random.default_rng(5)
    for _ in range(n):
        words = ["".join(r.choice(list("abcdefghij .,-()"), int(r.integers(1, 9)))) for _ in range(int(r.integers(1, 260)))]
        for _ in range(int(r.integers(0, 5))):
            words[int(r.integers(len(words)))] = str(r.choice(["7", "@", "(at)", "[at]", "12 34", "a.b@c.de"]))
        yield " ".join(words)


@pytest.mark.parametrize("calm", [0.0, 0.3, 0.6])
def test_result_is_that_of_every_window(monkeypatch, calm):
    """Untrained networks tag anything anywhere, the calmer the less; spans need a sign and nothing else here."""
    monkeypatch.setattr(pii, "fits", lambda *_: True)
    added = 0
    for seed in range(3):
        model = pii.Model(seed)
        model.p["ob"][0] = calm
        some = list(texts(12))
        got = pii.find_spans(model, some, 0.0)
        for text, spans in zip(some, got):
            want = every_window(model, text, 0.0)
            assert [(s, k, e, b) for s, k, e, _, b in spans] == want
            added += sum(not b for *_, b in want)
    assert added > 15


def test_touching_windows():
    for n in (1, 96, 97, 144, 145, 400):
        starts = range(0, max(1, n - pii.WINDOW + pii.STRIDE), pii.STRIDE)
        for s in range(0, n, 7):
            for e in range(s + 1, n + 1, 11):
                assert list(pii.touching_windows(s, e, n)) == [a for a in starts if a <= e and a + pii.WINDOW >= s], (n, s, e)


def test_an_address_with_neither_digit_nor_at_sign(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(docs)
    names = [f"{a}.{b} (at) {c}.{d}" for a, b, c, d in (("jane", "miller", "example", "com"), ("tom", "baker", "mail", "org"), ("anna", "fischer", "post", "net"), ("peter", "wood", "server", "com"))]
    around = ("For questions about this page please write to {} and we will answer soon.", "Contact: {}\nThe editors", "the author, {}, keeps the list and the archive of it")
    whole = [a.format(x) for x in names for a in around]
    got = pii.find_spans(model, whole)
    assert any(got) and all(k == 0 and "(at)" in t[s:e] for t, x in zip(whole, got) for s, k, e, *_ in x)
    clean = ["They met (at) noon and nobody knew why. " * 5, "no sign at all " * 40]
    assert pii.find_spans(model, clean) == [[], []]


def test_a_cut_span_is_followed_through_windows_without_a_sign(monkeypatch):
    """A network that takes 5 and y for a card: the span goes on for three windows behind its last digit."""

    def decode(model, x):
        inside = (x == ord("5")) | (x == ord("y"))
        first = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
        return np.where(first, 5, np.where(inside, 6, 0)), np.where(inside, 0.99, 1.0)

    monkeypatch.setattr(pii, "decode", decode)
    monkeypatch.setattr(pii, "fits", lambda *_: True)
    text = "x " * 30 + "5" * 10 + "y" * 200 + " x" * 100
    got = [(s, k, e, b) for s, k, e, _, b in pii.find_spans(pii.Model(), [text], 0.0)[0]]
    assert got == every_window(None, text, 0.0) == [(60, 2, 270, False)]


def test_a_closed_span_tells_against_a_cut_one_wherever_it_starts(monkeypatch):
    """Of several closed spans that start before a cut one, any that overlaps it counts."""
    monkeypatch.setattr(pii, "fits", lambda *_: True)
    found = [(30, 50, 2, 0.95, False, False), (31, 33, 2, 0.99, False, False), (48, 96, 2, 0.99, True, True)]
    assert pii.reconcile(found, [], "1" * 200) == [(30, 2, 50, 0.95)]
