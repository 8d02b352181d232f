"""What must hold whatever the number of languages or the size of a benchmark."""

import pickle

import numpy as np
import pytest

from stratalog.llm import decontaminate, language_id

from test_llm import _windows


def test_every_language_is_learned(spark):
    """130 languages of words of their own: more than DIM, more than the sample has texts for at six each, and a multiple of five."""
    rng = np.random.default_rng(3)
    words = {f"l{i:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 8))) for _ in range(12)] for i in range(130)}
    rows = [(i, lang, " ".join(rng.choice(own, 40))) for i, (lang, own) in enumerate([*words.items()] * 12)]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string").repartition(3)
    model = language_id.fit(docs, docs.doc_id < 9 * 130)
    assert model.langs == sorted(words) and model.table.shape[1] == language_id.DIM and model.out.shape[1] == 130
    got = {r.doc_id: r for r in language_id.identify(docs, model, keep=["doc_id"]).collect()}
    truth = {i: lang for i, lang, _ in rows}
    held = [i for i in truth if i >= 9 * 130]
    assert sum(got[i].lang_pred == truth[i] for i in held) > 0.95 * len(held)
    text = rows[held[0]][2].encode()
    ids = np.concatenate([b for b, _ in language_id.subwords(np.frombuffer(text, np.uint8), np.array([0, len(text)]))])
    z = (model.table[ids].astype(np.float64).mean(0) @ model.out + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert (got[held[0]].lang_pred, got[held[0]].score) == (model.langs[p.argmax()], pytest.approx(p.max(), rel=1e-5))


@pytest.mark.parametrize("many", [1, 8, 10**9])
def test_block_by_brute_force(spark, monkeypatch, many):
    """However places of a fingerprint are checked, and whatever items lack words."""
    monkeypatch.setattr(decontaminate, "MANY_PLACES", many)
    rng = np.random.default_rng(many % 97)
    make = lambda n: " ".join(rng.choice(list("ab"), n))
    bench = [(0, ""), (1, None)] + [(i, make(int(rng.integers(0, 25)))) for i in range(2, 30)] + [(60, " "), (61, "a b " * 9)]
    rows = [(i, make(int(rng.integers(0, 50)))) for i in range(40)] + [(90, None), (91, "a b " * 30)]
    docs, items = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(bench, "item_id int, text string").coalesce(1)
    for bound in (1 << 20, 0):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", bound)
        got = decontaminate.decontaminate(docs, items).collect()
        assert len(got) == len(rows) and all((r.n_words, r.n_hit, r["items"]) == _windows(r.text or "", [(i, t or "") for i, t in bench]) for r in got)


def test_block_is_as_large_as_its_bound_says():
    """A common instruction in every item: what a worker holds stays within the estimate that decides for the join."""
    shared = "answer the question below in one word and nothing else please now"
    items = [(f"i{i}", f"{shared} {i} of the list of {i * 7} and {i % 13} short words") for i in range(20000)] + [(f"s{i}", f"word{i}") for i in range(1000)]
    block = decontaminate.Block(items)
    n_words = len(block.starts)
    bound = sum(len(item) + decontaminate.ITEM_BYTES + len(text) for item, text in items) + decontaminate.WORD_BYTES * n_words
    assert block.n_bytes() <= bound and len(pickle.dumps(block)) <= bound
    text = f"see {shared} 77 of the list".encode()
    found = block.spans(*decontaminate.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[:4])
    assert len(found[1]) == 20000 and (1, 17) in found[0]
