"""The fuzzy join and the table of candidates against plain versions."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions.text import normalize_tokens
from stratalog.operators import quotes, vault
from stratalog.plans import queries as plans

SF = "/root/testdata/sf0.001"


def _plain(needle, hay, threshold, strict):
    """All windows, matched one by one."""
    if len(needle) < 4:
        return False
    n = len(needle)
    width = n if strict else n + 15
    return any(difflib.SequenceMatcher(None, needle, hay[at : at + width]).ratio() >= threshold for at in range(0, max(1, len(hay) - n + 1), max(1, n // 5)))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("threshold", [0.78, 0.7, 0.95])
def test_no_window_is_lost(strict, threshold):
    r = random.Random(int(threshold * 100) + strict)
    hits = 0
    for _ in range(500):
        letters = r.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        hay = "".join(r.choice(letters) for _ in range(r.choice([0, 3, 10, 60, 300])))
        n, at = r.choice([4, 5, 9, 25, 60]), r.randint(0, max(0, len(hay) - 5))
        needle = list(hay[at : at + n]) or ["a"]
        for _ in range(r.randint(0, len(needle) // 3)):
            kind, i = r.random(), r.randrange(len(needle))
            if kind < 0.4:
                needle[i] = r.choice(letters)
            elif kind < 0.7:
                needle.insert(i, r.choice(letters))
            elif len(needle) > 1:
                del needle[i]
        needle = "".join(needle)
        want = _plain(needle, hay, threshold, strict)
        hits += want
        assert quotes._fuzzy(needle, hay, threshold, strict) == want, (needle, hay)
    assert hits > 30


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("threshold", [0.78, 0.6, 0.95])
def test_no_stretch_is_lost(strict, threshold, monkeypatch):
    """Needles of one and of more words, in texts that are shorter, cut windows, or fill several stretches; small tiles and runs."""
    monkeypatch.setattr(quotes, "TILE_PAIRS", 50)
    monkeypatch.setattr(quotes, "TAKEN_CHARACTERS", 700)
    r = random.Random(int(threshold * 100) + strict)
    make = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    hays = [make(r.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz你好"]), r.choice([1, 3, 20, 70, 90, 130, 400, 900])) for _ in range(30)]
    texts = []
    for n in (4, 5, 27, 60, 64, 65, 83, 100, 127, 128, 129, 190, 300) * 3:
        hay = r.choice(hays)
        at = r.choice([0, max(0, len(hay) - n), r.randint(0, max(0, len(hay) - n))])
        texts.append("".join(r.choice(["", "Q", c + "Q"]) if r.random() < r.choice([0, 0.1, 0.2]) else c for c in hay[at : at + n]) + make("abcde", 4))
    needles = [quotes._Needle(x) for x in texts]
    groups, table = quotes._groups(needles, threshold, strict)
    assert {g.words for g in groups} >= ({1, 2} if threshold < 0.9 else {1}) and sorted(q for g in groups for q in g.numbers) == list(range(len(needles)))
    want = {(i, q) for i, hay in enumerate(hays) for q, x in enumerate(texts) if _plain(x, hay, threshold, strict)}
    assert quotes._near_pairs(hays, needles, groups, table, threshold, strict) == want and want


@pytest.mark.parametrize("words", [1, 3])
def test_common_subsequences_of_stretches(words):
    r = random.Random(words)
    texts = ["".join(r.choice("abc你") for _ in range(r.randint(64 * words - 20, 64 * words))) for _ in range(7)]
    needles = [quotes._Needle(x) for x in texts]
    group = quotes._Group(needles, list(range(7)), {c: i for i, c in enumerate("abc你")}, 0.78, False)
    hays = ["".join(r.choice("abcz你") for _ in range(150)) for _ in range(5)]
    got = group._common(quotes.np.array([["abc你z".index(c) for c in x] for x in hays]).T)
    whole = [[x.common(hay) for x in needles] for hay in hays]
    assert group.words == words and got.tolist() == whole


def test_matching_is_done_for_few_windows(monkeypatch):
    """Unlike texts in the same letters: no window is compared alone, though most hold many of the quotes' pairs of characters."""
    r = random.Random(4)
    syllables = ["the", "ing", "tion", "ha", "er", "re", "an", "st", "on", "nd", "or", "es"]
    make = lambda n: "".join(r.choice(syllables) for _ in range(n))
    needles, hays = [quotes._Needle(make(40)[:85]) for _ in range(20)], [make(200) for _ in range(20)]
    calls = []
    monkeypatch.setattr(quotes._Needle, "common", lambda self, window: calls.append(1) or 0)
    assert quotes._near_pairs(hays, needles, *quotes._groups(needles, 0.78, False), 0.78, False) == set()
    assert len(calls) < 400  # of some 14,000 windows


@pytest.mark.parametrize("block", [2000, 2])
def test_fuzzy_join_by_brute_force(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(1000, None), (1001, "")], docs.schema))
    texts = {x.doc_id: x.text for x in docs.collect()}
    r = random.Random(2)
    asked = [(i, "".join(r.choice("qxz") if r.random() < p else c for c in texts[i][5:85])) for i, p in zip(range(0, 40, 4), [0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.1, 0.05, 0.2, 0.5])]
    asked += [(100, None), (101, "abc"), (102, "")]
    given = spark.createDataFrame(asked, "quote_id int, quote string")
    got = sorted(map(tuple, quotes.fuzzy_join(given, docs, block=block).collect()))
    plain = {x.id: x.n for x in docs.select(F.col("doc_id").alias("id"), normalize_tokens(F.col("text")).alias("n")).collect()}
    needles = {x.id: x.n for x in given.select(F.col("quote_id").alias("id"), normalize_tokens(F.col("quote")).alias("n")).collect()}
    want = sorted((d, q) for d, hay in plain.items() for q, needle in needles.items() if hay and needle and _plain(needle, hay, quotes.FUZZY, False))
    assert got == want and len(want) >= 3


def test_edited_benchmark_passages_are_found(spark):
    rows = plans.QUERIES["jn_10_fuzzy_quotes"](spark, SF)
    found = {(x.doc_id, x.quote_id) for x in rows.collect()}
    bench = {x.item_id: x.text[:100] for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    held = {(x.doc_id, q) for x in spark.read.parquet(f"{SF}/documents.parquet").collect() for q, text in bench.items() if text in x.text}
    assert held <= found and held


def test_candidates_of_a_name_that_a_third_of_notes_share(spark):
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        part = spark.read.parquet(f"{SF}/part.parquet")
        stem = F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"), "p_name")
        hot = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("shared"))).otherwise(F.array("p_type"))
        entries = part.select(stem.alias("rel_stem"), F.col("p_name").alias("stem"), F.lit(None).cast("string").alias("title"), hot.alias("aliases"))
        got = {}
        for x in vault.name_candidates(entries).collect():
            got.setdefault(x.name, []).append((x.ordinal, x.rel_stem))
        want = {x.name: list(enumerate(x.candidates, 1)) for x in vault.name_index(entries).collect()}
        assert {k: sorted(v) for k, v in got.items()} == want and len(want["shared"]) >= part.count() // 3
    finally:
        spark.conf.unset(conf)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_contained_by_automaton_and_by_blocks(spark, monkeypatch, bound):
    """Equal and nested quotes, ids that repeat, empty and null texts; both ways against ``in``."""
    monkeypatch.setattr(quotes, "AUTOMATON_BYTES", bound)
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abAé 你,") for _ in range(n))
    asked = [(i, make(r.randint(0, 8))) for i in range(40)] + [(i, make(70)) for i in range(40, 44)] + [(3, "a b"), (90, None), (91, "AB"), (92, "a-b"), (93, " ,")]
    rows = [(i, make(r.randint(0, 60))) for i in range(60)] + [(i, make(9) + asked[40 + i % 4][1] + "b") for i in range(60, 68)] + [(5, "xx ab"), (5, "xx ab"), (80, None), (81, "")]
    plain = lambda x: "".join(c for c in x or "" if c.isalnum()).lower()
    got = quotes.contained(spark.createDataFrame(asked, "quote_id int, quote string"), spark.createDataFrame(rows, "doc_id long, text string"))
    want = {(d, q) for d, text in rows for q, quote in asked if plain(quote) and plain(quote) in plain(text)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(q >= 40 for _, q in want)
    for some in (got.schema, quotes.contained(spark.createDataFrame([], "quote_id int, quote string"), spark.createDataFrame(rows, "doc_id long, text string")).schema):
        assert [f.dataType.simpleString() for f in some] == ["bigint", "int"]
    assert quotes.contained(spark.createDataFrame([], "quote_id int, quote string"), spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
