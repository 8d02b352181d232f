import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import decontaminate, language_id, license_scan, line_dedup, media_audio, mixing, near_dedup, quality, queries, sharding, simhash_golay, token_counts
from stratalog.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
LONG = "this very long line is held by many documents"
TEXTS = [None, "", " \t", "word", f"{LONG}\nalpha beta", f"  {LONG.upper()}\x0b\ngamma", f"{LONG}\n{LONG}\ndelta\n", "a b c d e f g h i j k l m", "A B C D E F G H I J K L M", "é à ü " * 40, "x" * 200_000, "!!! ???"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], 0) for i, t in enumerate(TEXTS)] + [(None, "null id text", "en", "a", None), (3, "word", "fr", "b", 4)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("n_lines", F.lit(1)).withColumn("key", F.lit(2)).withColumn("h", F.lit(3))


OPERATORS = {
    "language": lambda s, d: language_id.op1(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "leaks": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "c d e f g h i j k l"), (2, None)], "item_id int, text string")),
    "media": lambda s, d: media_audio.probe(media_audio.store(d)),
    "simhash": lambda s, d: simhash_golay.simhash_dedup(d),
    "quality": lambda s, d: quality.op6(d, s.createDataFrame([(4, 1), (5, 0), (7, None)], "doc_id bigint, quality int")),
    "license": lambda s, d: license_scan.scan(d),
    "mixing": lambda s, d: mixing.mix_sources(d),
    "tokens": lambda s, d: token_counts.count_tokens(d),
    "sharding": lambda s, d: sharding.shard(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, docs, name):
    assert OPERATORS[name](spark, docs).count() == docs.count()
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, SF)
    cols = sorted(rows.columns)
    assert sorted(map(tuple, rows.select(cols).collect())) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_language_held_out(spark):
    rows = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_language_without_letters(spark, docs):
    got = {r.doc_id: r.lang_pred for r in language_id.op1(docs).collect()}
    assert got[0] == got[1] == got[2] == got[11] == "und" and got[9] != "und"


def test_quality_held_out(spark):
    rows = queries.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.9 * len(rows)


def test_line_dedup(spark, docs):
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).where("doc_id between 4 and 6").collect()}
    assert got == {4: ("alpha beta", 2, 1), 5: ("gamma", 2, 1), 6: (f"{LONG}\n{LONG}\ndelta\n", 4, 0)}


def _windows(text, benchmark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    w, hit, items = words(text), set(), set()
    for item, raw in benchmark:
        b = words(raw)
        n = min(10, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                items.add(str(item))
    return len(w), len(hit), sorted(items)


def test_decontaminate_by_brute_force_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    make = lambda n: " ".join(rng.choice(list("abcé"), n))
    bench = [(i, make(int(rng.integers(0, 30)))) for i in range(12)] + [(50, "Zz"), (50, "Zz"), (51, None)]
    rows = [(i, make(int(rng.integers(0, 60))) + (" " + bench[i % 12][1] if i % 3 == 0 else "") + (" zz" if i % 7 == 0 else "")) for i in range(60)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(bench, "item_id int, text string").coalesce(1)).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == _windows(r.text, bench)
        assert r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest()


@pytest.mark.parametrize("text", [b"", b"a", "é".encode() * 5000, bytes(range(256)) * 40, b"\xff\xfa" * 3000])
def test_audio_round_trip(text):
    payload = media_audio.padded(text)
    raw = media_audio.write(payload)
    audio = media_audio.parse(raw)
    assert audio.payload == payload and audio.skipped == 0 and audio.table["frames"] == len(audio.frames) and audio.table["bytes"] == sum(f.size for f in audio.frames) + audio.frames[0].at - raw.index(b"\xff\xfa")
    assert all(f.crc_ok for f in audio.frames) and audio.seconds == len(audio.frames) * 1152 / 32000
    torn = media_audio.parse(b"junk" + raw[raw.index(b"\xff\xfa") :] + b"tail" + b"TAG".ljust(128, b"\0"))
    assert len(torn.frames) == len(audio.frames) and torn.skipped == 8 and "ID3v1" in torn.tags
    broken = bytearray(raw)
    broken[audio.frames[0].at + 7] ^= 1
    assert media_audio.parse(bytes(broken)).frames[0].crc_ok is False


def test_golay_indices_meet_within_two_errors():
    rng = np.random.default_rng(2)
    assert (np.unique(simhash_golay.golay_tables()["errors"][:, 0]).size, int(np.bitwise_count(simhash_golay.golay_tables()["errors"][:, 0]).max())) == (2048, 3)
    for _ in range(3000):
        a = int(rng.integers(0, 1 << 23))
        b = a ^ (1 << int(rng.integers(0, 23))) ^ (1 << int(rng.integers(0, 23)))
        x, used = simhash_golay.golay_indices(np.array([a, b]))
        assert set(x[0][used[0]]) & set(x[1][used[1]])


def test_fuzzy_keys_meet_within_four_errors():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000).astype(np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    met = np.zeros(4000, bool)
    sets = [[set() for _ in range(4000)] for _ in range(2)]
    for s, x in zip(sets, (a, b)):
        for key, used in simhash_golay.fuzzy_keys(x):
            for i in np.flatnonzero(used):
                s[i].add(int(key[i]))
    met = [bool(p & q) for p, q in zip(*sets)]
    assert all(met)


def _components(prints):
    u, parent = np.unique(np.array(prints, np.uint64)), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, x in enumerate(u):
        for y in u[i + 1 :][np.bitwise_count(u[i + 1 :] ^ x) <= 4]:
            parent[max(find(int(x)), find(int(y)))] = min(find(int(x)), find(int(y)))
    return {int(x): find(int(x)) for x in u}


@pytest.mark.parametrize("members,pairs", [(16384, 64), (50, 4)])
def test_simhash_by_brute_force(spark, monkeypatch, members, pairs):
    monkeypatch.setattr(simhash_golay, "BUCKET_MEMBERS", members)
    monkeypatch.setattr(simhash_golay, "ALL_PAIRS", pairs)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50)]
    base = list(rng.choice(words, 400))
    rows = [(0, None), (1, ""), (2, "one two"), (2, "one two")]
    for i in range(300):
        w = list(base)
        for j in rng.integers(0, 400, int(rng.integers(0, 12))):
            w[j] = "q"
        rows.append((10 + i, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choice(words, 30))) for i in range(100)]
    got = simhash_golay.simhash_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = dict(rows)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        assert int(r.fingerprint, 16) == sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))
    roots, least = _components([int(r.fingerprint, 16) for r in got]), {}
    for r in got:
        root = roots[int(r.fingerprint, 16)]
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert all(r.component_id == least[roots[int(r.fingerprint, 16)]] for r in got) and len(got) == len(rows)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(i + 1001, i + 1000) for i in range(60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(got.get(x, x) == find(x) for x in list(parent))


def test_patience():
    a, b = "x a b c y d e z".split(), "a b q c d e".split()
    assert [(a[i], b[j]) for i, j in license_scan.patience(a, b)] == [(w, w) for w in "abcde"]
    assert license_scan.patience([], ["a"]) == []


def test_license_scan(spark):
    texts = ["noise here.\nReleased under the MIT License. more", "This work is licensed under the GNU General Public License, version 3.", "the under license mit unrelated", None]
    got = [r.license for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT", "GPL-3.0", None, None]


def test_license_lines_of_the_table_by_brute_force(spark):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "All-rights-reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r.doc_id: {lines[x] for x in r.text.split("\n") if x in lines} for r in d.collect()}
    seen = {x for r in d.collect() for x in r.text.split("\n") if re.search(r"(?i)licen|rights reserved|copyright", x)}
    got = {r.doc_id: r.license for r in license_scan.scan(d, keep=["doc_id"]).collect()}
    assert seen <= set(lines) and sum(map(bool, held.values())) > 20
    assert all(got[i] in names if names else got[i] is None for i, names in held.items())


def test_every_template_is_found():
    own = sorted(((name, license_scan.words_of(t.encode())) for name, t in license_scan.TEMPLATES), key=lambda x: (-len(x[1]), x[0]))
    for name, words in own:
        assert license_scan.scan_words([b"foo", *words, b"bar"], own, 0.8)[:2] == (name, 1.0)


def test_repeated_notices_in_prose():
    own = sorted(((name, license_scan.words_of(t.encode())) for name, t in license_scan.TEMPLATES), key=lambda x: (-len(x[1]), x[0]))
    words = "the foo released under the mit license bar released under the mit license baz the".split()
    assert license_scan.scan_words([w.encode() for w in words], own, 0.8) == ("MIT", 1.0, 2, 7)
    rng = np.random.default_rng(7)
    for name in ("MIT", "Apache-2.0-header", "GPL-3.0-header", "MIT-text", "GPL-3-full"):
        notice, text, at = dict(own)[name], [], []
        for _ in range(3 if name == "GPL-3-full" else 6):
            text += [[b"the", b"of", b"or", b"to", b"foo", b"license"][k] for k in rng.integers(0, 6, int(rng.integers(3, 30)))] + [b"foo"]
            at.append((1.0, len(text), len(text) + len(notice)))
            text += notice + [b"foo"]
        got = license_scan.occurrences(text, notice, 0.8)
        assert len(got) == len(at) and all(g[0] >= 0.99 and abs(g[1] - w[1]) <= 30 and abs(g[2] - w[2]) <= 30 for g, w in zip(got, at))
    edited = dict(own)["Apache-2.0-header"]
    edited = edited[:10] + [b"x"] * 12 + edited[10:30] + edited[33:]
    assert len(license_scan.occurrences([b"the"] + edited + [b"of"] + edited + [b"you"], dict(own)["Apache-2.0-header"], 0.8)) == 2


def test_all_licenses_of_a_document(spark):
    text = "foo Released under the MIT License. bar Licensed under the Apache License, Version 2.0. baz Released under the MIT License."
    row, none = license_scan.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [tuple(p) for p in row.places if p.coverage == 1] == [("MIT", 1.0, 1, 6), ("Apache-2.0", 1.0, 7, 15), ("MIT", 1.0, 16, 21)]
    assert (row.license, row.coverage, row.first_word, row.end_word, none.places) == ("Apache-2.0", 1.0, 7, 15, [])


def test_mix_keeps_bounds(spark):
    rows = queries.op8_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, target, size = Counter(), {}, max(r.size for r in rows)
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
    assert all(0 <= target[s] - taken[s] <= size for s in target)
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-3


def test_mix_documents_takes_the_same_copies(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    copies = Counter(r.doc_id for r in mixing.mix_documents(d).select("doc_id").collect())
    assert copies == Counter({r.doc_id: r.copies for r in mixing.mix_sources(d).collect() if r.copies})


def test_token_counts_by_brute_force(spark):
    scores = token_counts.load_scores()
    counter = token_counts.TrieCounter(scores)

    def plain(word):
        text = token_counts.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            found = None
            for size in range(1, min(end, 64) + 1):
                s = scores.get(text[end - size : end])
                if s is not None and (found is None or best[end - size][0] + s > found[0]):
                    found = (best[end - size][0] + s, best[end - size][1] + 1)
            if found is None:
                n = len(text[end - 1].encode())
                found = (best[end - 1][0] + counter.unknown * n, best[end - 1][1] + n)
            best.append(found)
        return best[-1][1]

    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect() for w in r.text.split()} | {"漢字", "a" * 500, "🎙"}
    assert {w: counter.count(w) for w in words} == {w: plain(w) for w in words}
    assert counter.visits < sum(len(w) + 1 for w in words)


def test_sharding(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard(d.unionByName(d), shards=8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    key = lambda rs: sorted((r.doc_id, r.shard, r.slot) for r in rs)
    assert key(rows) == key(sharding.shard(d.unionByName(d).repartition(7), shards=8).collect())


def test_communication_matrix():
    counts = [5, 0, 17, 100, 3]
    m = sharding.communication_matrix(counts, 8, 1)
    assert [sum(r) for r in m] == counts and all(s in (15, 16) for s in map(sum, zip(*m)))
    import random

    rng = random.Random(0)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(draws) / 4000 - 6) < 0.1 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontaminate_stage(spark, d, SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in d.collect() if not _windows(r.text, bench)[1]}
    one = corpus_pipeline.dedup_stage(spark, d, SF).collect()
    texts = sorted((r.doc_id, r.text) for r in d.collect())
    grams = [{tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} for _, t in texts]
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted(r.doc_id for r in one) == [texts[i][0] for i in range(len(texts)) if find(i) == i]
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in d.collect()} and max(Counter(r.doc_id for r in out).values()) <= 3


@pytest.mark.parametrize("most", [8 << 20, 6000])
def test_near_dedup_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "BUCKET_BYTES", most)
    rng = np.random.default_rng(6)
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE  two"), (5, "one three")]
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(20, 300)))]
        for i in range(12):
            w = list(base)
            for j in rng.integers(0, len(w), int(len(w) * rng.random() * 0.08)):
                w[j] = f"q{rng.integers(0, 500)}"
            rows.append((100 * (g + 1) + i, " ".join(w)))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))} if (t or "").split() else set()
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    far = 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += bin(simhash_golay.fingerprint((rows[i][1] or "").encode()) ^ simhash_golay.fingerprint((rows[j][1] or "").encode())).count("1") > 4
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = sorted(r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert far and got == [rows[i][0] for i in range(len(rows)) if find(i) == i]


def test_near_dedup_keeps_unlinked_texts_that_share_an_id(spark):
    rows = [(1, "one two three four five six", "b"), (1, "one two three four five six", "a"), (1, "quite another text of seven words", "c"), (2, "ONE two three four five six", "d"), (None, "a text without id", "e"), (None, "a text without id", "f")]
    got = sorted(r.source for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect())
    assert got == ["a", "c", "e", "f"]


def test_pipeline_near_dedup_on_the_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in d.collect())
    grams = [{tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} for _, t in rows]
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, d, SF).collect()) == [rows[i][0] for i in range(len(rows)) if find(i) == i]
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= {r[0] for r in rows} and max(Counter(r.doc_id for r in out).values()) <= 3


def test_pooling_is_bounded_by_rows():
    table = np.eye(quality.BUCKETS, 4, dtype=np.float32)
    x = quality.pooled(table, pa.array(["", None, "a b a b", "é"]))
    assert x.shape == (4, 10) and x[0, 8] == x[1, 8] == 1 and x[2, 9] > 0 and x[3, 8] == 0
