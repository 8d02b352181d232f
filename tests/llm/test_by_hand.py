"""Queries against plain versions, and values of odd rows."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import decontaminate, language_id, license_scan, line_dedup, media_audio, mixing, quality, queries, sharding, token_counts
from stratalog.llm.common import fold

SF = "/root/testdata/sf0.001"
MASK = (1 << 32) - 1


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and long texts, null and repeated ids, repeated rows, and columns whose names clash with results."""
    rows = [(None, "one two", "en", "a"), (1, None, "en", None), (2, "", None, "a"), (3, " \t\n", "en", "a"), (4, "word", "fr", "b"), (4, "word", "fr", "b"), (4, "other word", "fr", "b"), (5, "y" * 50_000 + " z", "en", None), (None, "one two", "en", "a")]
    clash = {c: F.lit("clash") for c in ("score", "lang_pred", "rejected", "predicted", "license", "n_words", "n_tokens", "size", "shard", "slot", "copy", "taken", "media", "row", "key", "pos", "lost", "h", "range", "none", "one", "part", "mix", "feature")}
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns(clash)


def plain_subwords(text):
    """Buckets of the 2 to 4 byte subwords of the words of a text with their bounds."""
    raw = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in text.encode())
    for word in raw.split(b" "):
        if word:
            w = b" " + word + b" "
            for k in (2, 3, 4):
                for i in range(len(w) - k + 1):
                    c = int.from_bytes(w[i : i + k], "big") * 0x9E3779B1 + (k * 0x85EBCA6B & MASK) & MASK
                    c = (c ^ c >> 15) * 0x2C1B3C6D & MASK
                    yield c >> 16


def test_op1_by_hand(spark, table):
    model = language_id.fit(table, fold("doc_id", 3) != 1)
    got = {r.doc_id: r for r in language_id.identify(table, model, keep=["doc_id"]).collect()}
    for r in table.collect():
        ids = list(plain_subwords(r.text))
        z = (model.table[ids].astype(np.float64).mean(0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id].lang_pred == model.langs[int(p.argmax())] and abs(got[r.doc_id].score - p.max()) < 1e-5
    again = language_id.fit(table.repartition(5), fold("doc_id", 3) != 1)
    assert (again.table == model.table).all() and (again.temperature, again.reject_below) == (model.temperature, model.reject_below)
    same = [(r.doc_id, r.held_out, r.lang_pred) for r in queries.op1_language_id(spark, SF).collect()]
    assert sorted(same) == sorted((i, zlib.crc32(str(i).encode()) % 3 == 1, r.lang_pred) for i, r in got.items())


def test_op1_pieces_and_rejection():
    for n in (0, 1, 24, 25, 883, 14_144, 14_145, 3_000_000):
        bounds = language_id.piece_bounds(n)
        assert bounds[0] == 0 and bounds[-1] == n and bounds == sorted(bounds) and len(bounds) - 1 <= language_id.MOST_PIECES + 3
    scores, right = np.array([0.9, 0.8, 0.8, 0.7, 0.6]), np.array([True, True, False, True, False])
    assert [language_id.rejection_threshold(scores, right, e) for e in (0, 0.25, 0.34, 1)] == [0.9, 0.7, 0.7, 0.6]
    assert language_id.rejection_threshold(np.array([0.5]), np.array([False])) > 0.5


def test_op1_odd_rows(odd):
    rows = language_id.op1(odd).collect()
    assert Counter(r.lang_pred for r in rows if r.doc_id in (1, 2, 3)) == {"und": 3} and all(r.score == 0 and r.rejected for r in rows if r.lang_pred == "und")
    assert len(rows) == 9 and all(0 < r.score <= 1 for r in rows if r.lang_pred != "und") and language_id.op1(odd.limit(0)).schema == language_id.op1(odd).schema
    alone = language_id.identify(odd, language_id.fit(odd, F.lit(False))).collect()
    assert {r.lang_pred for r in alone} == {"und"} and {r.key for r in alone} == {"clash"}


def test_op3_joined_as_in_one_block(spark, odd, monkeypatch):
    """A benchmark beyond a block, with a prefix that many items share, gives what a small one gives."""
    want = sorted(map(tuple, queries.op3_decontaminate(spark, SF).collect()))
    shared = "answer the question below in one word and nothing else please now"
    items = spark.createDataFrame([(i, f"{shared} {i} one two three {'x' * (i % 3)}") for i in range(40)] + [(i, "one two") for i in (90, 91)] + [(None, "other word"), (99, None), (98, "")], "item_id int, text string")
    docs = spark.createDataFrame([(i, f"before {shared} {i} after") for i in range(30)] + [(50, None), (51, "")], "doc_id int, text string").unionByName(odd.select(F.col("doc_id").cast("int").alias("doc_id"), "text"))
    small = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    assert sorted(map(tuple, queries.op3_decontaminate(spark, SF).collect())) == want
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, items).collect()) == small
    assert max(len(x[3]) for x in small) == 40 and sum(x[3] == ["90", "91"] for x in small) == 2 and sum(x[3] == [""] for x in small) == 1
    clash = decontaminate.decontaminate(odd, items, keep=["doc_id", "n_words", "key", "h"]).columns
    assert clash[:3] == ["doc_id", "key", "h"] and decontaminate.decontaminate(odd.limit(0), items).collect() == [] and {r.n_items for r in decontaminate.decontaminate(odd, items.limit(0)).collect()} == {0}


def plain_audio(raw):
    """(payload, frame offsets, samples) of a stream as the writer makes it, read header by header."""
    size = sum((b & 127) << s for b, s in zip(raw[6:10], (21, 14, 7, 0)))
    length = int.from_bytes(raw[20 + 15 : 20 + 23], "big")
    at, offsets, data = 10 + size, [], b""
    while at < len(raw):
        (head,) = struct.unpack(">I", raw[at : at + 4])
        kbit = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[head >> 12 & 15]
        step = 144 * kbit * 1000 // 32000
        if raw[at + 23 : at + 27] != b"Xing":
            offsets.append(at)
            data += raw[at + 23 : at + step]
        at += step
    return data[:length], offsets, 1152 * len(offsets)


def test_op4_by_hand(spark, table):
    media = {r.doc_id: r.media for r in media_audio.store(table).collect()}
    got = {r.doc_id: r for r in queries.op4_media_audio(spark, SF).collect()}
    assert len(got) == table.count()
    for r in table.collect():
        text = r.text.encode()
        payload, raw = text + bytes(-len(text) % 64 or 64 * (not text)), media[r.doc_id]
        back, offsets, samples = plain_audio(raw)
        g = got[r.doc_id]
        assert back == payload and (g.n_bytes, g.payload_bytes, g.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert (g.tail_crc32, g.media_bytes, g.media_sha256) == (zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest())
        assert (g.seek_offsets, g.samples, g.sample_rate, g.duration_s, g.crc_bad) == (offsets, samples, 32000, float(Fraction(samples, 32000)), 0)


def test_op4_odd_rows(odd):
    rows = media_audio.probe(media_audio.store(odd)).collect()
    empty = hashlib.sha256(bytes(64)).hexdigest()
    assert len(rows) == 9 and {(r.payload_sha256, r.n_bytes) for r in rows if r.doc_id in (1, 2)} == {(empty, 0)}
    assert len({tuple(r)[1:10] for r in rows if r.n_bytes == 4}) == 1 and media_audio.probe(media_audio.store(odd.limit(0))).collect() == []
    broken = odd.limit(2).selectExpr("doc_id", "1L AS n_bytes", "CASE WHEN text IS NULL THEN NULL ELSE CAST('no audio' AS BINARY) END AS media")
    assert [(r.payload_bytes, r.samples, r.sample_rate, r.duration_s, r.seek_offsets) for r in media_audio.probe(broken).collect()] == [(0, 0, 0, 0.0, [])] * 2


def test_a_damaged_frame_goes_alone():
    raw = media_audio.write(random.Random(1).randbytes(64 * 300))
    whole = media_audio.parse(raw)
    n = len(whole.frames)
    for k in range(n):
        for byte in range(3):
            torn = bytearray(raw)
            torn[whole.frames[k].at + byte] = 0
            assert [f.at for f in media_audio.parse(bytes(torn)).frames] == [f.at for i, f in enumerate(whole.frames) if i != k]
    assert [f.at - 4 for f in media_audio.parse(b"junk" + raw[raw.index(b"\xff\xfa") :]).frames] == [f.at - raw.index(b"\xff\xfa") for f in whole.frames]


def _frame(layer, kbit, mode, body, protected=True):
    """A frame of MPEG-1 at 48 kHz of layer I or II with a right checksum over ``covered`` bits."""
    index = media_audio.BITRATES[1, layer].index(kbit) + 1
    head = bytes([0xFF, 0xF8 | (4 - layer) << 1 | (not protected), index << 4 | 1 << 2, mode << 4])
    f = media_audio.header_at(head + bytes(4), 0)
    data = head + b"\0\0" + body.ljust(f.size - 6, b"\0")
    n = media_audio.covered_bits(data, f)
    bits = "".join(f"{b:08b}" for b in data[2:4] + data[6:])[: 16 + n]
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)) & 0xFFFF
    return data[:4] + crc.to_bytes(2, "big") + data[6:], n


@pytest.mark.parametrize("layer,kbit,mode,bits", [(1, 128, 12, 128), (1, 128, 0, 256), (1, 128, 4, 144), (2, 64, 12, 94 - 6 + 26), (2, 32, 12, 26 + 12)])
def test_checksums_of_layers_one_and_two(layer, kbit, mode, bits):
    body = b"\xff" * 40
    frame, n = _frame(layer, kbit, mode, body)
    if layer == 1:
        assert n == bits  # four bits a subband and channel, shared beyond the bound
    else:
        bands = [4] * 11 + [3] * 12 + [2] * 4 if kbit == 64 else [4] * 2 + [3] * 6
        assert n == sum(bands) + 2 * len(bands)  # all subbands have an allocation here
    audio = media_audio.parse(frame * 3)
    assert [f.crc_ok for f in audio.frames] == [True] * 3
    bad = bytearray(frame * 3)
    bad[len(frame) + 7] ^= 1
    assert [f.crc_ok for f in media_audio.parse(bytes(bad)).frames] == [True, False, True]


def test_tags_and_tables():
    audio = media_audio.write(bytes(640))
    body = audio[audio.index(b"\xff\xfa") :]
    two = b"TT2" + (4).to_bytes(3, "big") + b"\0abc"
    three = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0a\xff\0"
    extended = (6).to_bytes(4, "big") + bytes(6)
    tag = lambda major, flags, raw: b"ID3" + bytes([major, 0, flags]) + bytes(len(raw) >> s & 127 for s in (21, 14, 7, 0)) + raw
    ape_item = (3).to_bytes(4, "little") + bytes(4) + b"Name\0xyz"
    ape = ape_item + b"APETAGEX" + (2000).to_bytes(4, "little") + (len(ape_item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    out = media_audio.parse(tag(2, 0, two) + tag(3, 0xC0, (extended + three).replace(b"\xff", b"\xff\0") + bytes(8)) + body + ape + b"TAG".ljust(128, b"\0"))
    assert out.tags["TT2"] == [b"\0abc"] and out.tags["TIT2"] == [b"\0a\xff\0"] and out.tags["APE:Name"] == [b"xyz"] and "ID3v1" in out.tags
    assert (out.skipped, len(out.frames)) == (0, 1)
    head = body[:4]
    first = media_audio.header_at(body, 0)
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 77, 5000, 12, 2, 3, 2, 4) + struct.pack(">HH", 100, 200)
    table = media_audio.parse((head + bytes(32) + vbri).ljust(first.size, b"\0") + body[first.size :]).table
    assert (table["kind"], table["frames"], table["bytes"], table["quality"], table["step_frames"], table["steps"]) == ("VBRI", 12, 5000, 77, 4, [300, 600])


def test_durations_are_exact():
    audio = media_audio.Audio([media_audio.Frame(0, 1, 1, 3, 320, 32000, 1, 1152, False)] * 3)
    assert audio.duration == Fraction(3 * 1152, 32000) and audio.seconds == 3 * 1152 / 32000
    audio.frames.append(media_audio.Frame(0, 1, 1, 3, 320, 44100, 1, 1152, False))
    assert audio.duration == Fraction(3456, 32000) + Fraction(1152, 44100)


def test_op6_by_hand(spark):
    """Word vectors and pooling against plain loops over a fixture."""
    texts = ["The cat sat on the mat", "the cat the cat 42", "", None, "a  b\tc", "x1 X1 ...!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = quality.word_vectors(docs)
    index = quality.index_vectors()
    token = lambda w: quality.tokens_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
    sums = defaultdict(lambda: np.zeros(quality.DIM))
    pairs = [[(int(a[0]), int(b[0])) for a, b, _ in map(token, (t or "").split())] for t in texts]
    for tokens in pairs:
        for i, own in enumerate(tokens):
            for j in range(max(0, i - 2), min(len(tokens), i + 3)):
                if i != j:
                    for bucket in own:
                        sums[bucket] += index[tokens[j][0]] + index[tokens[j][1]]
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for bucket, v in sums.items():
        want[bucket] = v / max(1e-9, np.sqrt((v**2).sum()))
    assert np.allclose(found, want, atol=1e-6)
    import pyarrow as pa

    x = quality.pooled(found, pa.array(texts, pa.string()))
    for row, tokens in zip(x, pairs):
        if tokens:
            assert np.allclose(row[: quality.DIM], np.mean([want[a] for a, _ in tokens], 0), atol=1e-6) and np.allclose(row[quality.DIM : 2 * quality.DIM], np.mean([want[b] for _, b in tokens], 0), atol=1e-6)
            bigrams = list(zip(tokens, tokens[1:]))
            assert abs(row[-1] - (1 - len({(a[0], b[0]) for a, b in bigrams}) / len(bigrams) if bigrams else 0)) < 1e-9
        assert row[2 * quality.DIM] == (not tokens)


def test_op6_query_by_hand(spark, table):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(table, labels, fold("doc_id", 5) != 0)
    assert (quality.fit(table.repartition(7), labels.repartition(3), fold("doc_id", 5) != 0).first == model.first).all()
    import pyarrow as pa

    for g, text in queries.op6_quality(spark, SF).join(table.select("doc_id", "text"), "doc_id").select(F.struct("doc_id", "held_out", "score", "predicted"), "text").collect():
        z = np.maximum((quality.pooled(model.table, pa.array([text]))[0] - model.mean) / model.scale @ model.first + model.first_bias, 0) @ model.second + model.second_bias
        assert abs(g.score - 1 / (1 + np.exp(-z / model.temperature))) < 1e-9
        assert (g.held_out, g.predicted) == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0, int(g.score >= 0.3))


def test_op6_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (1, 1), (None, 1), (3, None), (3, 7)], "doc_id bigint, quality int")
    rows = quality.op6(odd, labels).collect()
    by = {r.doc_id: r for r in rows if r.doc_id != 4}
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows) and by[1].score == by[2].score == by[3].score
    none = quality.op6(odd, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {1} and len({r.score for r in none}) == 1 and quality.op6(odd.limit(0), labels).collect() == []


def test_op7_by_hand(spark, table):
    """Every place at which all words of a notice stand in a row is among the places found, with its span."""
    templates = [(name, license_scan.words_of(t.encode())) for name, t in license_scan.NOTICES]
    for r in queries.op7_license_scan(spark, SF).join(table.select("doc_id", "text"), "doc_id").collect():
        words = license_scan.words_of(r.text.encode())
        want = {(name, i, i + len(own)) for name, own in templates for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own}
        whole = {(p.license, p.first_word, p.end_word) for p in r.places if p.coverage == 1}
        assert want <= whole and r.n_words == len(words)
        assert (r.license is not None) == bool(r.places) and all(p.coverage >= 0.8 for p in r.places)


def _aligned(a, b):
    """The most words that any alignment of two lists has, in order."""
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(row[j], best[j + 1]))
        best = row
    return best[-1]


def test_op7_alignment_against_the_longest_common_subsequence():
    rng = random.Random(5)
    own = license_scan.words_of(dict(license_scan.NOTICES)["MIT-permission"].encode())
    for _ in range(200):
        text = [w for w in own if rng.random() > 0.08]
        for _ in range(rng.randrange(4)):
            text.insert(rng.randrange(len(text)), rng.choice([b"foo", b"the", b"of"]))
        pairs = license_scan.patience(text, own)
        most = _aligned(text, own)
        assert all(text[i] == own[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs) <= most and len(pairs) >= most - 2


def test_op7_odd_rows(odd):
    rows = license_scan.scan(odd, keep=["doc_id", "license", "key"]).collect()
    assert len(rows) == 9 and all((r.license, r.coverage, r.first_word, r.end_word, r.places, r.key) == (None, 0.0, 0, 0, [], "clash") for r in rows)
    assert sorted(r.n_words for r in rows) == [0, 0, 0, 1, 1, 2, 2, 2, 2] and license_scan.scan(odd.limit(0)).collect() == []


def test_op8_odd_rows(odd):
    rows = mixing.mix_sources(odd).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted([("None", 2)] * 2 + [("1", 0), ("2", 0), ("3", 0), ("4", 1), ("4", 1), ("4", 2), ("5", 2)])
    # Sources a (4 words, weight 5), b (4, weight 2), none (2, weight 1) share ten words: 6.25, 2.5 and 1.25.
    assert {r.source_size: round(r.target, 9) for r in rows if r["size"]} in ({4: 6.25, 2: 1.25}, {4: 2.5, 2: 1.25})
    assert all(r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in rows) and mixing.mix_sources(odd.limit(0)).collect() == []
    gone = [r for r in rows if r.doc_id is None]
    assert gone[0] == gone[1]


@pytest.mark.parametrize("bounds", [(0, 50_000), (50_000, 3), (0, 2)])
def test_op8_is_the_same_beyond_its_bounds(spark, monkeypatch, bounds):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(30), f"s{rng.randrange(40):02d}" if i % 9 else None) for i in range(600)], "doc_id bigint, text string, source string")
    want = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bounds[0])
    monkeypatch.setattr(mixing, "RUN_ROWS", bounds[1])
    assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == want
    total, weights = Counter(), (5, 2, 1)
    for _, size, *_ in want:
        total["all"] += size
    sources = {}
    for r in docs.collect():
        sources[r.source] = sources.get(r.source, 0) + len(r.text.split())
    order = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, stopped = {}, set()
    while True:
        left = total["all"] - sum(3 * sources[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in stopped) for s in order if s not in stopped}
        more = {s for s, v in share.items() if v > 3 * sources[s]}
        if not more:
            break
        stopped |= more
    target = {s: share.get(s, 3 * sources[s]) for s in order}
    found = {(r.source_size, round(r.target, 6)) for r in mixing.mix_sources(docs).collect()}
    assert found == {(sources[s], round(target[s], 6)) for s in order}


def test_op9_query_by_hand(spark, table):
    scores = token_counts.load_scores()
    counter = token_counts.TrieCounter(scores)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op9_token_counts(spark, SF).collect()}
    seen = {}
    for r in table.collect():
        words = r.text.encode().split()
        for w in set(words) - seen.keys():
            seen[w] = counter._walk(token_counts.MARK + w.decode())  # without the trie
        assert got[r.doc_id] == (len(words), sum(seen[w] for w in words))


def test_op9_long_runs_and_odd_rows(spark, odd, monkeypatch):
    scores = token_counts.load_scores()
    words = ["a" * n for n in (1, 254, 255, 256, 257, 5000)] + ["thequickbrown" * 400, "漢字" * 300]
    want = [token_counts.TrieCounter(scores).count(w) for w in words]
    monkeypatch.setattr(token_counts, "LONG", 1 << 20)
    assert [token_counts.TrieCounter(scores).count(w) for w in words] == want
    monkeypatch.setattr(token_counts, "MOST_NODES", 10)
    tight = token_counts.TrieCounter(scores)
    assert [tight.count(w) for w in words] == want
    rows = token_counts.count_tokens(odd, keep=["doc_id", "key"]).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 0, 1, 1, 2, 2, 2, 2] and all((r.n_tokens == 0) == (r.n_words == 0) and r.key == "clash" for r in rows)
    assert token_counts.count_tokens(odd.limit(0)).collect() == []


def plain_shards(rows, parts, shards, seed):
    """Rows (id, size, crc, three hashes) dealt and ranked by plain loops."""
    counts = Counter(r[3] % parts for r in rows)
    matrix = sharding.communication_matrix([counts[p] for p in range(parts)], shards, seed)
    dealt = []
    for p in range(parts):
        own = sorted((r for r in rows if r[3] % parts == p), key=lambda r: (r[4], r[0] is not None, r[0] or 0, r[2], r[1]))
        at = 0
        for s, n in enumerate(matrix[p]):
            dealt += [(s, r) for r in own[at : at + n]]
            at += n
    out = []
    for s in range(shards):
        own = sorted((r for t, r in dealt if t == s), key=lambda r: ((r[5] & (1 << 64) - 1) >> 33, r[5], r[0] is not None, r[0] or 0, r[2], r[1]))
        out += [(r[0], r[1], r[2], s, slot) for slot, r in enumerate(own)]
    return out


@pytest.mark.parametrize("part_rows,parts", [(1_000_000, 16), (10, 21)])
def test_op10_by_hand(spark, table, monkeypatch, part_rows, parts):
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    docs = table.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a"), (None, "b"), (7, None), (7, "")], "doc_id bigint, text string"))
    base = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"))
    rows = [tuple(r) for r in base.select("doc_id", "size", "c", *[F.xxhash64(F.lit(42 * 4 + n), "doc_id", "c", "size") for n in range(3)]).collect()]
    got = sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs).collect()), key=str)
    assert got == sorted(plain_shards(rows, parts, 8, 42), key=str)


def test_op10_odd_rows(odd):
    rows = sharding.shard(odd, shards=2, keep=["text", "key"]).collect()
    assert {r.shard: sorted(x.slot for x in rows if x.shard == r.shard) for r in rows} in ({0: [0, 1, 2, 3, 4], 1: [0, 1, 2, 3]}, {0: [0, 1, 2, 3], 1: [0, 1, 2, 3, 4]})
    assert sorted(r.copy for r in rows) == [0] * 7 + [1, 1] and {r.key for r in rows} == {"clash"} and all(r["size"] == len(r.text or "") + 1 for r in rows)
    assert sharding.shard(odd.limit(0)).collect() == []


def test_op2_odd_rows(spark, odd):
    line = "a line that is long enough to count"
    more = spark.createDataFrame([(10, line), (10, line + "\nx"), (11, f" {line.upper()}\t"), (None, line), (None, f"{line}\ny")], "doc_id bigint, text string")
    out = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(more).collect()]
    # Three documents hold it: none, 10 and 11; the largest keeps it.
    assert sorted(out, key=str) == sorted([(10, "", 1, 1), (10, "x", 2, 1), (11, f" {line.upper()}\t", 1, 0), (None, "", 1, 1), (None, "y", 2, 1)], key=str)
    two = line_dedup.dedup_lines(more.where("doc_id is not null")).collect()
    assert sum(r.n_dropped for r in two) == 0
    plain = [(r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(odd).collect()]
    assert sorted(plain) == sorted([(t or "", (t or "").count("\n") + 1, 0) for t in ("one two", None, "", " \t\n", "word", "word", "other word", "y" * 50_000 + " z", "one two")])
    assert line_dedup.dedup_lines(odd.limit(0)).collect() == []


def test_pipeline_stages_by_hand(spark, table):
    """Quality, mixing and sharding as stages against their operators' plain results; the other two have tests of their own."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.score for r in quality.score(table, quality.fit(table, labels, fold("doc_id", 5) != 0), keep=["doc_id"]).collect()}
    kept = corpus_pipeline.quality_stage(spark, table, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in scored.items() if s >= 0.3) and kept.columns == table.columns
    mixed = corpus_pipeline.mix_stage(spark, table, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(table).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n}) and mixed.columns == table.columns
    shards = corpus_pipeline.shard_stage(spark, mixed, SF).collect()
    texts = {r.doc_id: r.text for r in table.collect()}
    assert Counter((r.doc_id, r.copy) for r in shards) == Counter((i, k) for i, n in copies.items() for k in range(n)) and all(r.text == texts[r.doc_id] for r in shards)
    sizes = Counter(r.shard for r in shards)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in shards if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_pipeline_leaves_no_spent_tables(spark, table, tmp_path):
    import glob

    from stratalog.llm.common import shared_dir

    at = f"{shared_dir(spark)}/stratalog/"
    before = set(glob.glob(at + "*"))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() and {"text", "shard", "slot", "copy"} <= set(out.columns)
    assert not [p for p in set(glob.glob(at + "*")) - before if any(p[len(at) :].startswith(name) for name, _ in corpus_pipeline.STAGES)]
