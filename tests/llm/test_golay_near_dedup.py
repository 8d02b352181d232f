"""Candidates of the pipeline's near-duplicate stage: SimHash fingerprints that share a Golay key, and nothing beside them."""

import numpy as np
import pytest

import corpus_pipeline
from stratalog.llm import near_dedup


def _keys(sets, bits):
    tables = near_dedup.key_shape(near_dedup.BUCKET_TEXTS << 12 + bits)[0]
    return near_dedup.print_keys(np.stack([near_dedup.votes(s, near_dedup.PRINT_BITS + near_dedup.CODE_BITS * tables) for s in sets]), bits)


@pytest.mark.parametrize("bits", [0, 4])
@pytest.mark.parametrize("one, other, common", [(5, 6, 5), (9, 9, 8), (13, 14, 12), (20, 25, 20), (80, 100, 80), (90, 90, 80)])
def test_similar_sets_share_a_key(bits, one, other, common):
    """Pairs at 0.8, sets of few shingles too; unrelated ones are as rare in a bucket as its key says."""
    rng = np.random.default_rng(one)
    sets = []
    for _ in range(60):
        both = rng.integers(0, 2**64, one + other - common, dtype=np.uint64)
        sets += [both[:one], both[one - common :]]
    prints, keys = _keys(sets, bits)
    assert (keys[::2] == keys[1::2]).any(1).all()
    assert (np.bitwise_count(prints[::2] ^ prints[1::2]).sum(1) <= near_dedup.PRINT_DISTANCE).all()
    assert (keys[::2] == np.roll(keys[1::2], 1, 0)).mean() < 0.01


def test_four_shingles_and_one_more_share_a_fingerprint():
    five = np.sort(np.random.default_rng(1).integers(0, 2**64, 5, dtype=np.uint64))
    four = near_dedup.looked_up(five[[0, 1, 2, 4]])
    assert len(four) == 1 and any(np.array_equal(four[0], s) for s in near_dedup.looked_up(five))


def test_tables_grow_with_the_texts():
    shapes = [near_dedup.key_shape(n) for n in (0, 1, 1 << 18, 1 << 20, 1 << 30)]
    assert [b for _, b in shapes] == [0, 0, 0, 2, 12] and shapes[0][0] == shapes[2][0] < shapes[3][0] < shapes[4][0]


@pytest.mark.parametrize("all_pairs, members", [(256, 1 << 18), (2, 1 << 18), (2, 6)])
def test_bucket_links_by_brute_force(monkeypatch, all_pairs, members):
    """However a bucket is compared, near fingerprints are joined; a bucket beyond the bound is joined whole."""
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(near_dedup, "BUCKET_MEMBERS", members)
    rng = np.random.default_rng(3)
    n = 150
    keys, nodes = np.sort(rng.integers(0, 9, n)), rng.permutation(n)
    prints = rng.integers(0, 2**63, (5, 2)).astype(np.uint64)[rng.integers(0, 5, n)]
    for row in prints:
        for bit in rng.integers(0, 128, rng.integers(0, 45)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)

    def roots(pairs):
        parent = list(range(n))
        find = lambda x: x if parent[x] == x else find(parent[x])
        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(n)]

    near = [(nodes[i], nodes[j]) for i in range(n) for j in range(i) if keys[i] == keys[j] and ((keys == keys[i]).sum() > max(members, all_pairs) or np.bitwise_count(prints[i] ^ prints[j]).sum() <= near_dedup.PRINT_DISTANCE)]
    assert roots(near) == roots(zip(*near_dedup.bucket_links(keys, nodes, prints)[1:]))


def test_candidates_come_from_the_keys_alone(spark, monkeypatch):
    """Near copies go by the tables as given, and stay where a single table is all that looks for them."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(40):
        words = [f"w{g}x{i}" for i in range(104)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:86], *(f"v{g}x{x}" for x in rng.integers(0, 10**6, 1))]))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    left = lambda: sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect())
    grams = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for _, t in rows]
    far = [2 * g + 1 for g in range(40) if 5 * len(grams[2 * g] & grams[2 * g + 1]) < 4 * len(grams[2 * g] | grams[2 * g + 1])]
    far = {*far, *range(0, 80, 2)}
    assert left() == sorted(far)
    monkeypatch.setattr(near_dedup, "TABLES", 1)
    assert len(left()) > len(far)
