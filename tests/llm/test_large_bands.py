"""Bands of texts that are too large for one task: every pair at the similarity is linked, and the rows dealt grow with the band."""

import numpy as np
import pytest

from stratalog.llm import near_dedup


def _copies(rng, n, words=60, groups=1):
    """Texts that differ in one place from the base of their group; bases of groups share half of their words."""
    shared = [f"s{x}" for x in rng.integers(0, 9000, words // 2)]
    rows = []
    for g in range(groups):
        base = shared + [f"g{g}x{x}" for x in rng.integers(0, 9000, words - words // 2)]
        for i in range(n):
            w = list(base)
            w[int(rng.integers(0, len(w)))] = f"c{g}x{i}"
            rows.append((len(rows), " ".join(w)))
    return rows


def _components(rows):
    grams = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


@pytest.mark.parametrize("groups", [1, 3])
@pytest.mark.parametrize("pivots", [1, 8])
def test_bands_beyond_a_task_by_brute_force(spark, monkeypatch, groups, pivots):
    monkeypatch.setattr(near_dedup, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    rows = _copies(np.random.default_rng(groups), 40, groups=groups)
    got = sorted(r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == _components(rows)


def test_rows_dealt_grow_with_the_band(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BYTES", 16000)
    dealt = []
    compared = near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda d, sets: dealt.append(d.count()) or compared(d, sets))
    per_row = []
    for n in (100, 400):
        dealt.clear()
        rows = _copies(np.random.default_rng(9), n, words=80)
        assert [r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()] == [0]
        per_row.append(sum(dealt) / n)
    assert per_row[1] < 1.5 * per_row[0]


@pytest.mark.parametrize("most", [4000, 80000])
def test_one_band_of_several_groups(spark, monkeypatch, most):
    """Whether what lies outside the largest component fits in a task or not, all groups come out whole and apart."""
    monkeypatch.setattr(near_dedup, "BUCKET_BYTES", most)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    rows = _copies(np.random.default_rng(4), 40, groups=3)
    sets = [near_dedup.shingle_set(t.encode()) for _, t in rows]
    table = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for (i, _), s in zip(rows, sets)], "node bigint, n bigint, hashes binary")
    large = spark.createDataFrame([(7, i, 9) for i, _ in rows], "key bigint, node bigint, blocks bigint")
    small = spark.createDataFrame([], "deal bigint, node bigint")
    roots = near_dedup.connected_components(near_dedup._links_of_large(small, large, table)).collect()
    assert sorted({i for i, _ in rows} - {r.node for r in roots}) == _components(rows)


def test_many_texts_without_words_or_of_few(spark, monkeypatch):
    """Members cost something even where they have no hash, so that texts without words are dealt in blocks too."""
    monkeypatch.setattr(near_dedup, "BUCKET_BYTES", 4000)
    dealt = []
    large = near_dedup._links_of_large
    monkeypatch.setattr(near_dedup, "_links_of_large", lambda small, rows, sets: dealt.append(rows.select("key").distinct().count()) or large(small, rows, sets))
    rows = [(i, " " * (i + 1)) for i in range(90)] + [(100 + i, "one" + " " * (i + 1) + "two") for i in range(90)] + [(300, None), (301, "one three")]
    got = sorted(r.doc_id for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == [0, 100, 301] and dealt and dealt[0] >= 2
