"""Suffix automata against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import condense, substrings
from stratalog.plans import queries as plans
from stratalog.plans import tables as t

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_automata_hold_exactly_the_substrings(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("ab" if seed % 2 else "abcdefé中") for _ in range(r.randint(0, 30))) for _ in range(12)]
    automaton = substrings.SuffixAutomaton()
    for x in texts:
        automaton.add(x)
    asked = ["".join(r.choice("abcé") for _ in range(r.randint(0, 6))) for _ in range(300)] + [x[i:j] for x in texts for i, j in [(0, 3), (2, 9), (0, len(x))]]
    for x in asked:
        assert automaton.holds(x) == any(x in y for y in texts)


def test_states_and_steps_grow_with_the_text():
    for n in (500, 2000, 8000):
        automaton = substrings.SuffixAutomaton()
        for _ in range(4):
            automaton.add("abcabd" * (n // 24))
            automaton.add("".join(random.Random(n).choice("ab") for _ in range(n // 4)))
        assert len(automaton.next) <= 4 * n and sum(map(len, automaton.next)) <= 6 * n  # 2n characters in all


@pytest.mark.parametrize("bounds", [(200_000, 200_000), (40, 7)])
def test_within_by_brute_force(spark, bounds):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab c") for _ in range(n))
    texts = [(r.choice([1, 1, 1, 2, None]), word(r.randint(0, 25))) for _ in range(60)] + [(1, None), (3, "abc" * 30)]
    needles = [(r.choice([1, 1, 2, 3, 4, None]), i, word(r.randint(0, 5))) for i in range(150)] + [(1, 200, None), (3, 201, "cab" * 20), (3, 202, "")]
    got = substrings.within(spark.createDataFrame(needles, "k int, id int, text string"), spark.createDataFrame(texts, "k int, text string"), ["k"], *bounds)
    want = sorted(i for k, i, x in needles if x is not None and any(k is not None and k == kk and y is not None and x in y for kk, y in texts))
    assert sorted(x.id for x in got.collect()) == want and len(want) > 20


def test_nothing_to_search(spark):
    none, some = spark.createDataFrame([], "k int, text string"), spark.createDataFrame([(1, 1, "a")], "k int, id int, text string")
    assert substrings.within(some, none, ["k"]).collect() == []
    assert substrings.within(spark.createDataFrame([], "k int, id int, text string"), some.select("k", "text"), ["k"]).collect() == []


def test_evidence_as_before(spark, tmp_path):
    rows, found, _ = condense.condense(t.seg_doc(spark, SF).union(spark.createDataFrame([(-1, i, i * 30.0, x) for i, x in enumerate(["别写错边界", "错边", "chat", "错边界，", "注意 loop", "loop"])], "video_id bigint, seq bigint, start double, text string")))
    got = sorted(tuple(r) for r in condense.evidence(rows, found).collect())
    known = found.groupBy("video_id").agg(F.collect_set("text").alias("traps"))
    lines = rows.where("kind = 'line'").join(known, "video_id", "left").collect()
    flagged = {(r.video_id, r.seq) for r in condense.evidence(rows, found.where("false")).collect()}
    want = sorted((r.video_id, r.seq, r.t_from, r.text) for r in lines if (r.video_id, r.seq) in flagged or any(r.text in x for x in r.traps or []))
    assert got == want and len(got) > len(flagged)
