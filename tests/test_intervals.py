"""Dyadic covers and joins against plain comparisons of all pairs."""

import math
import random
import re

from pyspark.sql import functions as F

from stratalog.operators import intervals, timeline
from stratalog.plans import queries

SF = "/root/testdata/sf0.001"


def test_covers_are_exact_and_short(spark):
    r = random.Random(3)
    pairs = [(a, a + r.choice([0, 1, 2, 3, 7, 64, 1000, 10**9, 2**50])) for a in [0, 1, 5, 64, -1, -7, -64, 10**12] for _ in range(8)] + [(5, 4), (0, 2**60)]
    rows = spark.createDataFrame(pairs, "low bigint, high bigint").withColumn("nodes", intervals.cover(F.col("low"), F.col("high"))).collect()
    for x in rows:
        parts = sorted((n.node << n.level, (n.node + 1) << n.level) for n in x.nodes)
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))  # one behind the other, so none twice
        if x.high < x.low:
            assert not parts
        else:
            assert (parts[0][0], parts[-1][1]) == (x.low, x.high + 1)
            assert len(parts) <= max(1, 2 * math.log2(x.high + 1 - x.low))


def test_points_lie_in_one_node_a_level(spark):
    rows = spark.range(-40, 40).select("id", intervals.nodes_of(F.col("id"), 5).alias("n")).collect()
    assert all([(n.level, n.node) for n in x.n] == [(k, x.id >> k) for k in range(6)] for x in rows)


def test_overlaps_by_brute_force(spark):
    r = random.Random(8)
    side = lambda k: [(r.choice(["a", "b", None]), i, s, s + r.choice([-3.0, 0.0, 0.25, 1.0, 5.0, 300.0])) for i, s in enumerate(r.choice([0.0, 1.0, 2.5, 7.25, 100.0, -4.0]) + r.randint(0, 40) for _ in range(k))] + [("a", 90, None, 1.0), ("a", 91, 1.0, None)]
    a, b = side(60), side(50)
    got = intervals.overlapping(spark.createDataFrame(a, "k string, i int, s double, e double"), ("s", "e"), spark.createDataFrame(b, "k string, j int, t double, u double"), ("t", "u"), ["k"], 2.0)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and None not in (*x[2:], *y[2:]) and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((x.i, x.j) for x in got.collect()) == want and want


def test_a_long_chapter_over_short_chunks_is_dealt_by_its_logarithm(spark):
    chunks = timeline.plan_chunks(spark.createDataFrame([("v", 50_000.0)], "video_id string, duration double"), 1.0)
    chapters = spark.createDataFrame([("v", 0, 0.0, 50_000.0, "all"), ("v", 1, 10.5, 11.5, "short"), ("v", 2, 7.0, 7.0, "empty")], "video_id string, ord int, start double, end double, title string")
    assert chapters.select(F.size(intervals.cover(F.floor("start"), F.floor("end"))).alias("n")).agg(F.max("n")).first()[0] <= 2 * math.log2(50_001)
    got = timeline.chapter_overlaps(chunks, chapters, 1.0)
    counts = {r.n: r["count"] for r in got.groupBy(F.size("titles").alias("n")).count().collect()}
    assert counts == {1: 49_998, 2: 2} and got.where("size(titles) = 2").agg(F.min("chunk_id"), F.max("chunk_id")).first() == (10, 11)


def test_no_intervals(spark):
    none = spark.createDataFrame([], "k string, i int, s double, e double")
    other = spark.createDataFrame([("a", 1, 0.0, 1.0)], "k string, j int, t double, u double")
    assert intervals.overlapping(none, ("s", "e"), other, ("t", "u"), ["k"], 1.0).collect() == []
    assert intervals.overlapping(other, ("t", "u"), none, ("s", "e"), ["k"], 1.0).collect() == []


def test_rows_of_small_keys_are_not_dealt(spark):
    """Beside a key with many rows, small ones meet on the key: no row of theirs is repeated. Results are the same."""
    r = random.Random(11)
    rows = [("many", i, float(s := r.randint(0, 5000)), float(s + r.choice([-1, 0, 3, 900]))) for i in range(700)]
    rows += [(f"k{i % 40}", i, float(s := r.randint(0, 5000)), float(s + r.choice([-1, 0, 3, 900]))) for i in range(700, 1500)]
    make = lambda rows, names: spark.createDataFrame(rows, names)
    small = [x for x in rows if x[0] != "many"]
    for some in (rows, small):
        a, b = make(some, "k string, i int, s double, e double"), make(some, "k string, j int, t double, u double")
        got = intervals.overlapping(a, ("s", "e"), b, ("t", "u"), ["k"], 1.0)
        by = {}
        for x in some:
            by.setdefault(x[0], []).append(x)
        want = sorted((x[1], y[1]) for own in by.values() for x in own for y in own if x[2] <= y[3] and y[2] <= x[3])
        assert sorted((x.i, x.j) for x in got.collect()) == want
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_chapters_of_usual_videos_meet_their_chunks_without_dealing(spark):
    """Chunks and chapters of a video are few, so no chunk is repeated for each level of a long chapter's cover."""
    chunks = timeline.plan_chunks(spark.createDataFrame([("v", 100.0), ("w", 35.0)], "video_id string, duration double"), 10.0)
    chapters = [("v", 0, 0.0, 100.0, "all"), ("v", 1, 15.0, 30.0, "mid"), ("w", 0, 5.0, 5.0, "empty"), ("w", 1, 30.0, 99.0, "end"), ("x", 0, 0.0, 9.0, "none")]
    got = timeline.chapter_overlaps(chunks, spark.createDataFrame(chapters, "video_id string, ord int, start double, end double, title string"), 10.0)
    want = {(v, c): [t for u, _, s, e, t in chapters if u == v and s < min(d, 10.0 * (c + 1)) and e > 10.0 * c and e > s] for v, d, n in (("v", 100.0, 10), ("w", 35.0, 4)) for c in range(n)}
    assert {(x.video_id, x.chunk_id): x.titles for x in got.collect()} == want
    assert "__at" not in got._jdf.queryExecution().analyzed().toString()


def test_chunks_of_many_videos_are_not_broadcast(spark):
    """Spark takes 120 chunks for the one video that they were exploded from; they must not go to the driver as small."""
    got = queries.tl_3_chapter_overlaps(spark, SF)
    assert got.count() and len(got.collect()) == got.count()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    sides = [x for x in re.split(r"BroadcastExchange", plan)[1:]]
    assert "Generate explode" in plan and not any("Generate explode" in _below(x) for x in sides)


def _below(text):
    """Of a plan's text behind a node's name, the node's children: the lines that are indented further than the first one."""
    lines = text.splitlines()[1:]
    depth = lambda x: len(re.match(r"[ :+|-]*", x).group())
    inner = []
    for x in lines:
        if inner and depth(x) < depth(inner[0]):
            break
        inner.append(x)
    return "\n".join(inner)
