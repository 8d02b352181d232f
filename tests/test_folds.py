"""Folds of keys that are cut at restart points give the rows of the whole fold."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import folds
from stratalog.plans import queries as plans
from stratalog.plans import tables as t

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in as many ranges as large ones."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _hot_events(spark):
    """Events of which nine tenths are one user's."""
    rows = t.seg_evt(spark, SF)
    return rows.withColumn("video_id", F.when(F.pmod(F.xxhash64("seq"), F.lit(10)) > 0, F.lit(0)).otherwise(F.col("video_id").cast("int"))).withColumn("end", F.col("start") + (F.col("end") - F.col("start")) * 0.3)


def test_overlaps_by_islands(spark, monkeypatch):
    rows = _hot_events(spark).cache()
    whole = _rows(folds.drop_overlaps(rows))
    cut = folds.overlap_islands(rows.where("video_id = 0").select("video_id", "seq", "start", "end", "text"))
    monkeypatch.setattr(folds, "KEY_ROWS", 50)
    assert _rows(folds.drop_overlaps(rows)) == whole and len(whole) < rows.count()
    sizes = [r["count"] for r in cut.groupBy("island").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 0.2 * sum(sizes)
    # The fold of the hot key isn't one task's: its islands lie in all partitions.
    spread = cut.repartition(4, "video_id", "island").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 4


def test_ranges_hold_a_share_of_the_hot_key(spark):
    rows = _hot_events(spark).where("video_id = 0").select("video_id", "seq", "start", "end", "text")
    sizes = [r["count"] for r in folds._ranged(rows, ["start", "seq"]).groupBy("range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


@pytest.mark.parametrize("window", [None, 6])
def test_heads_by_islands(spark, monkeypatch, window):
    r = random.Random(5)
    rows, at = [], 0
    for video in (1, 1, 1, 1, 1, 1, 2, None):
        tail = ""
        for _ in range(120):
            kind = r.random()
            body = "".join(r.choice("abcd 中文") for _ in range(r.choice([0, 2, 5, 12, 40, 80])))
            text = tail[-r.randint(0, 30) :] + body if kind < 0.5 else body if kind < 0.9 else None
            rows.append((video, at, float(at), text))
            at += 1
            tail = (text or tail).strip()
    df = spark.createDataFrame(rows, "video_id int, seq bigint, start double, text string").repartition(3)
    key = lambda x: sorted(map(repr, x.collect()))
    whole = key(folds.drop_repeated_heads(df, window))
    monkeypatch.setattr(folds, "KEY_ROWS", 100)
    assert key(folds.drop_repeated_heads(df, window)) == whole
    islands = folds.head_islands(df.where("video_id = 1"), window).select("island").distinct().count()
    assert islands > 20


def test_queries_by_islands(spark, monkeypatch):
    want = {q: _rows(plans.QUERIES[q](spark, SF)) for q in ("tl_5_drop_overlaps", "f_2_drop_repeated_heads")}
    monkeypatch.setattr(folds, "KEY_ROWS", 5)
    for q, rows in want.items():
        assert _rows(plans.QUERIES[q](spark, SF)) == rows


def test_odd_segments(spark, monkeypatch):
    monkeypatch.setattr(folds, "KEY_ROWS", 1)
    schema = "video_id int, seq bigint, start double, end double, text string"
    assert folds.drop_overlaps(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 0, 0.0, 10.0, "a"), (1, 1, None, 5.0, "b"), (1, 2, 5.0, None, "c"), (1, 3, 6.0, 2.0, "d"), (1, 4, 10.0, 12.0, None), (None, 5, 0.0, 9.0, "e"), (None, 6, 0.0, 9.0, "ee")]
    got = _rows(folds.drop_overlaps(spark.createDataFrame(rows, schema)).select("seq"))
    assert got == [(0,), (1,), (2,), (3,), (4,), (6,)]
