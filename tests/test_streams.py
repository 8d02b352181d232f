"""Streams against the same operators over tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import folds
from stratalog.plans import tables as t
from stratalog.streaming import overlaps

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def _run(spark, stream, tmp_path, name):
    out, cp = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out) if os.path.exists(out) else None


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_give_the_fold(spark, rocks, tmp_path, seed):
    rows = t.seg_evt(spark, SF).where("video_id < 6").withColumn("ts", F.timestamp_micros(F.col("start").cast("long") + 10**12)).collect()
    random.Random(seed).shuffle(rows)
    schema = "video_id bigint, seq bigint, start double, end double, text string, ts timestamp"
    far = (10**6, 10**9, 1e16, 1e16, "end", None)
    for i in range(3):  # three files, a batch each, then one far ahead that moves the watermark
        part = [(r.video_id, r.seq, r.start, r.end, r.text, r.ts) for r in rows[i::3]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([far], schema).withColumn("ts", F.timestamp_micros(F.lit(10**14)))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(spark, overlaps.drop_overlaps_stream(source, unit_s=1e-6, late="60 days"), tmp_path, "fold")
    want = folds.drop_overlaps(spark.createDataFrame([tuple(r) for r in rows], schema))
    key = lambda df: sorted(map(tuple, df.where("video_id < 1000000").select("video_id", "seq", "start", "end", "text").collect()))
    assert key(got) == key(want) and len(key(want)) < len(rows)
