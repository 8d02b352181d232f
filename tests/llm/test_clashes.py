"""Columns of documents that have the names of results, tables left behind, and groups of equal rows."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import common, sharding

SF = "/root/testdata/sf0.001"
CLASHES = ("score", "predicted", "items", "n_words", "size", "copy", "shard", "slot", "source_size", "target", "Text_crc32", "size_", "contaminated", "key", "node", "number")


def test_pipeline_leaves_columns_as_they_were(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    own.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        os.symlink(f"{SF}/{name}.parquet", str(tmp_path / f"{name}.parquet"))
    plain = corpus_pipeline.run(spark, SF).collect()
    rows = corpus_pipeline.run(spark, str(tmp_path))
    renamed = {"size": "size__", "copy": "copy_", "shard": "shard_", "slot": "slot_", "Text_crc32": "Text_crc32_"}
    assert set(rows.columns) == {*docs.columns, *corpus_pipeline.SHARD_COLUMNS, *(renamed.get(c, c) for c in CLASHES)}
    got = rows.collect()
    assert all(r[renamed.get(c, c)] == f"{c}-{r.doc_id}" for r in got for c in CLASHES)
    key = lambda rs: sorted((r.doc_id, r.copy, r.shard, r.slot, r.size, r.text) for r in rs)
    assert key(got) == key(plain) and got


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASHES})
    got = stage(spark, own, SF)
    assert got.columns == own.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs, SF).collect())


def test_scratch_deletes_what_was_written(spark):
    root = f"{common.shared_dir(spark)}/stratalog"
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    with common.scratch() as written:
        first = common.materialize(spark.range(3), "first")
        kept = written.keep(common.materialize(first.selectExpr("id + 1 AS id"), "kept"))
    assert [x.split("-")[0] for x in set(os.listdir(root)) - before] == ["kept"] and kept.count() == 3
    common.discard(kept)


def test_equal_rows_spread_over_parts_and_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 100)
    monkeypatch.setattr(sharding, "BROADCAST_ENTRIES", 1)
    rows = spark.range(0, 4000, 1, 7).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one text' AS text").unionByName(spark.range(500).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text"))
    seen = []
    whole = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, label: seen.append(whole(df, label)) or seen[-1])
    out = sharding.shard(rows, shards=8).collect()
    dealt = seen[-1]
    sizes = Counter(r.shard for r in out)
    assert sum(sizes.values()) == 4500 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert sorted(r.copy for r in out if r.doc_id is None) == list(range(4000))
    slices = {(r.shard, r.slice): r["count"] for r in dealt.groupBy("shard", "slice").count().collect()}
    assert len(slices) == 16 and max(slices.values()) < 2 * min(slices.values())
    again = sharding.shard(rows.repartition(5), shards=8).collect()
    key = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.copy, r.shard, r.slot) for r in rs)
    assert key(again) == key(out)
