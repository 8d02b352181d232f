"""Queries over fixtures against their SQL, and what has no query: streams, writers, providers."""

import io
import json
import random
import re
import wave

import duckdb
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalog.operators import condense, folds, links, timeline
from stratalog.plans import cases as fixtures
from stratalog.plans import queries, vault_jobs
from stratalog.sources import media, notes
from stratalog.streaming import incremental

SF = "/root/testdata/sf0.001"
OWN = [name for name, f in queries.QUERIES.items() if f.__module__ == fixtures.__name__]
TABLES = ("part", "documents", "nation", "events", "conversations", "pages", "orders", "lineitem", "benchmark")
MENDED = ["f_2_drop_repeated_heads", "cd_1_condense_stats", "jn_11_recall", "jn_6_resolve_names", "lk_3_link_plan", "fn_4_strip_timestamps", "gate_1_to_8_features", "gate_9_scores", "src_15_batch_gate", "ag_1_signals"]
CAP = "video_id string, chunk_id int, seq bigint, start double, text string"


def _rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", OWN + MENDED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, SF)
    cols = sorted(rows.columns)
    want = con.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(_rounded, rows.select(cols).collect()), key=repr) == sorted(map(_rounded, want), key=repr) and want


@pytest.mark.parametrize("name", fixtures.ALONE)
def test_cases_without_a_table(spark, name):
    sql, f = fixtures.ALONE[name]
    rows = f(spark, SF)
    cols = sorted(rows.columns)
    want = duckdb.connect().sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, rows.select(cols).collect()), key=repr) == sorted(want, key=repr) and want and name not in queries.QUERIES


def test_every_case_has_sql_and_grows_with_the_table(spark):
    assert len(OWN) > 50 and set(OWN) <= queries.ORACLE_SQL.keys()
    words = {r.text for r in fixtures.made(spark, SF, [("v", "§ ¤")], "video_id string, text string").collect()}
    assert len(words) == spark.read.parquet(f"{SF}/documents.parquet").count()


def _step_by_step(text, plan):
    """A term at a time, each by a search of its own in what is still free."""
    parts, linked = links.pieces(text), []
    for step in plan:
        term = step["term"]
        quoted = re.escape(term)
        pattern = re.compile(rf"\b{quoted}\b", re.IGNORECASE) if term.isascii() else re.compile(rf"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])")
        places = [(i, m) for i, (kind, chunk) in enumerate(parts) if kind == "text" and (m := pattern.search(chunk))]
        if term not in linked and places:
            i, m = places[0]
            chunk, target = parts[i][1], step["target"].removesuffix(".md")
            link = f"[[{m.group()}]]" if target == m.group() and "/" not in target else f"[[{target}|{m.group()}]]"
            parts[i : i + 1] = [p for p in (("text", chunk[: m.start()]), ("link", link), ("text", chunk[m.end() :])) if p[1]]
            linked.append(term)
    return "".join(c for _, c in parts), linked


def test_links_by_brute_force():
    rng = random.Random(1)
    bits = ["dp", " ", "递归", "c++", "\n", "`", "$", "[[", "]]", "DP", "x", "_", "树", "ſ", "İ", "K", "is", "# ", "```\n", "k", "9", ".", "("]
    terms = ["dp", "递归", "c++", "is", "k", "树", "dp递", "x x", "递归树", "i", "s k"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        plan = [{"term": x, "target": rng.choice([x, f"a/{x}.md", f"{x}.md"])} for x in rng.sample(terms, 5)]
        assert links.link_text(text, plan) == _step_by_step(text, plan)
        assert "".join(c for _, c in links.pieces(text)) == text


def test_a_plan_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(links, "PLAN_BYTES", 100)
    terms = spark.createDataFrame([(i, f"term{i}") for i in range(9)], "ord int, term string")
    with pytest.raises(ValueError, match="bounded"):
        links.first_mentions(spark.createDataFrame([("n", "term1")], "note_id string, value string"), terms)


def test_merge_raises_for_a_missing_chunk(spark):
    plan = spark.createDataFrame(fixtures.PLAN, fixtures.PLAN_SCHEMA)
    results = spark.createDataFrame(fixtures.RESULTS, fixtures.RESULT_SCHEMA)
    assert timeline.merge_chunks(timeline.finished_chunks(plan, results), results).count() == 4
    assert timeline.merge_chunks(plan, results, []).count() == 0
    with pytest.raises(PySparkException, match="chunk 2 of v has no result"):
        timeline.merge_chunks(plan, results).collect()


def _lecture(video, chunk, first, n):
    words = ["你好", "循环里别写错", "dp[i] 转移", "嗯", "注意边界", "好的"]
    return [(video, chunk, first + i, 40.0 * (first + i), words[(first + i) % 6]) for i in range(n)]


def test_chunks_of_a_stream(spark, tmp_path):
    """Two videos with the same chunk numbers, a chunk that comes in two batches, and a replay: as the batch."""
    first = _lecture("a", 0, 0, 6) + _lecture("a", 1, 6, 2)
    later = _lecture("b", 0, 0, 5) + _lecture("a", 1, 8, 4)
    src, out, again = (str(tmp_path / n) for n in ("in", "out", "cp"))
    whole = incremental.condensed_chunks(spark.createDataFrame(first + later, CAP).select(incremental.run_key(F.col("video_id"), F.lit("m")).alias("run_key"), "*"))
    want = sorted(map(tuple, whole.select("run_key", "video_id", "chunk_id", "seq", "kind", "text").collect()), key=repr)
    for part in (first, later, later):
        spark.createDataFrame(part, CAP).coalesce(1).write.mode("append").parquet(src)
        incremental.condense_chunks(spark.readStream.schema(CAP).parquet(src), out, again, F.lit("m")).awaitTermination()
    got = spark.read.parquet(out).select("run_key", "video_id", "chunk_id", "seq", "kind", "text").collect()
    assert sorted(map(tuple, got), key=repr) == want and len({r.run_key for r in got}) == 2
    plan = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1)], "video_id string, chunk_id int")
    assert [(r.video_id, r.chunk_id) for r in incremental.pending_chunks(plan, out, F.lit("m")).collect()] == [("b", 1)]
    assert incremental.pending_chunks(plan, out, F.lit("other")).count() == 4 and incremental.pending_chunks(plan, str(tmp_path / "none"), F.lit("m")).count() == 4


def test_heads_of_a_chinese_stream(spark, tmp_path):
    rows = spark.createDataFrame(fixtures.FOLDED, fixtures.LECTURE_SCHEMA)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.keep_new_heads(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("video_id", "seq", "text").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(folds.drop_repeated_heads(rows))


def test_selection_is_no_part_of_the_whole(spark):
    lecture = spark.createDataFrame(fixtures.LECTURE, fixtures.LECTURE_SCHEMA)
    whole = {tuple(r) for r in condense.condense(lecture)[0].select("video_id", "seq", "kind").collect()}
    part = {tuple(r) for r in condense.condense_selected(lecture, [0], 90)[0].select("video_id", "seq", "kind").collect()}
    assert ("v", 0, "fold") in whole and ("v", 0, "line") in part and condense.condense_selected(lecture, [], 90)[0].count() == 0


def test_payload_writers(spark, tmp_path):
    rows = spark.createDataFrame(fixtures.PAYLOADS, fixtures.PAYLOAD)
    assert notes.base_name("x/y.json") == notes.base_name("x/y.txt") == "x/y" and notes.base_name("x/y.z") == "x/y.z"
    notes.write_payloads(rows, str(tmp_path / "out.json"), evidence=True)
    assert {r.text for r in spark.read.json(str(tmp_path / "out_txt")).collect()} == {"ev", None}
    kept = [json.loads(r.payload) for r in spark.read.json(str(tmp_path / "out_archive")).collect()]
    assert {r["video_id"]: r.get("content") for r in kept} == {"v": "raw", "w": None}
    notes.write_payloads(rows, str(tmp_path / "other"), plain=False)
    assert not (tmp_path / "other_txt").exists() and len(spark.read.json(str(tmp_path / "other_json")).collect()) == 2


def test_results_of_other_videos_stay(spark, tmp_path):
    schema = "run_key string, video_id string, chunk_id int, text string"
    for rows in ([("k", "a", 0, "x")], [("k", "b", 0, "y")], [("k", "b", 0, "z")]):
        notes.write_results(spark.createDataFrame(rows, schema), str(tmp_path))
    assert {(r.video_id, r.text) for r in spark.read.parquet(str(tmp_path)).collect()} == {("a", "x"), ("b", "z")}


def test_link_audit_is_written(spark, tmp_path):
    for name, text in (("vault/graph.md", "x"), ("input/me.md", "a graph")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "terms").write_text(json.dumps([{"term": "graph"}, {"term": "lost", "target": "no.md"}, {"term": "x"}]))
    at = {n: str(tmp_path / n) for n in ("vault", "index", "input", "terms", "output", "audit")}
    assert vault_jobs.main(["all", *(y for n in at for y in (f"--{n}", at[n]))], spark) == 0
    got = spark.read.json(at["audit"]).first()
    assert (got.terms_input, got.skipped_invalid, got.strong_links, got.skipped_not_in_text, got.index_notes, got.weak_links_mode) == (3, 1, 1, 1, 1, "footer")
    assert got.linked_terms == ["graph"] and got.invalid_targets[0].target == "no.md" and got.current_note == "me.md"


def test_metadata_provider(spark):
    requests = spark.createDataFrame([("bilibili", "1", "BV1x_p2"), ("bilibili", "2", "BV2")], "platform string, video_id string, source string")
    stored = spark.createDataFrame([("bilibili", "2", "known", None, 1.0, None, None, "{}", None, [])], f"platform string, video_id string, {media.METADATA}")

    def ask(batches):
        for b in batches:
            yield pd.DataFrame({"platform": b.platform, "video_id": b.video_id, "title": b.url, "author": "", "duration": 2.0, "description": "", "webpage_url": b.url, "subtitles": "{}", "automatic_captions": None, "chapters": [[]] * len(b)})

    assert {(r.video_id, r.title) for r in media.fetch_metadata(requests, stored, ask).collect()} == {("2", "known"), ("1", "https://www.bilibili.com/video/BV1x?p=2")}


def test_wav_seconds(spark):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(bytes(2 * 24000))
    rows = spark.createDataFrame([(0, bytearray(raw.getvalue())), (1, bytearray(b"RIFF")), (2, None)], "i int, content binary")
    assert [r[0] for r in rows.orderBy("i").select(media.wav_seconds("content")).collect()] == [1.5, None, None]
