import json

import pytest
from pyspark.sql import functions as F

from stratalog.operators import condense, folds, gate, links, quotes, signals, timeline, vault
from stratalog.sources import captions, notes
from stratalog.streaming import incremental

SEG = "video_id string, seq bigint, start double, end double, text string"
CAP = "video_id string, seq bigint, start double, text string"


def test_signals(spark):
    df = spark.createDataFrame([("for for dp",), ("dp数组",), ("特别",), ("",), (None,)], "t string").select(signals.analyze(F.col("t")).alias("s")).select("s.*")
    a, b, c, d, e = df.collect()
    assert (a.keywords, a.n_hits, a.density) == (["for", "dp"], 3, 1.0)
    assert b.keywords == ["数组"]
    assert c.has_warning and not a.has_warning
    assert d == e and d.keywords == [] and d.density == 0.0


def test_plan_chunks_tiles(spark):
    rows = timeline.plan_chunks(spark.createDataFrame([("a", 1200.0), ("b", 1201.5), ("c", 0.0)], "video_id string, duration double"), 600).orderBy("video_id", "chunk_id").collect()
    assert [(r.video_id, r.chunk_id, r.t0, r.t1) for r in rows] == [("a", 0, 0.0, 600.0), ("a", 1, 600.0, 1200.0), ("b", 0, 0.0, 600.0), ("b", 1, 600.0, 1200.0), ("b", 2, 1200.0, 1201.5)]


def test_chapter_that_ends_at_the_chunk_start_does_not_match(spark):
    chunks = spark.createDataFrame([("a", 0, 0.0, 600.0), ("a", 1, 600.0, 1200.0)], "video_id string, chunk_id int, t0 double, t1 double")
    chapters = spark.createDataFrame([("a", 0, 0.0, 600.0, "x"), ("a", 1, 600.0, 700.0, "y")], "video_id string, ord int, start double, end double, title string")
    assert [r.titles for r in timeline.chapter_overlaps(chunks, chapters, 600).orderBy("chunk_id").collect()] == [["x"], ["y"]]


def test_drop_overlaps(spark):
    rows = [("a", 0, 0.0, 10.0, "abcdef"), ("a", 1, 1.0, 9.0, "bcd"), ("b", 0, 0.0, 10.0, "x"), ("b", 1, 3.0, 13.0, "y")]
    df = spark.createDataFrame(rows, SEG)
    assert [r.text for r in folds.drop_overlaps(df).orderBy("video_id", "seq").collect()] == ["bcd", "x", "y"]
    assert [r.text for r in folds.drop_overlaps(df, strict=True).orderBy("video_id", "seq").collect()] == ["abcdef", "x", "y"]


def test_slides_cover_whole_texts(spark, tmp_path):
    from stratalog.plans import queries as plans

    texts = {0: None, 1: "", 2: "abc", 3: "".join(chr(97 + i * 7 % 23) + str(i) for i in range(8)), 4: " ".join(str(i * i) for i in range(900)), 5: "x" * 427, 6: "".join(f"{i:03d}" for i in range(142)), 7: "".join(f"{i:03d}" for i in range(9))}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for key, text in texts.items():
        kept, k = "", 0
        while True:
            part = (text or "")[20 * k : 20 * k + 26].strip()
            same = next((n for n in range(min(24, len(kept), len(part)), 2, -1) if kept.endswith(part[:n])), 0)
            part = part[same:].strip()
            if part:
                want.append((key, k, part))
                kept = part
            if 20 * k + 26 >= len(text or ""):
                break
            k += 1
    got = sorted((r.video_id, r.seq, r.text) for r in plans.QUERIES["f_2_drop_repeated_heads"](spark, str(tmp_path)).collect())
    assert got == sorted(want) and "".join(t for key, _, t in got if key == 6) == texts[6]


def test_drop_repeated_heads(spark):
    rows = [("a", 0, 0.0, "abcde"), ("a", 1, 1.0, "cdefg"), ("b", 0, 0.0, "abc"), ("b", 1, 1.0, "bcd"), ("c", 0, 0.0, "abcd"), ("c", 1, 1.0, "bcd"), ("c", 2, 2.0, "bcdx")]
    got = folds.drop_repeated_heads(spark.createDataFrame(rows, CAP).repartition(3)).orderBy("video_id", "seq").collect()
    assert [(r.video_id, r.seq, r.text) for r in got] == [("a", 0, "abcde"), ("a", 1, "fg"), ("b", 0, "abc"), ("b", 1, "bcd"), ("c", 0, "abcd"), ("c", 2, "x")]


def test_condense(spark):
    text = ["你好", "今天，天气", "嗯嗯", "然后然后写dp[i]", "麦克风好", "注意麦克风，扣1", "a", "b"]
    df = spark.createDataFrame([("v", i, 45.0 * i, t) for i, t in enumerate(text)], CAP)
    rows, found, stats = condense.condense(df)
    assert [(r.kind, r.t_from, r.text) for r in rows.orderBy("seq").collect()] == [("fold", 0.0, None), ("line", 135.0, "然后写dp[i]"), ("line", 225.0, "注意麦克风，"), ("line", 270.0, "a"), ("line", 315.0, "b")]
    assert [(r.seq, r["text"]) for r in found.collect()] == [(5, "注意麦克风，")]
    assert condense.render(rows).orderBy("seq").first().line == "[00:00:00 - 00:01:30 闲聊互动/休息闲谈，已自动折叠]"
    s = stats.first()
    assert (s.folds, s.traps_count, s.raw_chars) == (1, 1, sum(map(len, text)))
    assert [r.text for r in condense.evidence(rows, found).orderBy("seq").collect()] == ["然后写dp[i]", "注意麦克风，"]


def test_captions(spark):
    srt = "1\n00:01:02,000 --> 00:01:04,000\n<i>Hi</i> &amp; you\n2024\n\n2\n00:01:05,000 --> 00:01:06,000\nbye"
    rows = captions.parse_blocks(spark.createDataFrame([("v", srt)], "video_id string, value string")).orderBy("ord").collect()
    assert [(r.ts, r.text) for r in rows] == [("00:01:02", "Hi & you"), ("00:01:02", "2024"), ("00:01:05", "bye")]
    js = '{"body":[{"from":61.5,"content":" a &lt; b "},{"from":70,"content":" "}]}'
    assert [(r.ts, r.text) for r in captions.parse_json(spark.createDataFrame([("v", js), ("w", "{bad")], "video_id string, value string")).collect()] == [("00:01:01", "a < b")]


def test_tracks(spark):
    rows = [("a", 0, "en", False), ("a", 1, "en-orig", True), ("b", 0, "en-GB", False), ("b", 1, "en-US", False), ("b", 2, "en", True), ("c", 0, "zh-Hant", False), ("c", 1, "zh-CN", False), ("d", 0, "fr", False)]
    got = captions.pick_track(spark.createDataFrame(rows, "video_id string, ord int, lang string, is_auto boolean"), "en").orderBy("video_id").collect()
    assert [(r.video_id, r.lang, r.is_auto) for r in got] == [("a", "en", False), ("b", "en", True), ("c", "zh-CN", False)]


NOTE = '---\ntitle: x\n---\n> [!quote] 🎙️ 原片教学锚点（老师）\n> "hello, wonderful world of graphs"\n> —— [00:10 - 00:20]\n'


@pytest.mark.parametrize("archive,errors", [("[00:00:05] say hello wonderful\n[00:00:09] world of graphs", []), ("[00:00:05] nothing of that kind here", ["unsupported"]), ("[00:05 --> 00:15] hello um wonderful er world\n[00:15 --> 00:25] of the graphs", [])])
def test_anchor_provenance(spark, archive, errors):
    df = spark.createDataFrame([("n", NOTE)], "note_id string, value string")
    got = quotes.check_anchors(df, spark.createDataFrame([("n", archive)], "archive_id string, value string")).first()
    assert (got.anchor_count, got.errors) == (1, errors)


def test_anchor_structure(spark):
    rows = [("many", NOTE * 7), ("drift", "> 原片教学锚点（x）\n"), ("back", NOTE.replace("00:10", "00:30"))]
    got = {r.note_id: r.errors for r in quotes.check_anchors(spark.createDataFrame(rows, "note_id string, value string")).collect()}
    assert got == {"many": ["duplicate"] * 6 + ["too_many"], "drift": ["format_drift"], "back": ["reversed_time"]}


def _entries(spark):
    files = [("a/note1.md", "---\ntitle: One\naliases: [uno, 'eins']\n---\nx"), ("b/note1.md", "---\naliases:\n  - due\n---\n"), (".git/x.md", "")]
    return vault.note_entries(spark.createDataFrame(files, "rel string, value string"))


def test_vault(spark):
    e = _entries(spark)
    names = {r.name: (r.candidates, r.conflict) for r in vault.name_index(e).collect()}
    assert names["note1"] == (["a/note1", "b/note1"], True)
    assert {"One", "uno", "eins", "due"} <= names.keys() and not names["due"][1]
    targets = spark.createDataFrame([(x,) for x in ("note1.md", "NOTE1", "a\\note1", "b/note1.md", "UNO", "nope.md")], "target string")
    assert {r.target for r in vault.known_targets(targets, e).collect()} == {"note1.md", "NOTE1", "a\\note1", "b/note1.md", "UNO"}


def test_pieces_join_to_the_text_and_linking_twice_changes_nothing(spark):
    text = "---\na: b\n---\n# dp head\ndp `dp` [[dp]] https://x/dp $dp$ and DP again dp\n```\ndp\n```\n"
    assert "".join(c for _, c in links.pieces(text)) == text
    plan = [{"term": "dp", "target": "algo/dp.md"}]
    once, linked = links.link_text(text, plan)
    assert linked == ["dp"] and once.count("[[algo/dp|dp]]") == 1
    e = _entries(spark)
    terms = spark.createDataFrame([(0, "uno", "term", None), (1, "note1", "term", None), (2, "graph", "concept", None), (3, "two", "term", "gone")], "ord int, term string, type string, target string")
    plan = links.link_plan(terms, vault.name_index(e), e)
    assert {r.term: r.kind for r in plan.collect()} == {"uno": "strong", "note1": "ambiguous", "graph": "concept", "two": "bad_target"}
    out = links.inject(spark.createDataFrame([("me", "uno and graph")], "note_id string, value string"), plan).first()
    assert out.value.startswith("[[a/note1|uno]] and graph") and "- [[graph]]" in out.value and (out.n_strong, out.n_footer) == (1, 1)


def test_gate_reports(spark):
    rows = gate.validate(spark.createDataFrame([("bad", "```\nopen"), ("empty", "")], "note_id string, value string"))
    got = {r.note_id: r for r in gate.reports(rows).collect()}
    assert set(got) == {"bad", "empty"}
    data = json.loads(got["bad"].json)
    assert not data["passed"] and "open_fence" in data["errors"] and data["scores"]["code"] == 0
    assert got["bad"].text.startswith("bad: failed (") and "  - open_fence" in got["bad"].text
    assert [gate.exit_code(x) for x in (rows, rows.withColumn("passed", F.lit(True)), rows.where("false"))] == [1, 0, 2]


def test_gate(spark):
    good = "---\ntitle: x\n---\n🎯 **全篇通关目标**\n[05:20] [🎥 原片]\n## 闭环自测\n### 1. a\n### 2. b\n### 3. c\n<details>1. x</details>\n<details>y</details>\n<details>z</details>\n"
    bad = good + "```\n"
    got = {r.note_id: r for r in gate.validate(spark.createDataFrame([("good", good), ("bad", bad)], "note_id string, value string")).collect()}
    assert got["good"].passed and got["good"].questions == 3 and got["good"].answers == 3 and abs(got["good"].overall - 1) < 1e-9
    assert not got["bad"].passed and (round(got["bad"].format, 6), got["bad"].code) == (0.6, 0.0)


def test_audits(spark):
    rows = [("a", '{"video_id":"v","candidates":[{"quote":"q","kept":true,"reason":{"irreplaceable":"x"}},{"kept":false}],"final_anchors":1}'), ("b", "{}")]
    got = {r.audit_id: r.issues for r in gate.check_audits(spark.createDataFrame(rows, "audit_id string, value string")).collect()}
    assert got == {"a": ["reason:non_derivable", "reason:memorable", "reason_failed"], "b": ["missing:video_id", "missing:candidates", "missing:final_anchors"]}


def test_note_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "_a b.md").write_text("x\ny", encoding="utf-8")
    (tmp_path / "c.md").write_text("z", encoding="utf-8")
    spark.dataSource.register(notes.NoteFolder)
    assert {(r.rel, r.value) for r in spark.read.format("note_folder").load(str(tmp_path)).collect()} == {("sub/_a b.md", "x\ny"), ("c.md", "z")}
    assert {(r.rel, r.value) for r in notes.read_notes(spark, str(tmp_path)).collect()} == {("c.md", "z")}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("v", i, float(i), t) for i, t in enumerate(["abcde", "cdefg", "xyz"])], CAP)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.keep_new_heads(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {r.text for r in folds.drop_repeated_heads(rows).collect()}
