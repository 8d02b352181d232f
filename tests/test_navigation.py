"""The cascade of navigation levels."""

import json

from stratalog.plans import navigation


def _by_video(df):
    return {r.video_id: (r.nav_level, r.content_source, json.loads(r.payload)) for r in df.collect()}


def test_each_video_has_its_first_level(spark):
    media = spark.createDataFrame([("cap", "t", 150.0), ("blank", None, 150.0), ("man", "m", 150.0), ("chap", "c", 150.0), ("none", "n", 150.0), ("zero", "z", 0.0)], "video_id string, title string, duration double")
    captions = spark.createDataFrame([("cap", "zh-CN", 1, 70.0, "dp 数组"), ("cap", "zh-CN", 0, 10.0, "hi"), ("cap", "zh-CN", 2, 150.0, "past the end"), ("cap", "zh-CN", 3, 130.0, None), ("blank", "en", 0, 1.0, " ")], "video_id string, lang string, seq bigint, start double, text string")
    manifests = spark.createDataFrame([(v, i, 60.0 * i, min(150.0, 60.0 * i + 60), s) for v in ("cap", "man") for i, s in enumerate(["done", "pending", None])], "video_id string, chunk_id int, t0 double, t1 double, status string")
    results = spark.createDataFrame([("man", 1, 1, "b"), ("man", 1, 0, "a")], "video_id string, chunk_id int, seq bigint, text string")
    chapters = spark.createDataFrame([("chap", 0, 0.0, 100.0, "递归 one"), ("man", 0, 0.0, 150.0, "all"), ("blank", 0, 0.0, 150.0, "x")], "video_id string, ord int, start double, end double, title string")
    heard = []

    def hear(batches):
        for batch in batches:
            yield batch[batch.chunk_id != 1].assign(text=" loop ")[["video_id", "chunk_id", "text"]]

    got = _by_video(navigation.navigate(media, 60, captions, manifests, results, chapters, hear))
    levels = {v: (level, source, p["chunk_count"], [(c["status"], c["chars"]) for c in p["chunk_index"]]) for v, (level, source, p) in got.items()}
    assert levels == {
        "cap": ("L0-subtitle", "subtitle:zh-CN", 3, [("ready", 2), ("ready", 5), ("ready", 0)]),
        "blank": ("L0-A (chapters)", "chapters", 3, [("meta_indexed", 1)] * 3),
        "man": ("L0-manifest", "whisper", 3, [("done", 0), ("ready", 2), ("unknown", 0)]),
        "chap": ("L0-A (chapters)", "chapters", 3, [("meta_indexed", 6), ("meta_indexed", 6), ("meta_indexed", 0)]),
        "none": ("L0-B (audio scout)", "whisper_scout", 3, [("scouted", 4), ("scouted", 0), ("scouted", 4)]),
        "zero": ("L0-B (audio scout)", "whisper_scout", 0, []),
    }
    assert got["man"][2]["chunk_index"][0]["topic_hints"] == ["all"] and got["cap"][2]["chunk_index"][1]["keywords"] and not heard
    assert got["cap"][2]["nav_level"] == "L0-subtitle" and got["cap"][2]["content_source"] == "subtitle:zh-CN"


def test_without_anything_only_times_are_known(spark):
    media = spark.createDataFrame([("v", None, 100.0)], "video_id string, title string, duration double")
    ((level, source, payload),) = _by_video(navigation.navigate(media, 60)).values()
    assert (level, source, payload["chunk_count"]) == ("L0-empty", "none", 2) and {c["status"] for c in payload["chunk_index"]} == {"pending"}
    assert navigation.navigate(media.where("false"), 60).collect() == []
