from pyspark.sql import functions as F

from stratalog.functions import clock, text
from stratalog.functions.dialect import fold, strip


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).coalesce(1).select(expr).collect()]


def test_clock(spark):
    assert values(spark, [3725.9, -4.0, 360000.0], clock.fmt_ts(F.col("x")), "x double") == ["01:02:05", "00:00:00", "100:00:00"]
    assert values(spark, ["01:20", "1:02:03.5", "x", "1:2:3:4"], clock.parse_ts(F.col("x"))) == [80.0, 3723.5, 0.0, 0.0]
    assert values(spark, ["01:20", "01:02:03", "invalid", "99:99", "", "75:10", "1:60:00"], clock.ts_to_sec(F.col("x"))) == [80, 3723, None, None, None, 4510, None]


def test_chunk_ids(spark):
    got = values(spark, ["0,1,3", "0-3", "3-1", "invalid, 2-4, foo", None, "", "x"], clock.parse_chunk_ids(F.col("x")))
    assert got == [[0, 1, 3], [0, 1, 2, 3], [1, 2, 3], [2, 3, 4], None, None, []]


def test_strip_timestamps(spark):
    assert values(spark, ["[00:01] a [00:02 - 00:03 tag] b", "[00:01]\nx"], clock.strip_timestamps(F.col("x"))) == ["a b", "x"]


def test_video_id(spark):
    rows = ["https://b/video/BV1b7411N798?p=43", "https://b/BV1b7411N798?x=1&p=43", "BV1b7411N798_p43", "https://y/watch?v=abcdefghijk", "/a/b c.mp4"]
    assert values(spark, rows, clock.resolve_video_id(F.col("x"))) == ["BV1b7411N798_p43"] * 3 + ["abcdefghijk", "b_c_mp4"]


def test_text(spark):
    assert values(spark, ["Ab-c!", "a", ""], text.bigrams(F.col("x"))) == [["ab", "bc"], [], []]
    assert values(spark, ["dp", "the", "The", "x", "a b-c/d", "a,b", None], text.is_valid_term(F.col("x"))) == [True, False, False, False, True, False, False]
    assert values(spark, ["优化 啊 aab", "欧派的"], text.normalize_tokens(F.col("x"))) == ["异或ab", "opad的"]
    assert values(spark, ["　a ", " "], strip(F.col("x"))) == ["a", ""]
    assert values(spark, ["A_b², 🎙️"], fold(F.col("x"))) == ["ab²"]
    assert values(spark, ["a &amp; &#39;b&#39;"], text.html_unescape(F.col("x"))) == ["a & 'b'"]
