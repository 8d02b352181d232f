"""Caption files to timed lines and segments, and the choice among caption tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.clock import fmt_ts, parse_ts
from ..functions.dialect import newlines, strip
from ..functions.text import html_unescape, strip_tags

BODY = "body array<struct<`from`:double,content:string>>"
CUE = r"\A(?:(\d{1,2}):)?(\d{2}:\d{2})[.,](\d{1,3})(?U:\s*)-->"


def parse_json(files: DataFrame) -> DataFrame:
    """(video_id, ord, ts, text) of files (video_id, value) that start with '{'; entries without content vanish, as do malformed files."""
    rows = files.where(F.ltrim("value").startswith("{")).withColumn("j", F.from_json("value", BODY))
    rows = rows.select("video_id", F.posexplode("j.body").alias("ord", "b"))
    rows = rows.select("video_id", "ord", fmt_ts(F.coalesce("b.from", F.lit(0.0))).alias("ts"), html_unescape(strip(F.coalesce("b.content", F.lit("")))).alias("text"))
    return rows.where("text <> ''")


def parse_blocks(files: DataFrame) -> DataFrame:
    """(video_id, ord, ts, text) of SRT and WebVTT files (video_id, value).

    A blank line ends a cue. Lines of digits are numbers of cues only where no time is pending, so spoken numbers stay.
    Each line of a cue is a row; text outside of cues has no time. Tags go, entities are decoded.
    """
    lines = files.where(~F.ltrim("value").startswith("{")).select("video_id", F.posexplode(F.split(newlines(F.regexp_replace("value", r"(?U)\A\s+", "")), "\n")).alias("ord", "raw"))
    lines = lines.withColumn("line", F.regexp_replace("raw", r"(?U)\s+\z", ""))
    by = W.partitionBy("video_id").orderBy("ord")
    lines = lines.withColumn("block", F.sum((F.col("line") == "").cast("int")).over(by))
    is_cue = F.col("line").rlike(CUE)
    time = F.when(is_cue, F.concat(F.lpad(F.coalesce(F.nullif(F.regexp_extract("line", CUE, 1), F.lit("")), F.lit("00")), 2, "0"), F.lit(":"), F.regexp_extract("line", CUE, 2)))
    before = W.partitionBy("video_id", "block").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumns({"time": time, "cue": is_cue})
    lines = lines.withColumn("pending", F.last("time", ignorenulls=True).over(before))
    number = F.col("pending").isNull() & F.col("line").rlike(r"\A\p{Nd}+\z")
    kept = lines.where((F.col("line") != "") & ~F.col("cue") & ~F.upper("line").startswith("WEBVTT") & ~number)
    return kept.select("video_id", "ord", F.col("pending").alias("ts"), html_unescape(strip(strip_tags(F.col("line")))).alias("text")).where("text <> ''")


def to_segments(lines: DataFrame) -> DataFrame:
    """(video_id, seq, start, text) of timed lines (video_id, ord, ts, text); a line without time has the last one before it, at first 0."""
    by = W.partitionBy("video_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.coalesce(F.last(F.when(F.col("ts").isNotNull(), parse_ts(F.col("ts"))), ignorenulls=True).over(by), F.lit(0.0))
    return lines.where(strip(F.col("text")) != "").select("video_id", F.col("ord").alias("seq"), start.alias("start"), "text")


def pick_track(tracks: DataFrame, prefer: str | None = None) -> DataFrame:
    """The best of each video's tracks (video_id, ord, lang, is_auto); a video without a fitting one has no row.

    The preferred tag itself, manual before automatic; then, for other tags, those that begin with it, manual and longer
    ones first; then Chinese by a fixed order, manual before automatic; then any tag with 'zh'. Ties go by ``ord``.
    """
    lang = F.lower("lang")
    manual, auto = ~F.col("is_auto"), F.col("is_auto")

    def listed(flag, names, base):
        return [F.when(flag & (lang == name), base + i) for i, name in enumerate(names)]

    chinese = F.coalesce(*listed(manual, lexicon.CHINESE_MANUAL, 100), *listed(auto, lexicon.CHINESE_AUTO, 200), F.when(manual & F.contains(lang, F.lit("zh")), 300), F.when(auto & F.contains(lang, F.lit("zh")), 301))
    tier = chinese
    if prefer and prefer not in ("auto", "none"):
        want = prefer.lower()
        exact = F.when(lang == want, F.when(manual, 0).otherwise(1))
        begins = F.when(lang.startswith(want), F.when(manual, 10).otherwise(11)) if not want.startswith("zh") else F.lit(None)
        tier = F.coalesce(exact, begins, chinese)
    longer = F.when(tier.isin(10, 11), -F.length("lang")).otherwise(0)
    rows = tracks.withColumns({"tier": tier, "longer": longer}).where("tier is not null")
    best = F.row_number().over(W.partitionBy("video_id").orderBy("tier", "longer", "ord"))
    return rows.withColumn("best", best).where("best = 1").select("video_id", "ord", "lang", "is_auto")
