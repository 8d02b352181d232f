"""The navigation record of every video, from the best that is known of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import strip
from ..operators import timeline
from ..sources.media import Provider
from ..storage import checkpointed

#: Levels in order of preference, and where their content comes from; fixed values.
LEVELS = (("L0-subtitle", "subtitle"), ("L0-manifest", "whisper"), ("L0-A (chapters)", "chapters"), ("L0-B (audio scout)", "whisper_scout"), ("L0-empty", "none"))


def levels(media: DataFrame, captions: DataFrame | None = None, manifests: DataFrame | None = None, chapters: DataFrame | None = None, scout: bool = False) -> DataFrame:
    """``media`` (video_id, title, duration) with ``level``, the number of the first of LEVELS that has anything for a video, and ``lang``, its captions' language."""
    rows = media.select("video_id", "title", F.col("duration").cast("double").alias("duration"))
    none = F.lit(None)
    if captions is None:
        rows = rows.withColumn("lang", none.cast("string")).withColumn("l0", none.cast("boolean"))
    else:
        said = captions.where(strip(F.coalesce("text", F.lit(""))) != "").groupBy("video_id").agg(F.min("lang").alias("lang"), F.lit(True).alias("l0"))
        rows = rows.join(said, "video_id", "left")
    for name, table in (("l1", manifests), ("l2", chapters)):
        rows = rows.withColumn(name, none.cast("boolean")) if table is None else rows.join(table.select("video_id").distinct().withColumn(name, F.lit(True)), "video_id", "left")
    level = F.when(F.col("l0"), 0).when(F.col("l1"), 1).when(F.col("l2"), 2).otherwise(3 if scout else 4)
    return rows.select("video_id", "title", "duration", "lang", level.alias("level"))


def scouted(chunks: DataFrame, provider: Provider) -> DataFrame:
    """Navigation rows of chunks by what ``provider`` hears in their windows: it takes batches of (video_id, chunk_id, t0, t1, s, e) and gives (video_id, chunk_id, text), no row where it hears nothing."""
    windows = timeline.scout_windows(chunks).select("video_id", "chunk_id", "t0", "t1", "s", "e")
    key = chunks.schema["video_id"].dataType.simpleString()
    heard = windows.mapInPandas(provider, f"video_id {key}, chunk_id int, text string").select("video_id", "chunk_id", strip(F.col("text")).alias("text"))
    return timeline.chunk_index(chunks, heard, None, 1.0, status="scouted")


def navigate(media: DataFrame, chunk_len: float, captions: DataFrame | None = None, manifests: DataFrame | None = None, results: DataFrame | None = None, chapters: DataFrame | None = None, scout: Provider | None = None) -> DataFrame:
    """(video_id, nav_level, content_source, payload): the JSON record of each of media (video_id, title, duration), with all its chunks.

    A video's rows come from its captions (video_id, lang, seq, start, text) if one of them has a text; else from its
    manifest (video_id, chunk_id, t0, t1, status) and the stored ``results`` (video_id, chunk_id, seq, text); else from its
    chapters (video_id, ord, start, end, title); else from what ``scout`` hears; else they only tell the times. Chapter
    titles are hints for the first two. Each level reads only its own videos, and the scout hears no others. A video
    without a duration has no chunks; captions that start at its end or later belong to none.
    """
    known = checkpointed(levels(media, captions, manifests, chapters, scout is not None))  # a row a video, read by each level

    def own(table: DataFrame, level: int) -> DataFrame:
        return table.join(known.where(F.col("level") == level).select("video_id"), "video_id", "left_semi")

    def chunks(level: int) -> DataFrame:
        return timeline.plan_chunks(known.where(F.col("level") == level).select("video_id", "duration"), chunk_len)

    def hints(level: int) -> DataFrame | None:
        return None if chapters is None else own(chapters, level)

    found = {4: timeline.empty_index(chunks(4))}
    if captions is not None:
        said = own(captions, 0).join(known.select("video_id", "duration"), "video_id").where((F.col("start") >= 0) & (F.col("start") < F.col("duration")))
        found[0] = timeline.chunk_index(chunks(0), timeline.chunk_texts(said.select("video_id", "seq", "start", F.coalesce("text", F.lit("")).alias("text")), chunk_len), hints(0), chunk_len)
    if manifests is not None:
        none = manifests.select("video_id", "chunk_id", F.lit(0).alias("seq"), F.lit("").alias("text")).where("false")
        found[1] = timeline.chunk_index_from_results(own(manifests, 1), own(results, 1) if results is not None else none, hints(1), chunk_len)
    if chapters is not None:
        found[2] = timeline.chunk_index_from_chapters(chunks(2), own(chapters, 2), chunk_len)
    if scout is not None:
        found[3] = scouted(chunks(3), scout)
    parts = []
    for level, index in found.items():
        name, source = LEVELS[level]
        videos = known.where(F.col("level") == level)
        source = F.concat(F.lit(f"{source}:"), F.coalesce("lang", F.lit(""))) if level == 0 else F.lit(source)
        parts.append(timeline.index_envelopes(index, videos, source, name).join(videos.select("video_id", F.lit(name).alias("nav_level"), source.alias("content_source")), "video_id"))
    return reduce(DataFrame.unionByName, parts).select("video_id", "nav_level", "content_source", "payload")
