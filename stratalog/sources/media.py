"""Media behind providers: track downloads, metadata with a cache, audio files, and transcription of slices.

What needs a network or a model comes in as a function over pandas batches; choice, cache, checks and ownership are columns.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timeline import own_by_midpoint
from .captions import parse_blocks, parse_json

#: A stored audio file of fewer bytes is not whole.
MIN_AUDIO_BYTES = 100 * 1024
#: Seconds around a chunk that a transcriber hears too.
MARGIN = 0.5
METADATA = "title string, author string, duration double, description string, webpage_url string, subtitles string, automatic_captions string, chapters array<struct<start_time: double, end_time: double, title: string>>"
Provider = Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]]


def choose_download(tracks: DataFrame, bodies: DataFrame) -> DataFrame:
    """(video_id, url): of each video's tracks (video_id, ord, ext, url) the first, JSON before others, whose body in bodies (url, value) has a caption. Tracks without url or body are passed over."""
    held = tracks.where("url is not null and url <> ''").select("video_id", "ord", "ext", "url").join(bodies.select("url", "value").where("value is not null"), "url")
    files = held.select(F.struct("video_id", "url").alias("video_id"), "value")
    good = parse_json(files).select("video_id").unionByName(parse_blocks(files).select("video_id")).distinct().select("video_id.*")
    order = F.row_number().over(W.partitionBy("video_id").orderBy(F.coalesce(F.col("ext") != "json", F.lit(True)), "ord", "url"))
    return held.join(good, ["video_id", "url"], "left_semi").withColumn("nth", order).where("nth = 1").select("video_id", "url")


def media_url(source: Column, platform: Column) -> Column:
    """Where to ask for a source: itself, but for bare ids of the platform bilibili, whose part becomes a parameter."""
    part = r"\A(BV[a-zA-Z0-9]+)[_?&](?:p|P)?(\d+)\n?\z"
    page = F.lit("https://www.bilibili.com/video/")
    bare = (platform == "bilibili") & ~source.startswith("http://") & ~source.startswith("https://")
    url = F.when(source.rlike(part), F.concat(page, F.regexp_extract(source, part, 1), F.lit("?p="), F.regexp_extract(source, part, 2))).otherwise(F.concat(page, source))
    return F.when(bare, url).otherwise(source)


def cached_metadata(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows (platform, video_id, title, subtitles, automatic_captions, …) of ``requests`` that count: with a title, and with tracks or the knowledge that there are none."""
    good = F.coalesce(F.col("title") != "", F.lit(False)) & (F.col("subtitles").isNotNull() | F.col("automatic_captions").isNotNull())
    return stored.where(good).join(requests.select("platform", "video_id").distinct(), ["platform", "video_id"], "left_semi")


def missing_metadata(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests (platform, video_id, source, …) without a stored row that counts."""
    return requests.join(cached_metadata(requests, stored).select("platform", "video_id"), ["platform", "video_id"], "left_anti")


def fetch_metadata(requests: DataFrame, stored: DataFrame, provider: Provider) -> DataFrame:
    """(platform, video_id, …): stored rows that count, and for other requests what ``provider`` gives for batches of (platform, video_id, source, url). Append the fresh ones to what is stored."""
    schema = f"platform string, video_id string, {METADATA}"
    asked = missing_metadata(requests, stored).select("platform", "video_id", "source", media_url(F.col("source"), F.col("platform")).alias("url"))
    fresh = asked.mapInPandas(provider, schema)
    return cached_metadata(requests, stored).select(*fresh.columns).unionByName(fresh)


@F.pandas_udf(T.DoubleType())
def wav_seconds(content: pd.Series) -> pd.Series:
    """Duration of whole WAV files, null where they can't be decoded."""

    def seconds(raw) -> float | None:
        try:
            with wave.open(io.BytesIO(raw)) as f:
                return f.getnframes() / f.getframerate()
        except (wave.Error, EOFError, TypeError, ZeroDivisionError):
            return None

    return content.map(seconds).astype("float64")


def usable_audio(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files (platform, video_id, length, seconds) that may be used again: large enough, decodable, and with metadata. Others are to be removed before they are fetched anew."""
    whole = files.where((F.col("length") >= MIN_AUDIO_BYTES) & (F.col("seconds") > 0))
    return whole.join(metadata.select("platform", "video_id").distinct(), ["platform", "video_id"], "left_semi")


def transcribe(chunks: DataFrame, transcriber: Provider, margin: float = MARGIN) -> DataFrame:
    """(video_id, chunk_id, start, end, text): what ``transcriber`` hears in batches of (video_id, chunk_id, t0, t1, s, e), its times from the start of the media.

    It hears ``margin`` seconds around each of chunks (video_id, chunk_id, t0, t1); a segment counts in the chunk that
    holds its middle and is clamped to it, times with three decimals. Segments without text vanish.
    """
    asked = chunks.select("video_id", "chunk_id", "t0", "t1", F.greatest(F.lit(0.0), F.col("t0") - margin).alias("s"), (F.col("t1") + margin).alias("e"))
    key = chunks.schema["video_id"].dataType.simpleString()
    heard = asked.mapInPandas(transcriber, f"video_id {key}, chunk_id int, t0 double, t1 double, start double, end double, text string")
    rows = own_by_midpoint(heard.where("trim(text) <> ''"))
    return rows.select("video_id", "chunk_id", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), F.trim("text").alias("text"))
