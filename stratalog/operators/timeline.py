"""Timelines: chunks, chapters, interval joins and navigation rows.

Tables: segments (video_id, seq, start, [end,] text), chunks (video_id, chunk_id, t0, t1), chapters (video_id, ord, start, end, title).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import fmt_ts, parse_ts
from ..functions.dialect import strip
from ..functions.text import py_round2
from .folds import drop_overlaps
from .intervals import overlapping
from .signals import analyze


def plan_chunks(media: DataFrame, chunk_len: float) -> DataFrame:
    """(video_id, duration) to tumbling chunks that tile [0, duration); the last one is clipped, duration 0 has none."""
    n = F.ceil(F.col("duration") / chunk_len).cast("int")
    rows = media.where("duration > 0").select("video_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_id"))
    return rows.select("video_id", "chunk_id", F.bround(F.col("chunk_id") * F.lit(float(chunk_len)), 3).alias("t0"), F.bround(F.least((F.col("chunk_id") + 1) * F.lit(float(chunk_len)), F.col("duration")), 3).alias("t1"))


def chunk_texts(segments: DataFrame, chunk_len: float) -> DataFrame:
    """Text of each chunk, segments joined in order. A segment belongs to the chunk of its start: an equi-key, not an interval join."""
    keyed = segments.withColumn("chunk_id", F.floor(F.col("start") / chunk_len).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("start", "seq", "text")))
    return keyed.groupBy("video_id", "chunk_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.count(F.lit(1)).alias("n_segments"))


def chapter_overlaps(chunks: DataFrame, chapters: DataFrame, chunk_len: float) -> DataFrame:
    """(video_id, chunk_id, titles in chapter order) for start < t1 and end > t0, every chunk kept.

    Chapters and chunks meet on dyadic nodes of slots of ``chunk_len``, so that a chapter over very many chunks is dealt a
    number of times that grows with its logarithm.
    """
    spans = chapters.where("end > start").select("video_id", "ord", "title", "start", "end")
    hit = overlapping(chunks.select("video_id", "chunk_id", "t0", "t1"), ("t0", "t1"), spans, ("start", "end"), ["video_id"], chunk_len).where((F.col("start") < F.col("t1")) & (F.col("end") > F.col("t0")))
    titles = hit.groupBy("video_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("titles"))
    return chunks.join(titles.hint("merge"), ["video_id", "chunk_id"], "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def own_by_midpoint(segments: DataFrame) -> DataFrame:
    """Of rows (…, start, end, t0, t1): those whose middle lies in [t0, t1), clamped to it."""
    mid = (F.col("start") + F.col("end")) / 2
    return segments.where((mid >= F.col("t0")) & (mid < F.col("t1"))).withColumns({"start": F.greatest("start", "t0"), "end": F.least("end", "t1")})


def chapter_ends(chapters: DataFrame, duration: str = "duration") -> DataFrame:
    """Ends of chapters without one: the next start, for the last the duration, or 0."""
    by = W.partitionBy("video_id").orderBy("ord")
    return chapters.withColumn("end", F.coalesce(F.lead("start").over(by), F.col(duration), F.lit(0.0)))


def chapters_from_description(media: DataFrame) -> DataFrame:
    """(video_id, ord, start, end, title): embedded ``chapters`` with a title as they are, else the time table in ``description``."""
    embedded = media.select("video_id", F.posexplode("chapters").alias("ord", "c")).select("video_id", "ord", F.col("c.start_time").alias("start"), F.col("c.end_time").alias("end"), strip(F.col("c.title")).alias("title")).where("title <> ''")
    rest = media.join(embedded.select("video_id").distinct(), "video_id", "left_anti")
    entry = r"(?:^|\n)(?U:\s*)[\[(]?((?:\d{1,2}:)?\d{2}:\d{2})[\])]?(?U:\s*)[-—:]?(?U:\s*)([^\n\r]+)"
    pairs = F.arrays_zip(F.regexp_extract_all("description", F.lit(entry), 1).alias("ts"), F.regexp_extract_all("description", F.lit(entry), 2).alias("title"))
    found = rest.select("video_id", "duration", F.posexplode(pairs).alias("ord", "p")).select("video_id", "duration", "ord", parse_ts(F.col("p.ts")).alias("start"), F.substring(strip(F.col("p.title")), 1, 50).alias("title"))
    found = chapter_ends(found.where("title <> '' and not startswith(title, 'http')")).select("video_id", "ord", "start", "end", "title")
    return embedded.unionByName(found)


def chunk_index(chunks: DataFrame, texts: DataFrame, chapters: DataFrame | None, chunk_len: float, status: str | Column = "ready") -> DataFrame:
    """Navigation rows: clock times, status (a value for all, or an expression over chunks and texts), characters and signals of each chunk, chapter titles as hints where there are any."""
    rows = chunks.join(texts.select("video_id", "chunk_id", "text"), ["video_id", "chunk_id"], "left")
    if chapters is None:
        rows = rows.withColumn("titles", F.array().cast("array<string>"))
    else:
        rows = rows.join(chapter_overlaps(chunks, chapters, chunk_len).select("video_id", "chunk_id", "titles"), ["video_id", "chunk_id"], "left")
    rows = rows.withColumn("sig", analyze(F.col("text"), F.col("titles")))
    return rows.select("video_id", "chunk_id", fmt_ts(F.col("t0")).alias("start"), fmt_ts(F.col("t1")).alias("end"), (F.col("t1") - F.col("t0")).alias("duration_s"), (F.lit(status) if isinstance(status, str) else status).alias("status"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), "sig.*")


def chunk_index_from_results(chunks: DataFrame, results: DataFrame, chapters: DataFrame | None, chunk_len: float) -> DataFrame:
    """As chunk_index, of stored results (video_id, chunk_id, seq, text): chunks that have any are ready, others keep the status of their manifest in ``chunks`` (unknown without one)."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    texts = results.groupBy("video_id", "chunk_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    held = chunks if "status" in chunks.columns else chunks.withColumn("status", F.lit(None).cast("string"))
    return chunk_index(held, texts, chapters, chunk_len, F.when(F.col("text").isNotNull(), "ready").otherwise(F.coalesce("status", F.lit("unknown"))))


def empty_index(chunks: DataFrame) -> DataFrame:
    """Navigation rows of chunks of which nothing is known: no signal, status pending."""
    return chunk_index(chunks, chunks.select("video_id", "chunk_id", F.lit("").alias("text")), None, 1.0, status="pending")


def index_envelopes(index: DataFrame, media: DataFrame, content_source: str | Column, nav_level: str) -> DataFrame:
    """(video_id, payload): a JSON record of each of media (video_id, title, duration) with all its navigation rows in order, lengths with one decimal and densities with two."""
    fields = ["chunk_id", "start", "end", "duration_s", "status", "chars", "keywords", "topic_hints", "density", "has_code", "has_formula", "has_warning"]
    row = F.struct(F.col("chunk_id").alias("id"), *fields[1:])
    index = index.withColumns({"duration_s": F.bround("duration_s", 1), "density": py_round2(F.col("density"))})
    rows = index.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("chunk_index"))
    rows = media.join(rows, "video_id", "left").withColumn("chunk_index", F.coalesce("chunk_index", F.array()))
    record = F.struct("video_id", F.coalesce("title", F.lit("")).alias("title"), "duration", fmt_ts(F.col("duration")).alias("duration_str"), (F.lit(content_source) if isinstance(content_source, str) else content_source).alias("content_source"), F.lit(nav_level).alias("nav_level"), F.size("chunk_index").alias("chunk_count"), "chunk_index")
    return rows.select("video_id", F.to_json(record).alias("payload"))


def chunk_index_from_chapters(chunks: DataFrame, chapters: DataFrame, chunk_len: float) -> DataFrame:
    """As chunk_index, with the chunk's chapter titles as its text."""
    over = chapter_overlaps(chunks, chapters, chunk_len).select("video_id", "chunk_id", F.array_join("titles", " ").alias("text"))
    return chunk_index(chunks, over, chapters, chunk_len, status="meta_indexed")


def first_non_empty(levels: list[tuple[str, DataFrame]], key: str = "video_id") -> DataFrame:
    """Rows of the first level that has any for a key. Each level is asked only for keys that no earlier one has."""
    taken, out = None, []
    for name, rows in levels:
        fresh = rows if taken is None else rows.join(taken, key, "left_anti")
        out.append(fresh.withColumn("nav_level", F.lit(name)))
        keys = rows.select(key).distinct()
        taken = keys if taken is None else taken.unionByName(keys).distinct()
    return reduce(DataFrame.unionByName, out)


def scout_windows(chunks: DataFrame, seconds: float = 20.0, back: float = 25.0) -> DataFrame:
    """Where to listen in each chunk: up to ``seconds`` from its head, past the opening, or all of its head if that is empty."""
    s = F.least(F.col("t0") + seconds, F.greatest(F.col("t0"), F.col("t1") - back))
    e = F.least(F.col("t1"), s + seconds)
    ok = e > s
    return chunks.withColumns({"s": F.when(ok, s).otherwise(F.col("t0")), "e": F.when(ok, e).otherwise(F.least(F.col("t1"), F.col("t0") + seconds))})


def cues_near(cues: DataFrame, windows: DataFrame, margin: float = 25, bucket: float = 60) -> DataFrame:
    """Cues (archive_id, source_no, s, e, text) that touch [max(0, s0 - margin), e0 + margin] of windows (archive_id, window_id, s0, e0), both ends included.

    They meet on dyadic nodes of slots of ``bucket`` seconds; each pair comes once.
    """
    w = windows.withColumns({"w0": F.greatest(F.lit(0.0), F.col("s0") - margin), "w1": F.col("e0") + margin})
    return overlapping(cues, ("s", "e"), w, ("w0", "w1"), ["archive_id"], bucket).drop("w0", "w1")


def select_chunks(chunks: DataFrame, ids: list[int] | None) -> DataFrame:
    """Chunks (…, chunk_id) by number: all for None, none for an empty list."""
    return chunks if ids is None else chunks.where(F.col("chunk_id").isin(*ids) if ids else F.lit(False))


def finished_chunks(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks that have a result, whatever their manifest says."""
    return chunks.join(results.select("video_id", "chunk_id").distinct(), ["video_id", "chunk_id"], "left_semi")


def merge_chunks(chunks: DataFrame, results: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Segments (video_id, seq, start, end, text) of the chosen chunks, overlaps at their seams dropped; a chosen chunk without a result raises when the rows are read."""
    chosen = select_chunks(chunks, ids)
    rows = chosen.select("video_id", "chunk_id").join(results, ["video_id", "chunk_id"], "left")
    name = F.format_string("chunk %s of %s has no result", F.col("chunk_id").cast("string"), F.col("video_id").cast("string"))
    rows = rows.withColumn("seq", F.when(F.col("start").isNull(), F.raise_error(name).cast("bigint")).otherwise(F.col("seq")))
    return drop_overlaps(rows)


def missing_chunks(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks without a result; a merge is complete when there are none."""
    return wanted.join(results.select("video_id", "chunk_id").distinct(), ["video_id", "chunk_id"], "left_anti")
