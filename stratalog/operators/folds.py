"""Ordered folds whose state is the last kept row.

Rows are dealt by key and sorted within partitions; one pass over the sorted stream holds a single row of state, so a key
of any length needs no more memory than a short one. A key of very many rows is cut at restart points, rows at which the
fold's state can't depend on anything before: what lies between two of them is an island, and islands are folded apart.
Restart points are found by ranges of rows, so no task reads the whole of such a key.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dialect import strip
from ..storage import checkpointed

_CJK = re.compile("[一-鿿]")
#: Rows from which a key is folded island by island, and the longest head that a fold looks for.
KEY_ROWS, LONGEST_HEAD = 1_000_000, 24


def _fold(rows: DataFrame, key: list[str], order: list[str], step) -> DataFrame:
    names = rows.columns

    def run(batches):
        state, now, out = None, object(), []

        def flush():
            return pa.RecordBatch.from_pydict({c: [r[c] for r in out] for c in names}, schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                if (at := tuple(row[c] for c in key)) != now:
                    if state is not None:
                        out.append(state)
                    now, state = at, None
                done, state = step(state, row)
                if done is not None:
                    out.append(done)
            if out:
                yield flush()
                out = []
        if state is not None:
            out.append(state)
            yield flush()

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, rows.schema)


def _numbered(dealt: DataFrame, order: list[str], begins: Column) -> DataFrame:
    """``dealt`` (video_id, range, …) with ``island``, the number of restart points of the key up to each row.

    Points are counted within each range and added up over the ranges, of which a key has one row each.
    """
    here = W.partitionBy("video_id", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = checkpointed(dealt.withColumn("own", F.sum(begins.cast("long")).over(here)))
    before = W.partitionBy("video_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("video_id", "range").agg(F.max("own").alias("points")).withColumn("earlier", F.coalesce(F.sum("points").over(before), F.lit(0)))
    return rows.join(sums.drop("points"), ["video_id", "range"]).withColumn("island", F.col("earlier") + F.col("own"))


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` dealt in ranges of (video_id, order), numbered and cut from their lineage, so that the ranges stay."""
    return checkpointed(rows.repartitionByRange("video_id", *order).withColumn("range", F.spark_partition_id()))


def _split_fold(rows: DataFrame, order: list[str], step, islands) -> DataFrame:
    """The fold over ``rows``; keys of more than KEY_ROWS rows are folded island by island, others whole."""
    # Their number is bounded: there are at most rows / KEY_ROWS of them.
    large = checkpointed(rows.groupBy("video_id").count().where((F.col("count") > KEY_ROWS) & F.col("video_id").isNotNull()).select("video_id"))
    if large.isEmpty():
        return _fold(rows, ["video_id"], order, step)
    cut = islands(rows.join(F.broadcast(large), "video_id", "left_semi").select(*rows.columns))
    whole = rows.join(F.broadcast(large), "video_id", "left_anti").select(*rows.columns)
    return _fold(whole, ["video_id"], order, step).unionByName(_fold(cut.select("island", *rows.columns), ["video_id", "island"], order, step).drop("island"))


def overlap_islands(segments: DataFrame) -> DataFrame:
    """``segments`` (video_id, seq, start, end, …) with ``island``: a segment that starts at or after all earlier ends begins one, as it overlaps nothing before.

    Running maxima are taken within ranges of rows and over the ranges' maxima.
    """
    order = ["start", "seq"]
    dealt = _ranged(segments, order)
    earlier = W.partitionBy("video_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    tops = dealt.groupBy("video_id", "range").agg(F.max("end").alias("top")).withColumn("reach", F.max("top").over(earlier)).drop("top")
    here = W.partitionBy("video_id", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    dealt = dealt.join(tops, ["video_id", "range"]).withColumn("reach", F.greatest("reach", F.max("end").over(here)))
    return _numbered(dealt, order, F.col("reach").isNull() | F.coalesce(F.col("start") >= F.col("reach"), F.lit(False)))


def head_islands(segments: DataFrame, window: int | None = None) -> DataFrame:
    """``segments`` (video_id, seq, text, …) with ``island``: a text begins one if it can't repeat the one before, and that one is sure to be kept.

    A kept text is a tail of its row's, so a head that no tail of the row before equals isn't cut whatever the state; and a
    text longer than the longest head can't vanish.
    """
    most = window if window is not None else LONGEST_HEAD
    dealt = _ranged(segments, ["seq"])
    own = strip(F.coalesce("text", F.lit("")))
    dealt = dealt.withColumns({"plain": own, "earlier_text": F.lag(own).over(W.partitionBy("video_id", "range").orderBy("seq"))})
    lengths = F.sequence(F.lit(3), F.lit(max(3, most)))
    fits = lambda n: (n <= F.length("plain")) & (n <= F.length("earlier_text"))
    repeats = F.exists(lengths, lambda n: fits(n) & (F.left("plain", n) == F.right("earlier_text", n)))
    begins = F.col("earlier_text").isNotNull() & (F.length("earlier_text") > most) & (F.col("plain") != "") & ~repeats
    return _numbered(dealt, ["seq"], begins)


def overlap_step(share: float = 0.7, strict: bool = False):
    """The step of the overlap fold, in batches and streams alike: (kept row, next row) to (row that is done, kept row)."""

    def step(kept, row):
        if kept is None:
            return None, row
        bounds = (kept["start"], kept["end"], row["start"], row["end"])
        if None not in bounds:
            overlap = min(kept["end"], row["end"]) - max(kept["start"], row["start"])
            shorter = min(kept["end"] - kept["start"], row["end"] - row["start"])
            if overlap > 0 and shorter > 0 and overlap / shorter > share:
                a, b = (kept["text"] or "").strip(), (row["text"] or "").strip()
                better = len(b) > len(a) or (not strict and (a in b or b in a))
                return None, (row if better else kept)
        return kept, row

    return step


def drop_overlaps(segments: DataFrame, share: float = 0.7, strict: bool = False) -> DataFrame:
    """Segments (video_id, seq, start, end, text) without repeats at the seams of slices.

    A segment that overlaps the last kept one by more than ``share`` of the shorter replaces it if either text contains
    the other or its own is longer, and is dropped otherwise. With ``strict``, only the longer text replaces. A segment
    without a start or an end overlaps nothing. A video of over KEY_ROWS segments is folded by ``overlap_islands``.
    """
    return _split_fold(segments.select("video_id", "seq", "start", "end", "text"), ["start", "seq"], overlap_step(share, strict), overlap_islands)


def fresh_text(before: str, text: str | None, window: int | None = None) -> str:
    """What a text adds to the one before it: without the longest head that is the other's tail, of 3 characters at least. The step of the fold, in batches and streams alike."""
    text = (text or "").strip()
    most = min(window if window is not None else 8 if _CJK.search(before) else LONGEST_HEAD, len(before), len(text))
    tail = before[len(before) - most :]
    for n in range(most, 2, -1):
        if tail[most - n :] == text[:n]:
            return text[n:].strip()
    return text


def drop_repeated_heads(segments: DataFrame, window: int | None = None) -> DataFrame:
    """Captions (video_id, seq, start, text) without the head that repeats the tail of the last kept text.

    The longest head of 3 to ``window`` characters counts (8 after a text with CJK characters, else 24); rows without text, or without a rest, vanish.
    A video of over KEY_ROWS captions is folded by ``head_islands``.
    """

    def step(kept, row):
        text = fresh_text(kept["text"] if kept is not None else "", row["text"], window)
        return (kept, {**row, "text": text}) if text else (None, kept)

    return _split_fold(segments.select("video_id", "seq", "start", "text"), ["seq"], step, lambda rows: head_islands(rows, window))
