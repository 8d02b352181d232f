"""The overlap fold over a stream of segments that come in any order, with state, event-time timers and a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import overlap_step

_SEGMENT = "seq bigint, start double, end double, text string, at bigint"
_FIELDS = ["seq", "start", "end", "text", "at"]


def _plain(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x


class OverlapFold(StatefulProcessor):
    """Of each video: segments that wait for the watermark, and the last kept one.

    A segment waits until the watermark has passed its event time; then none before it can come, and it is folded in order of
    start and number. The kept one goes out when another takes its place, or when the watermark has passed its end, as
    what comes later can't overlap it. So a video's state holds what the watermark's delay covers, and is empty after it.
    """

    def __init__(self, share: float, strict: bool, unit_ms: float):
        self.step, self.unit_ms = overlap_step(share, strict), unit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _SEGMENT)
        self.kept = handle.getValueState("kept", _SEGMENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least = None
        for batch in rows:
            at = batch["ts"].astype("datetime64[ms]").astype("int64")
            for row in zip(batch["seq"], batch["start"], batch["end"], batch["text"], at):
                self.waiting.appendValue((int(row[0]), *(_plain(x) for x in row[1:4]), int(row[4])))
                least = row[4] if least is None else min(least, row[4])
        if least is not None:
            self.handle.registerTimer(int(least))
        yield from ()

    def _ends(self, row: dict) -> int:
        length = row["end"] - row["start"] if row["end"] is not None and row["start"] is not None else 0
        return row["at"] + int(max(0.0, length) * self.unit_ms) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip(_FIELDS, x)) for x in self.waiting.get()]
        ready = sorted((r for r in rows if r["at"] <= now), key=lambda r: (r["start"] is not None, r["start"] or 0.0, r["seq"]))
        left = [r for r in rows if r["at"] > now]
        if ready:
            if left:
                self.waiting.put([tuple(r[f] for f in _FIELDS) for r in left])
            else:
                self.waiting.clear()
        kept = dict(zip(_FIELDS, self.kept.get())) if self.kept.exists() else None
        out = []
        for row in ready:
            done, kept = self.step(kept, row)
            if done is not None:
                out.append(done)
        if kept is not None and not any(r["at"] < self._ends(kept) for r in left) and self._ends(kept) <= now:
            out.append(kept)
            kept = None
        if kept is not None:
            self.kept.update(tuple(kept[f] for f in _FIELDS))
            self.handle.registerTimer(max(now + 1, self._ends(kept)))
        else:
            self.kept.clear()
        if left:
            self.handle.registerTimer(min(r["at"] for r in left))
        if out:
            yield pd.DataFrame([(key[0], r["seq"], r["start"], r["end"], r["text"]) for r in out], columns=["video_id", "seq", "start", "end", "text"])

    def close(self) -> None:
        pass


def drop_overlaps_stream(segments: DataFrame, unit_s: float = 1.0, late: str = "1 hour", share: float = 0.7, strict: bool = False) -> DataFrame:
    """``folds.drop_overlaps`` over a stream of segments (video_id, seq, start, end, text, ts), append mode.

    ``ts`` is the event time of a segment's start and ``unit_s`` the seconds of a unit of start and end. Segments may come in
    any order and batch within the watermark ``late``; later ones are dropped. The session needs the RocksDB state store.
    """
    schema = segments.select("video_id", "seq", "start", "end", "text").schema
    rows = segments.withWatermark("ts", late).groupBy("video_id")
    return rows.transformWithStateInPandas(OverlapFold(share, strict, unit_s * 1000), outputStructType=schema, outputMode="Append", timeMode="EventTime")
