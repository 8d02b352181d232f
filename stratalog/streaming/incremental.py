"""The same operators over streams: windows, resumable chunk results, and a keyed fold."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.clock import run_key
from ..operators.condense import condense
from ..operators.folds import fresh_text
from ..sources.notes import RESULT_KEYS, write_results


def windowed(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """(video_id, t0, n, text_chars) of events (video_id, ts, text) in tumbling windows; batch and stream alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("video_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return out.select("video_id", F.col("w.start").alias("t0"), "n", "chars")


def condensed_chunks(segments: DataFrame) -> DataFrame:
    """Condensed rows of whole chunks (run_key, video_id, chunk_id, seq, start, text), each chunk by itself."""
    keyed = segments.withColumn("video_id", F.struct(*RESULT_KEYS))
    return condense(keyed)[0].select("video_id.*", "seq", "kind", "t_from", "t_to", "n_lines", "text", "n_traps")


def condense_chunks(segments: DataFrame, path: str, checkpoint: str, *params: Column):
    """Condense chunks (video_id, chunk_id, seq, start, text) of a stream into the partitions (run_key, video_id, chunk_id) of ``path``.

    The run key is made of the video and ``params``, all that affects a result: other parameters never meet old results.
    Each batch is first stored below ``path`` + '_segments'; then every chunk it touched is condensed anew from all its
    stored segments and its partition replaced. So a chunk whose segments come in several batches is whole in the end,
    a replayed batch changes nothing (a segment counts once by its number), and other videos' chunks stay.
    """
    stored = path.rstrip("/") + "_segments"

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keyed = batch.select(run_key(F.col("video_id"), *params).alias("run_key"), "video_id", "chunk_id", "seq", "start", "text")
        keyed.write.mode("append").partitionBy(*RESULT_KEYS).parquet(stored)
        touched = keyed.select(*RESULT_KEYS).distinct()
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
        # Partition columns: only the folders of touched chunks are read.
        rows = spark.read.schema(types).parquet(stored).join(touched, list(RESULT_KEYS), "left_semi").dropDuplicates([*RESULT_KEYS, "seq"])
        write_results(condensed_chunks(rows), path)

    return segments.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_chunks(chunks: DataFrame, path: str, *params: Column) -> DataFrame:
    """Chunks (video_id, chunk_id, …) with their run key that have no result of these parameters in ``path``, whatever a manifest says of them."""
    wanted = chunks.withColumn("run_key", run_key(F.col("video_id"), *params))
    try:
        done = chunks.sparkSession.read.parquet(path).select(*[F.col(c).cast(wanted.schema[c].dataType).alias(c) for c in RESULT_KEYS]).distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return wanted
        raise
    return wanted.join(done, list(RESULT_KEYS), "left_anti")


def keep_new_heads(captions: DataFrame, window: int | None = None) -> DataFrame:
    """The repeated-head fold over a stream of captions (video_id, seq, start, text) that comes in order of seq a video; state is the last kept text."""

    def step(key, batches, state):
        last, out = state.get[0] if state.exists else "", []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():  # a video's captions of one trigger
            text = fresh_text(last, row.text, window)
            if text:
                last = text
                out.append((row.video_id, row.seq, row.start, text))
        state.update((last,))
        yield pd.DataFrame(out, columns=["video_id", "seq", "start", "text"])

    return captions.groupBy("video_id").applyInPandasWithState(step, captions.select("video_id", "seq", "start", "text").schema, "last string", "append", GroupStateTimeout.NoTimeout)
