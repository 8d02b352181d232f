"""PCM audio in WAV columns: slices by chunk bounds, and one channel at another rate by a polyphase windowed sinc."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the filter on each side, and the shape of its Kaiser window; ripple and leakage stay below 1e-3.
CROSSINGS, BETA = 24, 8.0
RATE = 16_000
#: Output samples that one step of the filter computes.
STEP = 1 << 14


def _read(content: bytes) -> tuple[np.ndarray, int] | None:
    """Samples (frames, channels) from -1 to 1 and the rate of a PCM WAV, or None."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError, TypeError):
        return None
    data = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
    if width == 1:
        samples = (data[:, 0].astype(np.float64) - 128) / 128
    else:
        whole = np.zeros((len(data), 4), np.uint8)
        whole[:, 4 - width :] = data
        samples = whole.view("<i4")[:, 0] / 2.0**31
    return (samples.reshape(-1, channels), rate) if rate else None


def _write(samples: np.ndarray, rate: int) -> bytes:
    """One channel of 16-bit PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.round(samples * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def resampled(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """One channel at another rate: output k is the input's band-limited value at time k / to, taken as silence beyond its ends.

    With to / rate = up / down in lowest terms there are ``up`` phases, each a set of filter taps that serves every up-th
    output. The cut is at the lower of both rates' halves, so nothing folds back.
    """
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    n = -(-len(samples) * up // down)
    if up == down or not len(samples):
        return samples.copy()
    scale = min(1.0, up / down)
    half = math.ceil(CROSSINGS / scale)
    padded = np.concatenate([np.zeros(half), samples, np.zeros(half + 1)])
    at = np.arange(-half + 1, half + 1)
    out = np.empty(n)
    for phase in range(min(up, n)):
        t = at - (phase * down % up) / up  # of the taps, from the output's time
        taps = scale * np.sinc(scale * t) * np.i0(BETA * np.sqrt(np.clip(1 - (t / half) ** 2, 0, None))) / np.i0(BETA)
        base = np.arange(phase, n, up, dtype=np.int64) * down // up
        for a in range(0, len(base), STEP):
            part = base[a : a + STEP]
            out[phase + a * up : phase + (a + len(part)) * up : up] = padded[part[:, None] + (at + half)] @ taps
    return out


def convert(files: DataFrame, rate: int = RATE) -> DataFrame:
    """``files`` (video_id, content) with content as 16-bit WAV of one channel, the mean of all, at ``rate``. Content that isn't PCM WAV becomes null."""

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                held = _read(raw) if raw is not None else None
                out.append(None if held is None else _write(resampled(held[0].mean(1), held[1], rate), rate))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["video_id", "content"])

    rows = files.select("video_id", "content")
    return rows.mapInArrow(run, rows.schema)


def slices(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(video_id, chunk_id, t0, t1, content): the samples of each of chunks (video_id, chunk_id, t0, t1) as a WAV of one channel at the file's rate.

    A slice holds the samples from round(t0 * rate) to before round(t1 * rate), so slices of chunks that tile a file join
    to its samples. A video's bounds come together as one list, and its file is read once for all of them. Chunks of files
    that aren't there, or no PCM WAV, have no slice.
    """
    bounds = chunks.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "t0", "t1"))).alias("chunks"))
    key = files.schema["video_id"].dataType.simpleString()
    schema = f"video_id {key}, chunk_id int, t0 double, t1 double, content binary"

    def run(batches):
        for batch in batches:
            ids, contents, lists = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                held = _read(contents[i].as_py()) if contents[i].is_valid else None
                if held is None:
                    continue
                mono, rate = held[0].mean(1), held[1]
                for c in lists[i].as_py():
                    part = mono[max(0, round(c["t0"] * rate)) : max(0, round(c["t1"] * rate))]
                    cells = [ids.slice(i, 1), pa.array([c["chunk_id"]], pa.int32()), pa.array([c["t0"]], pa.float64()), pa.array([c["t1"]], pa.float64()), pa.array([_write(part, rate)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, ["video_id", "chunk_id", "t0", "t1", "content"])

    return files.select("video_id", "content").join(bounds, "video_id").select("video_id", "content", "chunks").mapInArrow(run, schema)
