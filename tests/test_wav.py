"""Slices and conversion of PCM audio."""

import io
import wave

import numpy as np
import pytest

from stratalog.operators import timeline
from stratalog.sources import wav


def _wav(samples, rate, width=2, channels=1):
    x = np.repeat(np.asarray(samples)[:, None], channels, 1)
    if width == 1:
        data = np.clip(np.round(x * 128 + 128), 0, 255).astype(np.uint8).tobytes()
    else:
        whole = np.clip(np.round(x * 2.0 ** (8 * width - 1)), -(2 ** (8 * width - 1)), 2 ** (8 * width - 1) - 1).astype("<i8")
        data = whole.reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(data)
    return out.getvalue()


def _samples(content):
    with wave.open(io.BytesIO(content)) as f:
        assert (f.getnchannels(), f.getsampwidth()) == (1, 2)
        return np.frombuffer(f.readframes(f.getnframes()), "<i2") / 32768, f.getframerate()


@pytest.mark.parametrize("rate", [8000, 11025, 16000, 22050, 44100, 48000])
@pytest.mark.parametrize("width, channels", [(1, 1), (2, 2), (3, 1), (4, 2)])
def test_a_sine_keeps_frequency_and_level(rate, width, channels):
    hz, level = 997.0, 0.5
    t = np.arange(rate) / rate
    samples, got = wav._read(_wav(level * np.sin(2 * np.pi * hz * t), rate, width, channels))
    assert got == rate and samples.shape == (rate, channels)
    out = wav.resampled(samples.mean(1), rate)
    assert len(out) == 16000
    k = np.arange(16000) / 16000
    middle = slice(200, -200)  # the filter reaches beyond the ends
    error = out[middle] - level * np.sin(2 * np.pi * hz * k[middle])
    assert np.abs(error).max() < (0.012 if width == 1 else 1e-3)


def test_what_the_new_rate_cannot_hold_is_gone():
    t = np.arange(48000) / 48000
    assert np.abs(wav.resampled(np.sin(2 * np.pi * 12000 * t), 48000)[200:-200]).max() < 1e-3


def test_slices_join_to_the_whole(spark):
    r = np.random.default_rng(1)
    whole = r.integers(-30000, 30000, 22050 * 3 + 77) / 32768
    files = spark.createDataFrame([("a", _wav(whole, 22050)), ("b", b"no wav"), ("c", None), ("e", _wav([], 8000))], "video_id string, content binary")
    media = spark.createDataFrame([("a", len(whole) / 22050), ("b", 2.0), ("d", 2.0), ("e", 0.5)], "video_id string, duration double")
    rows = wav.slices(files, timeline.plan_chunks(media, 0.7)).orderBy("video_id", "chunk_id").collect()
    parts = [_samples(bytes(x.content)) for x in rows if x.video_id == "a"]
    assert {rate for _, rate in parts} == {22050} and len(parts) == 5
    joined = np.concatenate([p for p, _ in parts])
    assert abs(len(joined) - len(whole)) <= 11 and np.abs(joined[: len(whole)] - whole[: len(joined)]).max() < 1e-9  # ends have three decimals
    assert [len(_samples(bytes(x.content))[0]) for x in rows if x.video_id != "a"] == [0]


def test_conversion(spark):
    t = np.arange(4410) / 44100
    files = spark.createDataFrame([(1, _wav(0.3 * np.sin(2 * np.pi * 440 * t), 44100, 2, 2)), (2, b"RIFF"), (3, None)], "video_id int, content binary")
    got = {x.video_id: x.content for x in wav.convert(files).collect()}
    samples, rate = _samples(bytes(got[1]))
    assert (rate, len(samples)) == (16000, 1600) and got[2] is None and got[3] is None
    assert abs(np.sqrt(np.mean(samples[100:-100] ** 2)) - 0.3 / np.sqrt(2)) < 2e-3
