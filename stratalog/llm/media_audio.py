"""MPEG audio as a media column: tags, variable-bitrate tables, frames with checksums, durations and seek offsets.

The writer stores bytes in the ancillary data of MPEG-1 Layer III frames (32 kHz, mono, protected by a checksum) whose
side information is zero: a valid stream of silence. Frames take the largest bitrate, the last one the least that holds
its bytes, so the stream has a variable bitrate. An ID3v2.4 tag with a private frame holds the number of bytes stored; a first,
empty frame holds the table with the numbers of frames and bytes and 100 seek points. The reader trusts none of it:
it takes tags apart, resynchronises on headers, and verifies each checksum.

A header counts as a frame if the end or a header of the same kind follows, if it stands where the frame before it ended
and is of its kind, or if its checksum is right. So the frame before a damaged one stays, and the damaged one alone goes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by version and layer, sampling rates of MPEG-1 (halved, quartered for 2, 2.5).
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: Bits of a subband's allocation in Layer II as (bits, subbands), for MPEG-1, for its low bitrates, and for MPEG-2.
ALLOCATION, ALLOCATION_LOW, ALLOCATION_2 = ((4, 11), (3, 12), (2, 7)), ((4, 2), (3, 10)), ((4, 4), (3, 7), (2, 19))
RATE, SIDE_BYTES, HEAD_BYTES = 32000, 17, 6
PRIVATE_OWNER = b"payload-length\0"
UNIT = 64


@dataclass
class Frame:
    at: int
    size: int
    version: int
    layer: int
    bitrate: int
    rate: int
    channels: int
    samples: int
    protected: bool
    joint_bound: int | None = None
    crc_ok: bool | None = None

    def kind(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.rate


@dataclass
class Audio:
    frames: list[Frame] = field(default_factory=list)
    tags: dict = field(default_factory=dict)
    table: dict | None = None
    skipped: int = 0
    payload: bytes = b""

    @property
    def samples(self) -> int:
        return sum(f.samples for f in self.frames)

    @property
    def seconds(self) -> float:
        return float(self.duration)

    @property
    def duration(self) -> Fraction:
        """Exact seconds: samples are counted by rate and divided once."""
        by_rate: Counter = Counter()
        for f in self.frames:
            by_rate[f.rate] += f.samples
        return sum((Fraction(n, rate) for rate, n in by_rate.items()), Fraction(0))


def crc16(data: bytes, start: int = 0xFFFF, bits: int | None = None) -> int:
    """The frames' checksum of the first ``bits`` bits (all by default): polynomial 0x8005, most significant bit first."""
    crc, left = start, 8 * len(data) if bits is None else bits
    for byte in data:
        for i in range(7, 7 - min(8, max(0, left)), -1):
            crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ byte >> i) & 1 else 0)) & 0xFFFF
        left -= 8
    return crc


def header_at(data: bytes, at: int) -> Frame | None:
    """The frame whose header is at ``at``, or None if those four bytes aren't a header with a known length."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 25}.get(data[at + 1] >> 3 & 3, 0), 4 - (data[at + 1] >> 1 & 3)
    rate_at, index = data[at + 2] >> 2 & 3, data[at + 2] >> 4
    if not version or layer == 4 or rate_at == 3 or not 0 < index < 15:
        return None
    kbit = BITRATES[min(version, 2), layer][index - 1]
    rate = RATES[rate_at] // {1: 1, 2: 2, 25: 4}[version]
    padding = data[at + 2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152
    size = (12000 * kbit // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbit // rate + padding
    mode = data[at + 3] >> 6
    return Frame(at, size, version, layer, kbit, rate, 1 if mode == 3 else 2, samples, not data[at + 1] & 1, 4 * (1 + (data[at + 3] >> 4 & 3)) if mode == 1 else None)


def side_bytes(f: Frame) -> int:
    return (32 if f.channels == 2 else 17) if f.version == 1 else (17 if f.channels == 2 else 9)


def _bits(data: bytes, at: int, n: int) -> int:
    """``n`` bits from bit ``at`` on."""
    whole = int.from_bytes(data[at // 8 : (at + n + 7) // 8], "big")
    return whole >> -(at + n) % 8 & (1 << n) - 1


def covered_bits(data: bytes, f: Frame) -> int:
    """How many bits after the checksum it covers: side information (III), allocations (I), or allocations and scale factor selections (II)."""
    if f.layer == 3:
        return 8 * side_bytes(f)
    if f.layer == 1:
        bands = [4] * 32
    else:
        share = f.bitrate // f.channels
        low = f.version == 1 and share < 56
        table = ALLOCATION_2 if f.version > 1 else ALLOCATION_LOW if low else ALLOCATION
        most = 30 if f.version > 1 else (12 if f.rate == 32000 else 8) if low else 30 if share >= 96 and f.rate != 48000 else 27
        bands = [n for n, times in table for _ in range(times)][:most]
    bound = len(bands) if f.joint_bound is None else min(len(bands), f.joint_bound)
    at = start = 8 * (f.at + 6)
    used = 0
    for band, n in enumerate(bands):
        own = f.channels if band < bound else 1
        for _ in range(own):
            # Beyond the bound both channels share an allocation, but each selects its scale factors.
            used += (_bits(data, at, n) != 0) * (f.channels if own < f.channels else 1)
            at += n
    return at - start + (2 * used if f.layer == 2 else 0)


def checksum_ok(data: bytes, f: Frame, known: dict | None = None) -> bool | None:
    """Whether a protected frame's checksum is right; None without one."""
    if not f.protected:
        return None
    n = covered_bits(data, f)
    covered = data[f.at + 2 : f.at + 4] + data[f.at + 6 : f.at + 6 + -(-n // 8)]
    key = covered, n
    value = known.get(key) if known is not None else None
    if value is None:
        value = crc16(covered, bits=16 + n)
        if known is not None:
            if len(known) > 4096:
                known.clear()
            known[key] = value
    return value == int.from_bytes(data[f.at + 4 : f.at + 6], "big")


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _seven(raw: bytes) -> int:
    return sum((b & 0x7F) << 7 * i for i, b in enumerate(reversed(raw)))


def _id3v2(data: bytes, at: int, end: int, tags: dict) -> int:
    """Frames of the ID3v2 tag at ``at`` into ``tags``; where the tag ends. Versions 2.2 to 2.4, unsynchronised or with an extended header."""
    major, flags, size = data[at + 3], data[at + 5], _seven(data[at + 6 : at + 10])
    stop = at + 10 + size
    body = data[at + 10 : min(end, stop)]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    i = 0
    if flags & 0x40 and major >= 3:
        i = _seven(body[:4]) if major >= 4 else 4 + int.from_bytes(body[:4], "big")
    head, name = (6, 3) if major == 2 else (10, 4)
    while i + head <= len(body) and body[i : i + name].isalnum():
        raw = body[i + name : i + name + (3 if major == 2 else 4)]
        n = _seven(raw) if major >= 4 else int.from_bytes(raw, "big")
        value = body[i + head : i + head + n]
        if major >= 4:
            form = body[i + 9]
            if form & 1:  # a length precedes the data
                value = value[4:]
            if form & 2 or flags & 0x80:
                value = value.replace(b"\xff\0", b"\xff")
        tags.setdefault(body[i : i + name].decode("ascii"), []).append(value)
        i += head + n
    return stop + (10 if flags & 0x10 else 0)


def _ape(data: bytes, end: int, tags: dict) -> int:
    """Items of the APE tag that ends at ``end`` into ``tags``; where the tag begins, or ``end`` without one."""
    if end < 32 or data[end - 32 : end - 24] != b"APETAGEX":
        return end
    size, count, flags = (int.from_bytes(data[end - 32 + k : end - 28 + k], "little") for k in (12, 16, 20))
    begin = end - size
    if size < 32 or begin < 0:
        return end
    i = begin
    for _ in range(count):
        n = int.from_bytes(data[i : i + 4], "little")
        name_end = data.find(b"\0", i + 8, end - 32)
        if name_end < 0 or name_end + 1 + n > end - 32:
            break
        tags.setdefault("APE:" + data[i + 8 : name_end].decode("ascii", "replace"), []).append(data[name_end + 1 : name_end + 1 + n])
        i = name_end + 1 + n
    return max(0, begin - 32) if flags >> 31 else begin


def read_tags(data: bytes) -> tuple[dict, int, int]:
    """(frames of tags, where audio begins, where it ends): ID3v2 before it, ID3v1 and APE after it."""
    tags: dict = {}
    begin, end = 0, len(data)
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= end and all(b < 128 for b in data[begin + 6 : begin + 10]):
        begin = _id3v2(data, begin, end, tags)
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["ID3v1"] = [data[end + 3 : end + 128]]
    return tags, begin, max(begin, _ape(data, end, tags))


def _vbr_table(data: bytes, f: Frame) -> dict | None:
    """The table of numbers of frames and bytes and of seek points in a first frame: Xing, Info or VBRI."""
    at = f.at + 36
    if data[at : at + 4] == b"VBRI":
        number = lambda i, n: int.from_bytes(data[at + i : at + i + n], "big")
        entries, scale, width = number(18, 2), number(20, 2), number(22, 2)
        return {"kind": "VBRI", "quality": number(8, 2), "bytes": number(10, 4), "frames": number(14, 4), "step_frames": number(24, 2), "steps": [scale * number(26 + i * width, width) for i in range(entries) if at + 26 + (i + 1) * width <= f.at + f.size]}
    at = f.at + 4 + 2 * f.protected + side_bytes(f)
    if data[at : at + 4] not in (b"Xing", b"Info"):
        return None
    flags, out = int.from_bytes(data[at + 4 : at + 8], "big"), {"kind": data[at : at + 4].decode()}
    at += 8
    for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
        if flags & bit:
            out[name] = data[at : at + n] if name == "toc" else int.from_bytes(data[at : at + n], "big")
            at += n
    return out


def parse(data: bytes) -> Audio:
    """Read a stream of MPEG audio: tags, table, all frames found by synchronisation, their checksums, and the stored payload if it was written here."""
    out = Audio()
    out.tags, at, end = read_tags(data)
    parts, sums, before = [], {}, None
    while at + 4 <= end:
        f = header_at(data, at)
        if f is not None and at + f.size <= end:
            f.crc_ok = checksum_ok(data, f, sums)
            following = at + f.size
            after = header_at(data, following) if following < end else None
            in_step = before is not None and before.at + before.size == at and before.kind() == f.kind()
            good = following == end or (after is not None and after.kind() == f.kind()) or in_step or f.crc_ok
        else:
            good = False
        if not good:
            nxt = data.find(b"\xff", at + 1, end)
            out.skipped += (end if nxt < 0 else nxt) - at
            at = end if nxt < 0 else nxt
            continue
        table = _vbr_table(data, f) if before is None and f.layer == 3 else None
        if table:
            out.table = table
        else:
            out.frames.append(f)
            parts.append(data[at + 4 + 2 * f.protected + side_bytes(f) : following] if f.layer == 3 else b"")
        before, at = f, following
    out.skipped += end - at if at < end else 0
    for raw in out.tags.get("PRIV", []):
        if raw.startswith(PRIVATE_OWNER):
            out.payload = b"".join(parts)[: int.from_bytes(raw[len(PRIVATE_OWNER) :], "big")]
    return out


def _head(kbit: int) -> bytes:
    first = bytes([0xFF, 0xFA, (BITRATES[1, 3].index(kbit) + 1) << 4 | RATES.index(RATE) << 2, 0xC0])
    return first + crc16(first[2:] + bytes(SIDE_BYTES)).to_bytes(2, "big") + bytes(SIDE_BYTES)


_HEADS = {kbit: _head(kbit) for kbit in BITRATES[1, 3]}
_ROOM = {kbit: 144 * 1000 * kbit // RATE - HEAD_BYTES - SIDE_BYTES for kbit in BITRATES[1, 3]}


def write(payload: bytes) -> bytes:
    """A stream of MPEG audio whose ancillary data is ``payload``."""
    most = max(_ROOM)
    full = len(payload) // _ROOM[most]
    rest = payload[full * _ROOM[most] :]
    frames = b""
    if full:
        block = np.empty((full, len(_HEADS[most]) + _ROOM[most]), np.uint8)
        block[:, : len(_HEADS[most])] = np.frombuffer(_HEADS[most], np.uint8)
        block[:, len(_HEADS[most]) :] = np.frombuffer(payload, np.uint8, full * _ROOM[most]).reshape(full, -1)
        frames = block.tobytes()
    if rest:
        kbit = min(k for k in _ROOM if _ROOM[k] >= len(rest))
        frames += _HEADS[kbit] + rest.ljust(_ROOM[kbit], b"\0")
    n, info = full + bool(rest), 64
    info_size = len(_HEADS[info]) + _ROOM[info]
    size = info_size + len(frames)
    step = len(_HEADS[most]) + _ROOM[most]
    toc = bytes(min(255, 256 * (info_size + min(full, i * n // 100) * step) // size) for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + (size & 0xFFFFFFFF).to_bytes(4, "big") + toc
    private = PRIVATE_OWNER + len(payload).to_bytes(8, "big")
    tag = b"PRIV" + _synchsafe(len(private)) + b"\0\0" + private
    return b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag + _HEADS[info] + table.ljust(_ROOM[info], b"\0") + frames


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\0")


def describe(audio: Audio) -> str:
    """Features of a parsed stream, as text."""
    rates = sorted({f.bitrate for f in audio.frames})
    ok = sum(f.crc_ok is True for f in audio.frames)
    return f"mpeg1-layer3;rate={audio.frames[0].rate if audio.frames else 0};frames={len(audio.frames)};samples={audio.samples};kbit={','.join(map(str, rates))};crc_ok={ok};skipped={audio.skipped};vbr_frames={(audio.table or {}).get('frames', 0)}"


def _stored(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        media = [write(padded(t)) for t in texts]
        sizes = [len(t or b"") for t in texts]
        at = 0
        while at < len(media):  # media of a batch may be several times its texts
            to, size = at, 0
            while to < len(media) and (to == at or size + len(media[to]) <= 8 << 20):
                size += len(media[to])
                to += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(sizes[at:to], pa.int64()), pa.array(media[at:to], pa.binary())], ["doc_id", "n_bytes", "media"])
            at = to


PROBED = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, samples bigint, sample_rate int, duration_s double, crc_bad bigint, seek_offsets array<bigint>"


def _probed(batches):
    for batch in batches:
        rows = []
        for raw in batch.column(2).to_pylist():
            audio = parse(raw or b"")
            p = audio.payload
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(raw or b""), hashlib.sha256(raw or b"").hexdigest(), describe(audio), audio.samples, audio.frames[0].rate if audio.frames else 0, audio.seconds, sum(f.crc_ok is False for f in audio.frames), [f.at for f in audio.frames]))
        names = [c.split()[0] for c in PROBED.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", "n_bytes", *names])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each row's text in UTF-8, padded with bytes 0 to a positive multiple of 64, as a stream of MPEG audio.

    A null text is empty, and an empty one is 64 bytes 0. Very long texts are stored whole, a stream a row. Rows that repeat
    give equal rows; an empty table gives an empty one. Ids keep their type. Other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_stored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def probe(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes) of ``media`` and what its streams hold: the payload read back, its and the stream's digests, samples and their rate (of the first frame), the duration as their quotient, bad checksums, byte offsets of the frames to seek.

    Streams that aren't MPEG audio have no frames, no samples and rate 0; null counts as empty. Where rates change within a
    stream, the duration is the exact sum over the rates, rounded once. Rows that repeat give equal rows; an empty table
    gives an empty one; columns but doc_id, n_bytes and media are ignored.
    """
    bound_batches(media.sparkSession)
    rows = media.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(_probed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, {PROBED}")
