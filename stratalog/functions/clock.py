"""Clock strings, identities and run keys as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import strip

STAMP = r"\d{1,2}:\d{2}(?::\d{2})?"


def fmt_ts(seconds: Column) -> Column:
    """hh:mm:ss, truncated, negative as 0; hours may pass 99."""
    s = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def parse_ts(text: Column) -> Column:
    """Seconds of one to three parts by ':'; 0.0 where a part is no number or there are more parts."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.coalesce(F.when(F.size(parts) <= 3, seconds), F.lit(0.0))


def ts_to_sec(text: Column) -> Column:
    """Seconds of mm:ss or hh:mm:ss with parts in range, else null. Minutes are unbounded in the two-part form."""
    p = F.transform(F.split(text, ":"), lambda x: strip(x).try_cast("int"))
    three = F.when((F.get(p, F.lit(1)) < 60) & (F.get(p, F.lit(2)) < 60), F.get(p, F.lit(0)) * 3600 + F.get(p, F.lit(1)) * 60 + F.get(p, F.lit(2)))
    two = F.when(F.get(p, F.lit(1)) < 60, F.get(p, F.lit(0)) * 60 + F.get(p, F.lit(1)))
    return F.when(F.size(p) == 2, two).when(F.size(p) == 3, three)


def strip_timestamps(text: Column) -> Column:
    """Without bracketed stamps, ranges and labelled stamps; lines trimmed, blank ones left out."""
    tag = rf"\[{STAMP}(?:(?U:\s*)-(?U:\s*){STAMP})?(?:(?U:\s+)[^\]]*)?\](?U:\s*)"
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, tag, "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def parse_chunk_ids(spec: Column) -> Column:
    """'0,1,3', '0-3' or '5-2' to sorted distinct ids. Null and '' are null (all); without a valid part the array is empty."""
    bounds = F.transform(F.split(spec, ","), lambda p: F.transform(F.split(strip(p), "-", 2), lambda x: strip(x).try_cast("int")))
    good = F.filter(bounds, lambda b: ~F.exists(b, lambda x: x.isNull()) & (F.array_min(b) >= 0))
    ids = F.flatten(F.transform(good, lambda b: F.sequence(F.array_min(b), F.array_max(b))))
    return F.when(spec != "", F.array_sort(F.array_distinct(ids)))


def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def resolve_video_id(source: Column, explicit: Column | None = None) -> Column:
    """A safe identity: the explicit one; a BV id, with its part if the source names one; an 11-character id; the last path part; a digest."""

    def safe(x):
        return F.regexp_replace(x, r"[^\p{L}\p{N}_\-]", "_")

    bv = _nonempty(F.regexp_extract(source, "(BV[a-zA-Z0-9]+)", 1))
    part = F.coalesce(_nonempty(F.regexp_extract(source, r"[?&]p=(\d+)|_(?:p|P)(\d+)", 1)), _nonempty(F.regexp_extract(source, r"[?&]p=(\d+)|_(?:p|P)(\d+)", 2)))
    short = _nonempty(F.regexp_extract(source, r"(?:v=|youtu\.be/)([a-zA-Z0-9_-]{11})", 1))
    last = _nonempty(safe(F.element_at(F.split(F.regexp_replace(F.element_at(F.split(source, r"\?"), 1), r"/+\z", ""), "/"), -1)))
    found = F.coalesce(F.when(part.isNotNull(), F.concat(bv, F.lit("_p"), part)).otherwise(bv), bv, short, last, F.substring(F.md5(source), 1, 12))
    if explicit is None:
        return found
    return F.coalesce(_nonempty(safe(F.element_at(F.split(F.regexp_replace(explicit, r"/+\z", ""), "/"), -1))), found)


def run_key(*parts: Column) -> Column:
    """16 hexadecimal digits over all parameters that affect a result; a null is written None, so that it can't vanish."""
    return F.substring(F.sha1(reduce(lambda a, b: F.concat(a, F.lit("|"), b), [F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), 1, 16)
