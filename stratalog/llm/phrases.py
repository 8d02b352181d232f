"""Phrase collocations by hierarchical naming of pairs.

A task encodes a slice of texts once: a stream of local codes, one an occurrence, with a break between pieces, and a list
of (code, word, count). The lists of all slices meet by word; a word that is frequent over all gets a name, the least of
its local names, and the name goes back to the slices that hold the word. There adjacent frequent names become pairs,
which meet, are counted and named the same way, and so on: a k-gram is a pair of the two (k-1)-grams it overlaps, and this
pair of names also points to its parents, from which the counts for cuts and the test for longer phrases follow.

What is shuffled is one row for each distinct k-gram of a slice, never one an occurrence, so that a word with a third of
all occurrences has as many rows as there are slices; streams travel to their slice's names in compressed blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices, discard, materialize, token_bounds

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE_TEXT = 8 << 20
#: A local name is slice << CODE_BITS | code, with slice = partition << COUNT_BITS | number; a slice of more occurrences takes several numbers.
CODE_BITS, COUNT_BITS = 25, 14
#: Bytes that end a piece, and those that part words within one.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.ones(256, np.uint8)
_KIND[list(ENDS)], _KIND[list(BLANKS)] = 2, 0
_FIRST = "slice bigint, code int, lang string, word string, n bigint, stream binary"

LOCAL_NAME = f"shiftleft(slice, {CODE_BITS}) | code"


def _pack(numbers: np.ndarray, kind=np.int32) -> bytes:
    """Integers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers, kind).view(np.uint8).reshape(len(numbers), np.dtype(kind).itemsize).T
    return len(numbers).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b"")


def _unpack(data: bytes, kind=np.int32) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a code for each key, and counts; frequent keys have small codes, which compress well."""
    values, codes, n = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[codes], n[order]


def _encoded(langs: pa.Array, data: np.ndarray, offsets: np.ndarray):
    """(langs, words, counts, stream) of a slice's texts."""
    kind = _KIND[data]
    inside = kind == 1
    starts, ends = token_bounds(inside, offsets)
    if not len(starts):
        return None
    doc = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    fresh = np.concatenate(([False], (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])))
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]])).dictionary_encode()
    names = langs.dictionary_encode()
    lang = names.indices.to_numpy(zero_copy_only=False)[doc].astype(np.int64)
    width = len(words.dictionary)
    keys, codes, n = _numbered(lang * width + words.indices.to_numpy(zero_copy_only=False))
    stream = np.full(len(codes) + int(fresh.sum()), -1, np.int32)
    stream[np.arange(len(codes)) + np.cumsum(fresh)] = codes
    return names.dictionary.take(pa.array(keys // width)), words.dictionary.take(pa.array(keys % width)).cast(pa.string()), n, stream


def _words(batches):
    """Slices of (lang, text): rows of words, and for each slice one row with its stream."""
    part, count = TaskContext.get().partitionId(), 0

    def flush(held):
        nonlocal count
        langs = pa.concat_arrays([b.column(0) for b in held])
        texts = pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held])
        for first, last, data, offsets in byte_slices(texts, SLICE_TEXT):
            got = _encoded(langs.slice(first, last - first), data, offsets)
            if got is None:
                continue
            name, (lang, words, n, stream) = part << COUNT_BITS | count, got
            count += 1 + (len(stream) >> CODE_BITS)
            schema = pa.schema([("slice", pa.int64()), ("code", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("stream", pa.binary())])
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, name)), pa.array(np.arange(k, dtype=np.int32)), lang.cast(pa.string()), words, pa.array(n), pa.nulls(k, pa.binary())], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([_pack(stream)], pa.binary())], schema=schema)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_TEXT:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


_PAIRS = "slice bigint, stream binary, ids binary, pairs binary, n binary"
_PAIRS_ARROW = pa.schema([("slice", pa.int64()), *((c, pa.binary()) for c in ("stream", "ids", "pairs", "n"))])


def _paired(last: bool):
    """A slice's stream and the names of its frequent codes to one row: the distinct pairs of adjacent names with their counts, in a block, and unless this is the last level the stream of pairs."""

    def run(streams: pa.Table, named: pa.Table) -> pa.Table:
        if not streams.num_rows or not named.num_rows:
            return _PAIRS_ARROW.empty_table()
        stream = _unpack(streams.column("stream")[0].as_py())
        codes, ids = named.column("code").to_numpy(), named.column("id").to_numpy()
        order = np.argsort(ids)
        codes, ids = codes[order], ids[order]
        local = np.full(max(int(stream.max(initial=-1)), int(codes.max())) + 2, -1, np.int64)  # the last one stands for a break
        local[codes] = np.arange(len(codes))
        held = local[stream]
        both = (held[:-1] >= 0) & (held[1:] >= 0)
        keys, pairs, n = np.unique(held[:-1][both] * len(codes) + held[1:][both], return_inverse=True, return_counts=True)
        if not len(keys):
            return _PAIRS_ARROW.empty_table()
        out = np.zeros(0, np.int32)
        if not last:
            out = np.full(len(both), -1, np.int32)
            out[both] = pairs
            out = out[both | np.concatenate(([False], both[:-1]))]  # a gap of any length is one break
        cells = [_pack(out), _pack(np.diff(ids, prepend=0), np.int64), _pack(np.diff(keys, prepend=0), np.int64), _pack(n)]
        return pa.Table.from_arrays([streams.column("slice").combine_chunks().slice(0, 1), *(pa.array([c], pa.binary()) for c in cells)], schema=_PAIRS_ARROW)

    return run


def _expanded(batches):
    """Rows (slice, ids, pairs, n) to a row (slice, code, a, b, n) a pair; a pair's code is its place."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, keys, n = np.cumsum(_unpack(row["ids"], np.int64)), np.cumsum(_unpack(row["pairs"], np.int64)), _unpack(row["n"])
            for at in range(0, len(keys), 1 << 20):
                part = keys[at : at + (1 << 20)]
                columns = (np.full(len(part), row["slice"]), np.arange(at, at + len(part), dtype=np.int32), ids[part // len(ids)], ids[part % len(ids)], n[at : at + len(part)].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slice", "code", "a", "b", "n"])


def _frequent(rows: DataFrame, key: list[str], least: int, last: bool) -> DataFrame:
    """(key…, slice, code, id, f, own) of the codes whose key has a count of ``least`` over all slices; id is the least of a key's local names, and the row that has it is the key's own.

    One exchange: a key has one row a slice at most. The key and its count stand in its own row only; others are the way
    back to their slices, which the last level doesn't need.
    """
    by = W.partitionBy(*key)
    counted = rows.withColumns({"f": F.sum("n").over(by), "name": F.expr(LOCAL_NAME)}).where(F.col("f") >= least).withColumn("id", F.min("name").over(by))
    own = F.col("name") == F.col("id")
    out = counted.select(*[F.when(own, F.col(c)).alias(c) for c in [*key, "f"]], "slice", "code", "id", own.alias("own"))
    return out.where("own") if last else out


def _cuts(k: int):
    """The lowest-scoring cut of a k-gram as a struct (score, at, l, r), exact: products are decimals."""
    a, scores = "cast(f as decimal(19,0))", []
    for at in range(1, k):
        left, right = f"cast(pre[{at - 1}] as decimal(19,0))", f"cast(suf[{k - at - 1}] as decimal(19,0))"
        scores.append(f"named_struct('score', ({a} * {a} * 1000000bd) div ({left} * {right}), 'at', {at}, 'l', pre[{at - 1}], 'r', suf[{k - at - 1}])")
    return F.expr(f"array_min(array({', '.join(scores)}))")


def mine_phrases(docs: DataFrame, most_words: int = 3, least: int = 10, top: int = 2000, covered: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``most_words`` words that occur at least ``least`` times.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and those at blanks into words; a phrase lies in
    one piece. Its score is that of its lowest-scoring cut, a million times a*a/(l*r), rounded down, where a counts the
    phrase and l and r the parts; ties go to the shortest first part. A phrase inside a longer candidate with at least
    ``covered`` percent of its count is dropped; as counts fall with length, a candidate one word longer tells.

    A null language is ``und``; a null or empty text has no words; repeated rows count as often as they stand; ties are
    ordered by count, then phrase in byte order; other columns are ignored. An empty table gives an empty result. A text
    of any length is taken whole, in one slice if it is longer than SLICE_TEXT.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    level = materialize(rows.mapInArrow(_words, _FIRST), "phrases1")
    totals = materialize(level.where("code is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    found, names, tables = [], None, []
    for k in range(1, most_words + 1):
        rows = level.where("code is not null").drop("stream") if k == 1 else level.select("slice", "ids", "pairs", "n").mapInArrow(_expanded, "slice bigint, code int, a bigint, b bigint, n bigint")
        # One exchange counts and names; the names of k-grams and the way back to the slices are both read from what it wrote.
        named = materialize(_frequent(rows, ["lang", "word"] if k == 1 else ["a", "b"], least, k == most_words), f"named{k}")
        own = named.where("own")
        if k == 1:
            names = materialize(own.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), "f", F.array("f").alias("pre"), F.array("f").alias("suf"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b")), "names1")
        else:
            # Both sides are written, so that Spark splits the partition of a word that begins or ends many phrases.
            before = names
            left, right = before.select(F.col("id").alias("a"), "lang", "phrase", "pre"), before.select(F.col("id").alias("b"), F.col("tail").alias("next"), "suf")
            half = materialize(own.select("id", "a", "b", "f").join(left, "a"), f"half{k}")
            names = half.join(right, "b").select("id", "lang", F.concat_ws(" ", "phrase", "next").alias("phrase"), F.col("next").alias("tail"), "f", F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"), "a", "b")
            names = materialize(names, f"names{k}")
            discard(half)
            if k > 2:
                found.append((k - 1, before, names))
        tables.append(names)
        if k < most_words:
            streams = (level.where("code is null") if k == 1 else level).select("slice", "stream")
            pairs = streams.groupBy("slice").cogroup(named.select("slice", "code", "id").groupBy("slice")).applyInArrow(_paired(k + 1 == most_words), _PAIRS)
            spent, level = level, materialize(pairs, f"phrases{k + 1}")
            discard(spent, named)
        else:
            discard(level, named)
    found.append((most_words, names, None))
    out = None
    for k, own, longer in found:
        rows = own.select("id", "lang", "phrase", "f", _cuts(k).alias("cut"))
        if longer is not None:
            over = longer.select(F.col("a").alias("id"), F.col("f").alias("over")).unionByName(longer.select(F.col("b").alias("id"), F.col("f").alias("over")))
            over = over.groupBy("id").agg(F.max("over").alias("over"))
            rows = rows.join(over, "id", "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("f") * covered))
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        out = rows if out is None else out.unionByName(rows)
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    result = materialize(first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(totals, *tables)
    return result
