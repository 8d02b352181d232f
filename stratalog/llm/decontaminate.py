"""Benchmark decontamination by winnowing.

Of the hashes of all K-grams of words, winnowing keeps the least of each window of W neighbours, so any K + W - 1 words
that two texts share leave them a common fingerprint. With K + W - 1 = 10, every shared span of 10 words is found; hits
are then extended word by word on both sides and checked on the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices, materialize, mix64, run_hashes, token_bounds

WINDOW_WORDS, GRAM_WORDS = 10, 5
#: Bytes of a block of benchmark items that travels with the tasks, by its arrays; fingerprints of a larger benchmark are joined by shuffle.
BLOCK_BYTES = 64 << 20
#: Bytes that a block's arrays have at most for each word, beside its text, and for each item.
WORD_BYTES, ITEM_BYTES = 32, 128
#: Places of one fingerprint from which they are checked together.
MANY_PLACES = 8
#: Words as the JVM finds them, before letters are folded.
JVM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    # Word characters are all but \x00-\x2F, \x3A-\x60 and \x7B-\x7F; bytes from \x80 on belong to other characters.
    word = np.ones(256, bool)
    word[0x00:0x30] = word[0x3A:0x61] = word[0x7B:0x80] = False
    return lower, word


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, starts, ends, hashes, first word of each text) of a slice of texts."""
    lower, word = _tables()
    data = lower[data]
    starts, ends = token_bounds(word[data], offsets)
    return data, starts, ends, run_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix64(h)


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash (the rightmost of equal ones) of each ``width`` neighbours, once each."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for i in range(1, width):
        nxt = grams[i : i + n]
        less = nxt <= least
        least[less] = nxt[less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at)


def kind_of(n: int) -> tuple[int, int, int]:
    """(words of a gram, grams of a window, words of a span) for an item of ``n`` words."""
    return (GRAM_WORDS, WINDOW_WORDS - GRAM_WORDS + 1, WINDOW_WORDS) if n >= WINDOW_WORDS else (n, 1, n)


class Block:
    """Fingerprints of some benchmark items, by gram length and window width, and their words, all as arrays.

    Words are numbered over all items; ``first`` has each item's first word. Of each kind, ``prints`` has the fingerprints
    in order and the words they begin at.
    """

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [item for item, _ in items]
        found, first, n_bytes, n_words = [], [np.zeros(1, np.int64)], 0, 0
        for _, _, raw, offsets in byte_slices(pa.array([text for _, text in items], pa.string())):
            data, starts, ends, hashes, at = words_of(raw, offsets)
            found.append((data, starts + n_bytes, ends + n_bytes, hashes))
            first.append(at[1:] + n_words)
            n_bytes, n_words = n_bytes + len(data), n_words + len(starts)
        self.data, self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.uint8, np.int64, np.int64, np.uint64))
        self.first = np.concatenate(first)
        rows: dict = {}
        for i in np.flatnonzero(np.diff(self.first)).tolist():
            lo, hi = self.first[i], self.first[i + 1]
            k, width, least = kind_of(int(hi - lo))
            grams = gram_hashes(self.hashes[lo:hi], k)
            picked = winnow(grams, width)
            rows.setdefault((k, width, least), []).append((grams[picked], picked + lo))
        self.prints = {}
        for kind, some in rows.items():
            grams, places = (np.concatenate(x) for x in zip(*some))
            order = np.argsort(grams, kind="stable")
            self.prints[kind] = grams[order], places[order]

    def n_bytes(self) -> int:
        """Bytes of the arrays."""
        return sum(x.nbytes for x in (self.data, self.starts, self.ends, self.hashes, self.first, *(a for pair in self.prints.values() for a in pair)))

    def _long(self, hashes: np.ndarray, p: int, places: np.ndarray, least: int) -> np.ndarray:
        """Of ``places`` where the item's words equal those around ``p``, those with ``least`` words in a row, as far as hashes tell."""
        item = np.searchsorted(self.first, places, "right") - 1
        lo, hi, n = self.first[item], self.first[item + 1], np.zeros(len(places), np.int64)
        for steps in (range(least), range(-1, -least, -1)):
            same = np.ones(len(places), bool)
            for d in steps:
                if not 0 <= p + d < len(hashes):
                    break
                same &= (places + d >= lo) & (places + d < hi)
                same[same] = self.hashes[places[same] + d] == hashes[p + d]
                n += same
        return places[n >= least]

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Of one text: the word spans that windows of items cover, and the items with windows there."""
        spans, items, done, n = [], set(), {}, len(hashes)
        for (k, width, least), (known, where) in self.prints.items():
            grams = gram_hashes(hashes, k)
            if not len(grams) or n < least:
                continue
            picked = winnow(grams, width)
            from_, to = np.searchsorted(known, grams[picked], "left"), np.searchsorted(known, grams[picked], "right")
            hit = np.flatnonzero(to > from_)
            for p, lo, hi in zip(picked[hit].tolist(), from_[hit].tolist(), to[hit].tolist()):
                places = where[lo:hi] if hi - lo < MANY_PLACES else self._long(hashes, p, where[lo:hi], least)
                for q, i in zip(places.tolist(), (np.searchsorted(self.first, places, "right") - 1).tolist()):
                    if done.get((i, p - q), -1) > p:
                        continue
                    begin, end = self.first[i], self.first[i + 1]
                    a, b = p, q
                    while a and b > begin and hashes[a - 1] == self.hashes[b - 1]:
                        a, b = a - 1, b - 1
                    e, f = p, q
                    while e < n and f < end and hashes[e] == self.hashes[f]:
                        e, f = e + 1, f + 1
                    done[i, p - q] = max(e, p + 1)
                    if e - a >= least and all(data[starts[a + x] : ends[a + x]].tobytes() == self.data[self.starts[b + x] : self.ends[b + x]].tobytes() for x in range(e - a)):
                        spans.append((a, e))
                        items.add(i)
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _search(block, names: list[str]):
    """Over batches (…, text): the other columns, and number of words, spans and items of each text."""

    def run(batches):
        own = block.value
        for batch in batches:
            counts, spans, items = np.zeros(batch.num_rows, np.int64), [[]] * batch.num_rows, [[]] * batch.num_rows
            for first, last, raw, offsets in byte_slices(batch.column(batch.num_columns - 1)):
                data, starts, ends, hashes, at = words_of(raw, offsets)
                counts[first:last] = np.diff(at)
                for row in range(first, last):
                    lo, hi = at[row - first], at[row - first + 1]
                    if hi > lo and (found := own.spans(data, starts[lo:hi], ends[lo:hi], hashes[lo:hi]))[1]:
                        spans[row], items[row] = _merged(found[0]), [own.names[i] for i in found[1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [*names, "__n_words", "__spans", "__items"])

    return run


def _fingerprinted(kinds: list[tuple[int, int, int]] | None, spans: bool = False):
    """Over batches (key, text): (key, hash) of the winnowed grams of each text, or of all its ``spans`` of the length that counts, of all ``kinds`` or of its own; one row an equal hash."""

    def run(batches):
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for first, last, raw, offsets in byte_slices(batch.column(1)):
                _, _, _, hashes, at = words_of(raw, offsets)
                for row in range(first, last):
                    words = hashes[at[row - first] : at[row - first + 1]]
                    for k, width, least in kinds if kinds is not None else [kind_of(len(words))] * bool(len(words)):
                        if len(words) >= least:
                            grams = gram_hashes(words, least if spans else k)
                            out.append((row, np.unique(mix64((grams if spans else grams[winnow(grams, width)]) ^ np.uint64(least)))))
                    if sum(len(h) for _, h in out) > 1 << 18:
                        yield _prints(keys, out)
                        out = []
            yield _prints(keys, out)

    return run


def _prints(keys: list[bytes], found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    owner = np.repeat([row for row, _ in found], [len(h) for _, h in found]) if found else np.zeros(0, np.int64)
    hashes = np.concatenate([h for _, h in found]).view(np.int64) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(owner, pa.int64())), pa.array(hashes)], ["key", "h"])


def _extended(batches):
    """Over rows (key, kind, item, text) sorted by them, a text before its items: (key, spans, items) of each text with a hit."""
    now, text, spans, items = None, None, [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([_merged(spans)], pa.list_(pa.int64())), pa.array([items], pa.list_(pa.string()))], ["key", "__spans", "__items"])

    for batch in batches:
        for key, kind, item, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if items:
                    yield out()
                now, text, spans, items = key, None, [], []
            if kind == 0:
                if text is None:
                    whole = np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)
                    text = words_of(whole, np.array([0, len(whole)]))[:4]
            elif text is not None and (found := Block([(item, raw)]).spans(*text))[1]:
                spans += found[0]
                items.append(item)
                if len(spans) > 4096:
                    merged = _merged(spans)
                    spans = list(zip(merged[::2], merged[1::2]))
    if items:
        yield out()


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows`` (…, __text) with __spans and __items of ``items`` (item, text) of any number, by joins.

    Texts and items become winnowed fingerprints; a semi-join on their hashes tells which texts have one of any item's.
    Those texts alone are asked further: hashes of their spans of the length that counts meet those of items, so pairs of a
    text and an item are formed only where a span is shared, not where a common gram is. Texts with such a pair are shipped,
    once each, with the items to extend the hits over. All sides of joins are written tables or plain shuffles, so that
    Spark splits what a common passage makes large.
    """
    digest = F.unhex(F.md5(F.col("text")))
    texts = rows.select(F.col("__text").alias("text")).where("text is not null").select(digest.alias("key"), "text")
    named = items.select(F.unhex(F.md5(F.concat(F.lit("item:"), "item", F.lit(":"), "text"))).alias("key"), "item", "text").dropDuplicates(["key"])
    named = materialize(named, "items")
    lengths = named.select(F.least(F.regexp_count("text", F.lit(JVM_WORD)), F.lit(WINDOW_WORDS)).alias("n")).where("n > 0").distinct()
    kinds = sorted(kind_of(r["n"]) for r in lengths.collect())  # WINDOW_WORDS rows at most
    wanted = materialize(named.select("key", "text").mapInArrow(_fingerprinted(None), "key binary, h bigint").select("h").distinct(), "item-prints")
    held = materialize(texts.mapInArrow(_fingerprinted(kinds), "key binary, h bigint").distinct(), "prints")
    near = materialize(held.join(wanted.hint("merge"), "h", "left_semi").select("key").distinct(), "near")
    near = materialize(texts.join(near.hint("merge"), "key", "left_semi").dropDuplicates(["key"]), "near-texts")
    wanted = materialize(named.select("key", "text").mapInArrow(_fingerprinted(None, True), "key binary, h bigint").withColumnRenamed("key", "item_key"), "item-spans")
    held = materialize(near.mapInArrow(_fingerprinted(kinds, True), "key binary, h bigint"), "spans")
    pairs = materialize(held.join(wanted.hint("merge"), "h").select("key", "item_key").distinct(), "pairs")
    asked = near.join(pairs.select("key").distinct().hint("merge"), "key", "left_semi").select("key", F.lit(0).alias("kind"), F.lit("").alias("item"), "text")
    over = pairs.join(named.withColumnRenamed("key", "item_key"), "item_key").select("key", F.lit(1).alias("kind"), "item", "text")
    found = asked.unionByName(over).repartition("key").sortWithinPartitions("key", "kind", "item").mapInArrow(_extended, "key binary, __spans array<bigint>, __items array<string>")
    found = materialize(found.withColumnRenamed("key", "__found"), "hits")
    out = rows.withColumn("__key", F.unhex(F.md5(F.col("__text")))).join(found.hint("merge"), F.col("__key") == F.col("__found"), "left")
    empty = F.array()
    return out.withColumns({"__spans": F.coalesce("__spans", empty.cast("array<bigint>")), "__items": F.coalesce("__items", empty.cast("array<string>"))}).drop("__key", "__found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) of each row of ``docs``, and n_words, n_hit, n_items, items_sha256, contaminated, hit_spans, items.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in the text, A-Z in lower case. An item's windows are its runs
    of 10 words, or all its words if they are fewer; a document's word is hit if it lies in an occurrence of a window.
    hit_spans are [from, to) pairs of word positions, flat, in order and disjoint. A null text, of a document or an item,
    has no words; an item without words has no window; items that repeat an id count once; a null id counts as empty.
    Texts that repeat have equal results, very long ones are searched whole. Result columns replace columns of ``docs``
    that have their names. An empty table on either side gives no hit.

    The benchmark's size is measured, as what a worker would hold of it. Up to BLOCK_BYTES, its fingerprints travel with the
    tasks: documents are read once and nothing is shuffled. Beyond, fingerprints of both sides meet in a shuffle join, see
    ``_joined``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    results = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "items"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    text = F.col(text_col).cast("string")
    rows = docs.select(*[F.col(c) for c in kept], text.alias("__text"))
    listed = benchmark.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    size = F.octet_length("item") + ITEM_BYTES + F.octet_length("text") + WORD_BYTES * F.regexp_count("text", F.lit(JVM_WORD))
    if (listed.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BLOCK_BYTES:
        block = spark.sparkContext.broadcast(Block([(r["item"], r["text"]) for r in listed.collect()]))
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "__n_words bigint, __spans array<bigint>, __items array<string>"])
        state = rows.mapInArrow(_search(block, kept), schema)
    else:
        state = _joined(rows.withColumn("__n_words", F.coalesce(F.regexp_count("__text", F.lit(JVM_WORD)), F.lit(0)).cast("long")), listed)
    items = F.array_sort(F.array_distinct("__items"))
    ends = F.filter("__spans", lambda _, i: i % 2 == 1)
    begins = F.filter("__spans", lambda _, i: i % 2 == 0)
    total = F.aggregate(F.zip_with(ends, begins, lambda e, b: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    return state.select(
        *[F.col(c) for c in kept],
        F.col("__n_words").alias("n_words"),
        total.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
        F.col("__spans").alias("hit_spans"),
        items.alias("items"),
    )
