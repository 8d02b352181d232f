"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut in segments of 22, 21 and 21 bits, each padded with zeros to a word of the perfect
binary Golay code [23, 12, 7]. ``golay_indices`` decodes a word to the codeword at distance 3 or less and, where that
distance is 3, also to the five codewords at distance 4. Two words that differ in at most two bits then share an index:
if either is within 2 of a codeword, the other is within 4 of it; if both are at distance 3 from different codewords,
the design S(4, 7, 23) gives a codeword at distance 4 from both.

Pigeonhole over at most four differing bits leaves two cases, and every pair shares a key in one of them:

* some segment has no error; of the other two, one has at most two: key (that segment, Golay index of the other);
* each segment has an error; then two have exactly one, so a half of each is free of errors, and the third at most
  two: key (a half, a half, Golay index of the third).

Keys hold 33 bits or more, so buckets of unrelated fingerprints stay small at any size of corpus.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: The code's generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 and its lengths.
GENERATOR, CODE_BITS, CHECK_BITS = 0b110001110101, 23, 11
#: Lowest bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members that a bucket may have for all its pairs to be compared at once, and to be held by one task.
ALL_PAIRS, BUCKET_MEMBERS = 64, 16384
PIECE_BYTES = 1 << 20
_tables: dict = {}


def _remainder(word: int) -> int:
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


def golay_tables() -> dict:
    """Syndromes of the low 12 and high 11 bits, and six error patterns a syndrome (those beyond the first are 0 where unused)."""
    if not _tables:
        low = np.array([_remainder(x) for x in range(1 << 12)], np.int32)
        high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int32)
        errors = np.zeros((1 << CHECK_BITS, 6), np.int64)
        used = np.zeros((1 << CHECK_BITS, 6), bool)
        used[:, 0] = True
        fill = np.ones(1 << CHECK_BITS, np.int32)
        weight = np.zeros(1 << CHECK_BITS, np.int32)
        for k in (1, 2, 3, 4):
            for bits in itertools.combinations(range(CODE_BITS), k):
                e = sum(1 << b for b in bits)
                s = low[e & 0xFFF] ^ high[e >> 12]
                if k < 4:
                    errors[s, 0], weight[s] = e, k
                elif weight[s] == 3:
                    errors[s, fill[s]], used[s, fill[s]] = e, True
                    fill[s] += 1
        _tables.update(low=low, high=high, errors=errors, used=used)
    return _tables


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each 23-bit word: six 12-bit indices of near codewords, and which of them are in use."""
    t = golay_tables()
    syndrome = t["low"][words & 0xFFF] ^ t["high"][words >> 12]
    return (words[:, None] ^ t["errors"][syndrome]) >> CHECK_BITS, t["used"][syndrome]


def fuzzy_keys(prints: np.ndarray):
    """Yield (keys, mask) arrays over the fingerprints; two fingerprints at most four bits apart share a key."""
    segments = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    halves = [[s & 0x7FF, s >> 11] for s in segments]
    near = [golay_indices(s) for s in segments]
    tag = 0
    for i, j in itertools.permutations(range(3), 2):
        for t in range(6):
            yield (segments[i] << 12 | near[j][0][:, t]) | tag << 40, near[j][1][:, t]
        tag += 1
    for i, (j, k) in enumerate(((1, 2), (0, 2), (0, 1))):
        for a, b in itertools.product(range(2), repeat=2):
            for t in range(6):
                yield (halves[j][a] << 23 | halves[k][b] << 12 | near[i][0][:, t]) | tag << 40, near[i][1][:, t]
            tag += 1


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS):
    """Yield arrays of XXH64 (seed 42) over the shingles of a text, in pieces of bounded size."""
    digest, carry, at, n, seen = xxhash.xxh64_intdigest, [], 0, len(text), False
    while at < n:
        end = n
        if n - at > PIECE_BYTES and (m := re.compile(rb"[\x20\x09-\x0D]").search(text, at + PIECE_BYTES)):
            end = m.end()
        tokens = carry + text[at:end].lower().split()
        at = end
        if len(tokens) >= words:
            whole = b" ".join(tokens)
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
            yield np.array([digest(whole[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist())], np.uint64)
            seen, carry = True, tokens[len(tokens) - words + 1 :]
        else:
            carry = tokens
    if not seen and carry:
        yield np.array([digest(b" ".join(carry), 42)], np.uint64)


def fingerprint(text: bytes | None) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; 0 without words."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text or b""):
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(part)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), _signed(np.array([fingerprint(t) for t in texts], np.uint64))], ["doc_id", "fp"])


def _keyed(batches):
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(prints), 2048):
            part = prints[at : at + 2048]
            keys, owners = [], []
            for key, used in fuzzy_keys(part):
                keys.append(key[used])
                owners.append(part[used])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), _signed(np.concatenate(owners))], ["key", "fp"])


def bucket_stars(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of the components that members at most MAX_BITS apart form. Members already reached are not compared again."""
    left, a, b = members, [], []
    while len(left):
        group, todo, left = [left[:1]], left[:1], left[1:]
        while len(todo) and len(left):
            ask, todo = todo[:128], todo[128:]
            hit = (np.bitwise_count(left[None, :] ^ ask[:1, None]) <= MAX_BITS)[0]
            for at in range(0, len(left), 8192):
                part = left[at : at + 8192]
                hit[at : at + 8192] |= (np.bitwise_count(part[None, :] ^ ask[:, None]) <= MAX_BITS).any(0)
            group.append(left[hit])
            todo = np.concatenate([todo, left[hit]])
            left = left[~hit]
        group = np.concatenate(group)
        least = group.view(np.int64).min()
        others = group.view(np.int64)[group.view(np.int64) != least]
        a.append(others)
        b.append(np.full(len(others), least))
    return np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)


def _linked(defer: bool):
    """Over rows sorted by bucket: links of complete buckets. With defer, buckets over BUCKET_MEMBERS come back as (member, null, bucket)."""

    def out(a, b, key=None):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(n, pa.int64()) if key is None else pa.array(np.full(n, key, np.int64))], ["a", "b", "key"])

    def whole(keys, prints):
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        size = np.repeat(sizes, sizes)
        small = (size > 1) & (size <= ALL_PAIRS)
        k, p = keys[small], prints[small]
        for d in range(1, ALL_PAIRS):
            same = k[d:] == k[:-d]
            if not same.any():
                break
            x, y = p[d:][same], p[:-d][same]
            near = (np.bitwise_count(x ^ y) <= MAX_BITS) & (x != y)
            x, y = x[near].view(np.int64), y[near].view(np.int64)
            if len(x):
                pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0)
                yield out(pairs[:, 0], pairs[:, 1])
        for at, n in zip(starts[sizes > ALL_PAIRS], sizes[sizes > ALL_PAIRS]):
            yield out(*bucket_stars(np.unique(prints[at : at + n])))

    def run(batches):
        keys, prints, deferred = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            if deferred is not None:
                n = int(np.searchsorted(keys, deferred, "right"))
                yield out(prints[:n].view(np.int64), None, deferred)
                keys, prints = keys[n:], prints[n:]
                if not len(keys):
                    continue
                deferred = None
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield from whole(keys[:last], prints[:last])
                keys, prints = keys[last:], prints[last:]
            if defer and len(keys) > BUCKET_MEMBERS:
                deferred = keys[0]
                yield out(prints.view(np.int64), None, deferred)
                keys, prints = keys[:0], prints[:0]
        if len(keys):
            yield from whole(keys, prints)

    return run


def near_links(prints: DataFrame) -> DataFrame:
    """``prints`` (fp: bigint, distinct) to links (a, b) whose components are those of all pairs at most four bits apart.

    One shuffle deals (key, fp) by key. A task compares a bucket's members where they lie and emits a star, never all
    pairs. Buckets of over BUCKET_MEMBERS fingerprints, which a task passes through unread, are cut in blocks by hash
    and dealt again as pairs of blocks, so that each pair of members still meets in one task.
    """
    bound_batches(prints.sparkSession)
    found = prints.select("fp").mapInArrow(_keyed, "key bigint, fp bigint").repartition("key").sortWithinPartitions("key").mapInArrow(_linked(True), "a bigint, b bigint, key bigint")
    found = materialize(found.distinct(), "buckets")
    links = found.where("b is not null").select("a", "b")
    large = found.where("b is null")
    if not large.isEmpty():
        sizes = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(BUCKET_MEMBERS)).cast("long").alias("blocks"))
        dealt = large.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("a"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.col("a").alias("fp"))
        more = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(False), "a bigint, b bigint, key bigint")
        links = links.unionByName(more.select("a", "b"))
    return links.distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``; other columns are ignored, whatever their names.

    Rows whose fingerprints differ in at most four bits are linked; component_id is the least non-null doc_id reachable
    by links, null if a component has only null ids. Null and empty texts, and texts of white space, have fingerprint 0
    and are linked like any other. Repeated rows come back as often as they come in. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(prints.mapInArrow(_fingerprints, "doc_id bigint, fp bigint"), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(near_links(classes))
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # Both sides of the join are written, so Spark splits the partition of a component with a large share of the classes.
    classes = materialize(classes, "rooted")
    least = materialize(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    classes = materialize(classes.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
