"""Near-duplicate removal by SimHash fingerprints, Golay-code fuzzy hashing and exact Jaccard similarity of five-word shingles.

A bit of a fingerprint is the majority of a bit of the text's distinct shingle hashes, as in op5, and a fingerprint has as
many bits as it takes: PRINT_BITS that are compared, and a word of the Golay code [23, 12, 7] for each table. A table's key
is the codeword's index. Two texts at a similarity of 0.8 differ in 15 of 100 bits, beyond what one word corrects, so of the
codewords that ``golay_indices`` finds near a word the key takes the one that the votes disagree with least, and there are
TABLES words: such texts are candidates with probability 1 - 3e-6 (few shingles: 1 - 1e-5), more similar ones with more.
From 2^18 texts on, keys have a sign bit of the next word more for each doubling, and there are more tables, so that buckets
of unrelated texts stay at BUCKET_TEXTS and the chance of a pair stays what it is. Texts of a bucket whose fingerprints are
at most PRINT_DISTANCE bits apart, or are joined by such, are a group of candidates.

The texts of a group are then compared by their sets of shingle hashes, so only pairs at SIMILARITY or more are linked. (Groups
of different buckets aren't merged: chains of half-similar texts would grow with the corpus.)
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize, mix64
from .components import connected_components
from .simhash_golay import CODE_BITS, golay_indices, golay_tables, shingle_hashes

SHINGLE_WORDS = 5
#: At least SIMILARITY[0] / SIMILARITY[1] of the shingles of two linked texts are common to both.
SIMILARITY = (4, 5)
#: Bits of a fingerprint that are compared, and in how many of them candidates may differ.
PRINT_BITS, PRINT_DISTANCE = 128, 40
#: Tables where a key is an index alone, and how many times as many each sign bit takes: 1 / (1 - 0.16).
TABLES, TABLES_A_BIT = 64, 1.19
#: Unrelated texts that a bucket may have at even spread.
BUCKET_TEXTS = 64
#: Rows that are compared at a time, members of a bucket of which all pairs are, and members that are compared by stars.
PIECE_ROWS, ALL_PAIRS, BUCKET_MEMBERS = 1 << 16, 256, 1 << 18
#: Bytes of shingle hashes that one task compares at once, and what a member costs besides its hashes, as a number of those.
BUCKET_BYTES, MEMBER_HASHES = 8 << 20, 16
#: Members of a larger group that all its blocks are compared with.
PIVOTS = 8


def key_shape(texts: int) -> tuple[int, int]:
    """Tables and sign bits of a key for so many distinct texts."""
    bits = max(0, math.ceil(math.log2(max(1, texts) / BUCKET_TEXTS)) - 12)
    return math.ceil(TABLES * TABLES_A_BIT**bits), bits


def votes(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """Of each bit of a fingerprint: how many more of the distinct ``hashes`` have it than not."""
    factors = mix64(np.arange(1, -(-n_bits // 64) + 1, dtype=np.uint64)) | np.uint64(1)
    ones = np.zeros(64 * len(factors), np.int64)
    for at in range(0, len(hashes), 255):
        part = mix64(hashes[at : at + 255, None] * factors).astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return (2 * ones[:n_bits] - len(hashes)).astype(np.int32)


def nearest_indices(votes: np.ndarray) -> np.ndarray:
    """Of words given as votes (n, 23): the index of that of ``golay_indices`` whose codeword goes against the fewest votes."""
    words = ((votes > 0).astype(np.int64) << np.arange(CODE_BITS)).sum(1)
    near, used = golay_indices(words)
    t = golay_tables()
    errors = t["errors"][t["low"][words & 0xFFF] ^ t["high"][words >> 12]]
    against = np.stack([(np.abs(votes) * (e[:, None] >> np.arange(CODE_BITS) & 1)).sum(1) for e in errors.T], 1)
    against[~used] = np.iinfo(against.dtype).max
    return near[np.arange(len(near)), against.argmin(1)]


def print_keys(votes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Votes (texts, bits) to fingerprints (texts, 2) and a key a table; texts without words have only zeros for votes."""
    prints = np.packbits(votes[:, :PRINT_BITS] > 0, axis=1, bitorder="little").view("<u8")
    words = votes[:, PRINT_BITS:].reshape(len(votes), -1, CODE_BITS)
    index = nearest_indices(words.reshape(-1, CODE_BITS)).reshape(words.shape[:2])
    signs = ((np.roll(words, -1, 1)[:, :, :bits] > 0).astype(np.int64) << np.arange(bits)).sum(2)
    return prints, (np.arange(words.shape[1]) << 12 | index) << bits | signs


def looked_up(hashes: np.ndarray) -> list[np.ndarray]:
    """The sets that a text is found by: its own, and with five shingles those of four too.

    A set of four and one more is the pair whose bits differ most, 0.19; all other pairs at SIMILARITY differ in at most 0.16.
    """
    return [hashes, *(np.delete(hashes, i) for i in range(5))] if len(hashes) == 5 else [hashes]


def shingle_set(text: bytes) -> np.ndarray:
    parts = list(shingle_hashes(text, SHINGLE_WORDS))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def similar_stars(ids: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links (member, least member) of the components that similar sets form. Members already reached are not compared again."""
    whole, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    own = [flat[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
    size, mark = np.diff(bounds), np.zeros(len(whole), np.int8)
    left, a, b = np.arange(len(ids)), [], []
    while len(left):
        group, todo, left = [left[0]], [left[0]], left[1:]
        stale = True
        while todo and len(left):
            x = todo.pop()
            if stale:
                joined, ends, stale = np.concatenate([own[i] for i in left]), np.concatenate(([0], np.cumsum(size[left]))), False
            mark[own[x]] = 1
            upto = np.concatenate(([0], np.cumsum(mark[joined], dtype=np.int64)))
            mark[own[x]] = 0
            common = upto[ends[1:]] - upto[ends[:-1]]
            hit = common * SIMILARITY[1] >= (size[left] + size[x] - common) * SIMILARITY[0]
            if hit.any():
                group += left[hit].tolist()
                todo += left[hit].tolist()
                left, stale = left[~hit], True
        least = min(ids[i] for i in group)
        a += [ids[i] for i in group if ids[i] != least]
        b += [least] * (len(a) - len(b))
    return a, b


def _printed(tables: int, bits: int):
    """Rows (node, text) to (node, fingerprint of two longs, keys)."""

    def run(batches):
        for batch in batches:
            nodes, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary())
            for at in range(0, len(nodes), 64):
                found, owners = [], []
                for node, text in zip(nodes[at : at + 64], texts[at : at + 64].to_pylist()):
                    for hashes in looked_up(shingle_set(text or b"")):
                        found.append(votes(hashes, PRINT_BITS + CODE_BITS * tables))
                        owners.append(node)
                prints, keys = print_keys(np.stack(found), bits)
                columns = [pa.array(owners, pa.int64()), *(pa.array(p.view(np.int64)) for p in np.ascontiguousarray(prints.T)), pa.array([k.tobytes() for k in keys], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "x", "y", "keys"])

    return run


def _keyed(batches):
    for batch in batches:
        node, x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        keys = [np.frombuffer(k, np.int64) for k in batch.column(3).to_pylist()]
        step = max(1, PIECE_ROWS // len(keys[0])) if keys else 1
        for at in range(0, len(keys), step):
            part = keys[at : at + step]
            n = len(part[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), *(pa.array(np.repeat(c[at : at + step], n)) for c in (node, x, y))], ["key", "node", "x", "y"])


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which fingerprints (two longs on the last axis) are at most PRINT_DISTANCE bits apart."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.uint8) <= PRINT_DISTANCE


def bucket_links(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key: (key, a, b), where b is the first node of the bucket's group of near fingerprints that a is in."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    root = np.arange(len(keys))
    at, place = np.flatnonzero(np.repeat(sizes, sizes) <= ALL_PAIRS), np.repeat(starts + sizes, sizes)
    i, j, d = [], [], 1
    while len(at := at[at + d < place[at]]):
        hit = at[_near(prints[at], prints[at + d])]
        i, j, d = [*i, hit], [*j, hit + d], d + 1
    if i:
        i, j = np.concatenate(i), np.concatenate(j)
        while (root[i] != root[j]).any():
            least = np.minimum(root[i], root[j])
            np.minimum.at(root, root[i], least)
            np.minimum.at(root, root[j], least)
            root = root[root]
    for start, size in zip(starts[sizes > ALL_PAIRS], sizes[sizes > ALL_PAIRS]):
        left = np.arange(start, start + size)
        if size > BUCKET_MEMBERS:
            root[left], left = start, left[:0]
        while len(left):
            first, todo, left = left[0], left[:1], left[1:]
            while len(todo) and len(left):
                hit = _near(prints[left], prints[todo[0]])
                for ask in todo[1:16]:
                    hit |= _near(prints[left], prints[ask])
                root[left[hit]] = first
                todo, left = np.concatenate([todo[16:], left[hit]]), left[~hit]
    linked = nodes != nodes[root]
    return keys[linked], nodes[linked], nodes[root[linked]]


def _candidates(batches):
    """Rows (key, node, x, y) sorted by key to groups, as rows (key, a, b). A bucket of over BUCKET_MEMBERS is a group as it passes, as each pair in it is compared later."""
    held, n, whole = [], 0, None

    def out(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, a, b)], ["key", "a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        if whole is not None:
            same = int(np.searchsorted(rows[:, 0], whole[0], "right"))
            yield out(rows[:same, 0], rows[:same, 1], np.full(same, whole[1]))
            rows = rows[same:]
            whole = whole if not len(rows) else None
        held, n = [*held, rows], n + len(rows)
        if n < PIECE_ROWS:
            continue
        rows = np.concatenate(held)
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
        if last:
            yield out(*bucket_links(rows[:last, 0], rows[:last, 1], rows[:last, 2:].view(np.uint64)))
        rows = rows[last:]
        if len(rows) > BUCKET_MEMBERS:
            whole = rows[0, 0], rows[0, 1]
            yield out(rows[:, 0], rows[:, 1], np.full(len(rows), whole[1]))
            rows = rows[:0]
        held, n = [rows], len(rows)
    rows = np.concatenate(held) if n else None
    if n:
        yield out(*bucket_links(rows[:, 0], rows[:, 1], rows[:, 2:].view(np.uint64)))


def _sets(batches):
    for batch in batches:
        sets = [shingle_set(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "hashes"])


def _similar(batches):
    """Over rows (deal, node, hashes) sorted by deal: the links of each deal."""
    now, held = None, {}
    for batch in batches:
        a, b = [], []
        for deal, node, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if deal != now:
                if len(held) > 1:
                    more = similar_stars(list(held), list(held.values()))
                    a, b = a + more[0], b + more[1]
                now, held = deal, {}
            held[node] = np.frombuffer(hashes, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    if len(held) > 1:
        a, b = similar_stars(list(held), list(held.values()))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compared(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """``dealt`` (deal, node) to the links that the nodes of each deal have among themselves."""
    rows = dealt.join(sets.select("node", "hashes"), "node").select("deal", "node", "hashes")
    return rows.repartition("deal").sortWithinPartitions("deal").mapInArrow(_similar, "a bigint, b bigint").distinct()


def similar_links(texts: DataFrame, classes: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """``texts`` (node: hash of the text, id, text) and ``classes`` (node, first_id; a row a node) to links (a, b) of nodes.

    One shuffle deals (key, node, fingerprint) by key. Groups with the same members are compared once, each in one task.
    ``_links_of_large`` takes those of over BUCKET_BYTES of hashes. Tables that the links are read from are added to
    ``spent``, for the caller to delete when the links are written.
    """
    tables, bits = key_shape(classes.count())
    prints = texts.select("node", "text").mapInArrow(_printed(tables, bits), "node bigint, x bigint, y bigint, keys binary").distinct()
    prints = materialize(prints, "prints")
    found = prints.mapInArrow(_keyed, "key bigint, node bigint, x bigint, y bigint").repartition("key").sortWithinPartitions("key")
    found = materialize(found.mapInArrow(_candidates, "key bigint, a bigint, b bigint").where("a <> b"), "candidates")
    discard(prints)
    group = F.xxhash64("key", "b").alias("key")
    keys = materialize(found.select(group, F.explode(F.array("a", "b")).alias("node")).distinct(), "groups")
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"))
    groups = groups.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = materialize(keys.join(groups, "key").select("key", "node"), "members")
    discard(found)
    need = members.select("node").distinct().join(classes, "node").select(F.col("node").alias("__node"), F.col("first_id").alias("__id"))
    sets = texts.join(need.hint("merge"), (F.col("node") == F.col("__node")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("node", "text")
    sets = materialize(sets.mapInArrow(_sets, "node bigint, n bigint, hashes binary"), "sets")
    cost = F.sum(F.col("n") + MEMBER_HASHES)
    blocks = F.ceil(cost * F.lit(16 / BUCKET_BYTES)).cast("long")
    sizes = members.join(sets.select("node", "n"), "node").groupBy("key").agg(F.when(cost * 8 > BUCKET_BYTES, blocks).otherwise(F.lit(1).cast("long")).alias("blocks"))
    discard(keys)
    sizes = materialize(sizes, "sizes")  # so that Spark can split a group that many texts are in
    spent += [members, sets, sizes]
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return _compared(members.select(F.xxhash64("key", F.lit(0).cast("long")).alias("deal"), "node"), sets)
    small = members.join(sizes.where("blocks = 1"), "key").select(F.xxhash64("key", F.lit(0).cast("long")).alias("deal"), "node")
    return _links_of_large(small, members.join(large, "key"), sets)


def _links_of_large(small: DataFrame, large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the deals ``small`` (deal, node) and of groups too large for a task, ``large`` (key, node, blocks).

    A large group is cut in blocks by hash. First each block is compared within itself and with PIVOTS members of the group,
    which leaves a group of near copies one component. Then only members outside the group's largest component still have to
    meet the rest: they go to every block while they fit in a task, else the group is dealt as pairs of blocks. So every
    pair of members has met or is in one component, and what is dealt grows with the group unless it holds much else.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    large = large.join(sets.select("node", "n"), "node").select("key", "node", (F.col("n") + MEMBER_HASHES).alias("n"), "blocks", own.alias("own"))
    large = materialize(large, "large")
    pivots = large.groupBy("key", "blocks", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(PIVOTS))).agg(F.min("node").alias("node"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    first = large.select("key", "own", "node").unionByName(pivots.select("key", every.alias("own"), "node"))
    links = small.unionByName(first.select(F.xxhash64("key", "own").alias("deal"), "node"))
    links = materialize(_compared(links, sets), "near")
    roots = connected_components(links).withColumnRenamed("node", "member")
    state = large.join(roots, F.col("node") == F.col("member"), "left").select("key", "node", "n", "blocks", "own", F.coalesce("root", "node").alias("root"))
    state = materialize(state, "rooted")
    shares = state.groupBy("key", "root").agg(F.sum("n").alias("n"))
    shares = shares.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("total")).where("total > most.n")
    shares = materialize(shares.select("key", F.col("most.root").alias("main"), ((F.col("total") - F.col("most.n")) * 8 <= BUCKET_BYTES).alias("few")), "shares")
    left = state.join(shares, "key")
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    left = left.withColumn("other", F.explode(F.when(F.col("few") & (F.col("root") == F.col("main")), F.array("own")).otherwise(others)))
    at = F.when(F.col("few"), F.col("other")).otherwise(F.col("own"))
    dealt = left.select(F.xxhash64("key", F.least(at, "other"), F.greatest(at, "other")).alias("deal"), "node")
    return links.unionByName(_compared(dealt, sets))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of similar texts the row with the least id (of equal ids, the least text hash), all columns as they came.

    Texts at a Jaccard similarity of at least SIMILARITY, and texts without words among themselves, are linked. Of rows
    that repeat id and text one stays, the first by its columns as JSON. Rows that share an id but whose texts aren't
    linked all stay. Rows of a component without any id are kept, as nothing tells them apart. A null text counts as empty;
    texts are read whole, whatever their length. Columns come back as they were, whatever their names. An empty table gives
    an empty one.
    """
    bound_batches(docs.sparkSession)
    node = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    texts = docs.select(node.alias("node"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    classes, spent = materialize(texts.groupBy("node").agg(F.min("id").alias("first_id")), "classes"), []
    roots = connected_components(similar_links(texts, classes, spent)).withColumnRenamed("node", "member")
    discard(*spent)  # the components are written
    classes = classes.join(roots, F.col("node") == F.col("member"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    classes = materialize(classes, "rooted")
    least = classes.groupBy("root").agg(F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "node"))).alias("least"))
    least = materialize(least, "least")  # so that Spark can split a component with a large share of the classes
    found = classes.join(least, "root").where("least is null or node = least.node").select(F.col("node").alias("__kept_node"), F.col("first_id").alias("__kept_id"))
    # Kept ids grow with the documents, so they are never broadcast, whatever a small run's statistics say.
    keyed = docs.withColumn("__node", node)
    out = keyed.join(found.hint("merge"), (F.col("__node") == F.col("__kept_node")) & F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")
    repeats = texts.where("id is not null").groupBy("node", "id").count().where("count > 1")
    if repeats.isEmpty():
        return out.drop("__node")
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = out.where(F.col(id_col).isNotNull()).groupBy("__node", id_col).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return out.where(F.col(id_col).isNull()).drop("__node").unionByName(once)
