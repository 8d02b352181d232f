"""Hard negatives by blocked dense products.

Anchors are cut in blocks of bounded bytes. A block's float64 matrix is broadcast and every partition of candidates is
multiplied with it tile by tile, twice: the first pass keeps each anchor's best rows of its own label, the second each
window's best rows of other labels. What a task keeps is as long as the block, not as its partition, and partial lists
merge by a shuffle on the anchor. Products are exact: where a sum could reach 2^53, integers take the place of floats.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize

#: Bytes and rows of one block of anchors; further anchors come in further blocks.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 16384
#: Rows of a tile of anchors and of candidates; the first tiles of a task are smaller, so that limits rise early.
TILE_ANCHORS, TILE_ROWS, FIRST_ROWS = 1024, 4096, 64
#: Products that one task computes at most, about; more candidates are dealt to more tasks.
TASK_PRODUCTS = 1 << 37
#: Sums of products below this are exact in float64.
EXACT = 1 << 53
_VECTOR = "vec_id bigint, label bigint, v array<bigint>"


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows of (vec_id, embedding, label) that take part, each component x as floor(scale * x).

    Rows with a null id, label or vector, or any component that is null or not finite, take no part.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def _matrix(table, width: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and one row a vector, padded with zeros, ordered by label."""
    column = table.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dense = np.zeros((n, width), np.int64)
    dense[np.arange(width) < lengths[:, None]] = flat
    ids, labels = (table.column(c).to_numpy() if isinstance(table, pa.Table) else table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
    order = np.argsort(labels, kind="stable")
    return ids[order], labels[order], dense[order].astype(np.float64 if exact else object)


def _runs(labels: np.ndarray) -> dict:
    """The slice of each value of a sorted array."""
    values, starts = np.unique(labels, return_index=True)
    return {x: (int(a), int(b)) for x, a, b in zip(values.tolist(), starts, [*starts[1:], len(labels)])}


class Best:
    """The first ``k`` (score descending, id ascending) of each of ``n`` groups, with limits that new rows have to pass."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.full(n, -np.inf)
        self.last = np.full(n, np.iinfo(np.int64).max)
        self.kept, self.more, self.held = None, [], 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        limit = self.limit[group]
        passes = (score > limit) | (score == limit) & (ids < self.last[group])
        if passes.any():
            self.more.append((group[passes], score[passes], ids[passes]))
            self.held += int(passes.sum())
            if self.held > max(1 << 16, 2 * len(self.limit)):
                self.trim()

    def trim(self):
        parts = ([self.kept] if self.kept else []) + self.more
        if self.more:
            group, score, ids = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, -score, group))
            group, score, ids = group[order], score[order], ids[order]
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            keep = rank < self.k
            full = rank == self.k - 1
            self.limit[group[full]], self.last[group[full]] = score[full], ids[full]
            self.kept, self.more, self.held = (group[keep], score[keep], ids[keep]), [], 0
        return self.kept


def _tiles(batches, width: int, exact: bool):
    """Candidates in tiles that double up to TILE_ROWS."""
    size = FIRST_ROWS
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            yield _matrix(batch.slice(at, size), width, exact)
            at, size = at + size, min(TILE_ROWS, size * 2)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x.tolist() if x.dtype == object else x.astype(np.int64), kind) for x, kind in zip(columns, kinds)], names)


_POSITIVE = "a int, score bigint, id bigint"


def _positives(block, k: int, width: int, exact: bool):
    def run(batches):
        ids, labels, anchors = block.value
        own, best = _runs(labels), Best(len(ids), k)
        for c_ids, c_labels, rows in _tiles(batches, width, exact):
            for label, (c0, c1) in _runs(c_labels).items():
                a0, a1 = own.get(label, (0, 0))
                for at in range(a0, a1, TILE_ANCHORS):
                    to = min(a1, at + TILE_ANCHORS)
                    scores = anchors[at:to] @ rows[c0:c1].T
                    hit = scores >= best.limit[at:to, None]
                    for j in np.flatnonzero(np.isin(c_ids[c0:c1], ids[at:to])):
                        hit[ids[at:to] == c_ids[c0 + j], j] = False
                    a, c = np.nonzero(hit)
                    best.add(a + at, scores[a, c], c_ids[c0:c1][c])
        if kept := best.trim():
            yield _batch(_POSITIVE, *kept)

    return run


_NEGATIVE = "a int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _negatives(block, found, k: int, low: int, high: int, width: int, exact: bool):
    def run(batches):
        ids, labels, anchors = block.value
        p_ids, p_scores, held = found.value  # anchors x slots
        slots = p_ids.shape[1]
        kind = np.float64 if exact else object
        least = np.where(held, -((-low * p_scores) // 100), 1).astype(kind)
        most = np.where(held, (high * p_scores) // 100, 0).astype(kind)
        none = ~held | (least > most)
        least[none], most[none] = np.inf, -np.inf
        own, best = _runs(labels), Best(len(ids) * slots, k)
        for c_ids, c_labels, rows in _tiles(batches, width, exact):
            here = _runs(c_labels)
            floor = np.maximum(least, best.limit.reshape(-1, slots))
            under, over = floor.min(1), most.max(1)
            for at in range(0, len(ids), TILE_ANCHORS):
                to = min(len(ids), at + TILE_ANCHORS)
                scores = anchors[at:to] @ rows.T
                hit = (scores >= under[at:to, None]) & (scores <= over[at:to, None])
                for label, (a0, a1) in own.items():
                    if label in here and a0 < to and a1 > at:
                        hit[max(a0, at) - at : min(a1, to) - at, slice(*here[label])] = False
                a, c = np.nonzero(hit)
                score, a = scores[a, c], a + at
                for slot in range(slots):
                    fits = (score >= floor[a, slot]) & (score <= most[a, slot])
                    best.add(a[fits] * slots + slot, score[fits], c_ids[c[fits]])
        if kept := best.trim():
            group, score, found_ids = kept
            a, slot = group // slots, group % slots
            yield _batch(_NEGATIVE, a, slot, ids[a], p_ids[a, slot], p_scores[a, slot], found_ids, score)

    return run


def mine(vectors: DataFrame, anchors: Column | str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Of each anchor and each of its positives: the first negatives whose score is ``low`` to ``high`` percent of the positive's.

    ``vectors`` is (vec_id, label, v: array<bigint>) as ``quantize`` gives; ``anchors`` chooses its anchors. Scores are integer inner
    products, higher first, ties by smaller vec_id. An anchor's positives are its first rows of the same label and another
    vec_id; negatives have another label. Rows: (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score), rank from 1; pairs without a negative have none.

    Rows with a null anywhere, also within a vector, take no part. Vectors of different lengths count as filled up with
    zeros. Repeated rows count as often as they stand, but equal anchors are one; an anchor's own vec_id is never its
    positive. Equal scores of repeated rows give equal result rows. Other columns are ignored, whatever their names. An
    empty table, or one without anchors, gives an empty result. A score beyond 64 bits raises.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    whole = F.forall("v", lambda x: x.isNotNull())
    rows = vectors.select("vec_id", "label", "v").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    rows = materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<bigint>").alias("v")), "vectors")
    chosen = materialize(rows.where(anchors).distinct(), "anchors")
    extent = F.max(F.greatest(F.abs(F.array_max("v").cast("decimal(20,0)")), F.abs(F.array_min("v").cast("decimal(20,0)"))))
    n_rows, width, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), extent).first()
    n_anchors = chosen.count()
    width, largest = int(width or 0), int(largest or 0)
    exact = width * largest * largest < EXACT
    blocks = max(1, -(-n_anchors // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width)))))) if n_anchors else 0
    tasks = min(1 << 20, -(-n_rows * max(1, n_anchors // max(1, blocks)) * max(1, width) // TASK_PRODUCTS))
    if tasks > rows.rdd.getNumPartitions():
        rows_dealt = rows.repartition(tasks)
    else:
        rows_dealt = rows
    parts = []
    for b in range(blocks):
        held = chosen.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == b).toArrow()  # within the bounds of a block
        if not held.num_rows:
            continue
        block = spark.sparkContext.broadcast(_matrix(held, width, exact))
        first = rows_dealt.mapInArrow(_positives(block, positives, width, exact), _POSITIVE)
        order = W.partitionBy("a").orderBy(F.col("score").desc(), "id")
        first = first.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= positives).toArrow()
        p_ids, p_scores = np.zeros((held.num_rows, positives), np.int64), np.zeros((held.num_rows, positives), np.int64 if exact else object)
        there = np.zeros((held.num_rows, positives), bool)
        a, slot = first.column("a").to_numpy(), first.column("slot").to_numpy() - 1
        p_ids[a, slot], p_scores[a, slot], there[a, slot] = first.column("id").to_numpy(), first.column("score").to_numpy(), True
        found = spark.sparkContext.broadcast((p_ids, p_scores, there))
        second = rows_dealt.mapInArrow(_negatives(block, found, negatives, low, high, width, exact), _NEGATIVE)
        order = W.partitionBy("a", "slot").orderBy(F.col("negative_score").desc(), "negative_id")
        second = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        parts.append(materialize(second.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
        block.destroy()
        found.destroy()
    discard(rows, chosen)
    if not parts:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, parts)
