"""A uniform shuffle to exact shard sizes by a hypergeometric communication matrix, in DataFrame functions only."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Rows that a part should hold, and the least number of parts.
PART_ROWS, LEAST_PARTS = 1_000_000, 16
#: Rows equal in id, checksum and size from which they are numbered first, to spread over the parts.
EQUAL_ROWS = 50_000
#: Entries up to which what is drawn for parts and shards is broadcast; beyond, it is joined by shuffle.
BROADCAST_ENTRIES = 1 << 20
#: Bytes of text that a part should hold at most, where texts travel along.
PART_BYTES = 64 << 20


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items, taken without replacement, are among the ``good``; by inversion outwards from the mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    left, right, p_left, p_right = mode, mode, at, at
    u = rng.random() - at
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (drawn - right) / ((right + 1) * (bad - drawn + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - drawn + left) / ((good - left + 1) * (drawn - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(counts: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each part that go to each shard: row sums are ``counts``, column sums at most one apart, drawn as a uniform permutation would."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for count in counts:
        row, left, rest = [], count, sum(room)
        for s in range(shards):
            take = hypergeometric(rng, room[s], rest - room[s], left)
            rest -= room[s]
            left -= take
            row.append(take)
        room = [r - t for r, t in zip(room, row)]
        matrix.append(row)
    return matrix


def _numbered(base: DataFrame, same: Sequence[str], n: int) -> DataFrame:
    """``base`` with ``number``, from 0, of each row of a group of EQUAL_ROWS or more that are equal in ``same``; null for others.

    Rows are numbered within the partitions they are written in, and set off by those partitions' counts, so no task holds
    a whole group. Which of equal rows has which number doesn't matter, as they are interchangeable.
    """
    hot = base.groupBy(*same).count().where(F.col("count") >= EQUAL_ROWS).drop("count")
    hot = materialize(hot.select(*[F.col(c).alias(f"__{c}") for c in same]), "equal")  # n / EQUAL_ROWS rows at most
    if hot.isEmpty():
        return base
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
    at = materialize(base.withColumn("__at", F.spark_partition_id()), "numbered")
    small = n // EQUAL_ROWS <= BROADCAST_ENTRIES
    groups = at.select(*same, "__at").join(F.broadcast(hot) if small else hot, on, "left_semi").groupBy(*same, "__at").count()
    earlier = W.partitionBy(*same).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    groups = materialize(groups.select(*[F.col(c).alias(f"__{c}") for c in same], F.col("__at").alias("__of"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before")), "before")
    # A row a group and partition that holds some of it.
    rows = at.join(groups, [*on, F.col("__at") == F.col("__of")], "left")
    own = F.row_number().over(W.partitionBy(*same, "__at").orderBy(F.lit(1))) - 1
    return rows.withColumn("number", F.when(F.col("__before").isNotNull(), F.col("__before") + own)).drop("__at", "__of", "__before", *[f"__{c}" for c in same])


def shard(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, copy, *keep, shard, slot) of each row of ``docs``, in uniformly shuffled shards whose row counts differ by one at most.

    Rows fall into parts by a hash of id, checksum and size, so null ids and rows that repeat an id spread over the parts
    with their texts; EQUAL_ROWS and more rows that are equal in all three are numbered first, and spread by their numbers.
    How many rows of each part go to each shard is drawn exactly on the driver, from the parts' counts alone. Within a part rows are ranked by a second hash and dealt by those numbers;
    within a shard they are ranked by a third one, range by range, so that no task ever holds a whole shard. ``size`` is
    the text's UTF-8 bytes plus 1, a null text has none and the checksum of the empty one. Rows of equal id, checksum and
    size lie beside each other in rank, are interchangeable and numbered from 0 in ``copy``. Columns in ``keep`` travel
    along with those that the result names, and may not have their names; others are ignored, whatever their names. An empty table gives an empty one.
    The same table and seed give the same result. Texts are only measured, unless ``keep`` names them.
    """

    same = ("doc_id", "text_crc32", "size")

    def mixed(n):
        """A hash of the row; of rows numbered as equal ones, by their numbers too."""
        plain = F.xxhash64(F.lit(seed * 4 + n), *same)
        return F.when(F.col("number").isNull(), plain).otherwise(F.xxhash64(plain, "number")) if "number" in base.columns else plain

    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.struct(F.lit(0).alias("__"), *[F.col(c) for c in keep]).alias("__kept"))
    n, held_bytes = base.agg(F.count(F.lit(1)), F.sum("size")).first()
    if n > EQUAL_ROWS:
        base = _numbered(base, same, n)
    # Texts that travel along count too, so that a part stays a small one.
    parts = max(LEAST_PARTS, math.ceil(n / PART_ROWS), math.ceil((held_bytes or 0) / PART_BYTES) if text_col in keep else 0)
    part = F.pmod(mixed(0), F.lit(parts)).cast("int")
    found = {r["part"]: r["count"] for r in base.groupBy(part.alias("part")).count().toLocalIterator()}
    matrix = communication_matrix([found.get(p, 0) for p in range(parts)], shards, seed)
    drawn = docs.sparkSession.createDataFrame([(p, list(itertools.accumulate(row))) for p, row in enumerate(matrix)], "of int, ends array<bigint>")
    small = parts * shards <= BROADCAST_ENTRIES
    rows = base.withColumns({"part": part, "local": mixed(1)}).withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy("local", *same)))
    copy = F.row_number().over(W.partitionBy("part", "local", *same).orderBy("rank")) - 1
    rows = rows.withColumn("copy", (F.coalesce("number", copy) if "number" in base.columns else copy).cast("int"))
    rows = rows.join(F.broadcast(drawn) if small else drawn, F.col("part") == F.col("of"))
    to = F.size(F.filter("ends", lambda end: end < F.col("rank"))).cast("int")
    slices = max(1, parts // shards)
    mix = mixed(2)
    rows = rows.select("doc_id", "size", "text_crc32", "copy", "__kept", to.alias("shard"), mix.alias("mix"), F.floor((F.shiftrightunsigned(mix, 33)) * slices / F.lit(1 << 31)).cast("int").alias("slice"))
    rows = materialize(rows, "dealt")
    held = rows.groupBy("shard", "slice").count()
    starts = held.select(F.col("shard").alias("s"), F.col("slice").alias("p"), (F.sum("count").over(W.partitionBy("shard").orderBy("slice")) - F.col("count")).alias("start"))
    order = F.shiftrightunsigned("mix", 33)  # slices are ranges of these bits
    local = F.row_number().over(W.partitionBy("shard", "slice").orderBy(order, "mix", "doc_id", "text_crc32", "size", "copy"))
    out = rows.withColumn("local", local).join(F.broadcast(starts) if small else starts, (F.col("shard") == F.col("s")) & (F.col("slice") == F.col("p")))
    return out.select("doc_id", "size", "text_crc32", "copy", *[F.col("__kept").getField(c).alias(c) for c in keep], "shard", (F.col("start") + F.col("local") - 1).cast("long").alias("slot"))
