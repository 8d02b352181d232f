"""Joins of points and intervals, on dyadic nodes where a key has many rows.

Time is cut in buckets, and buckets in a binary tree of nodes (level, number). An interval is the disjoint union of at
most two nodes a level, its canonical cover; a point lies in one node of each level. So a point meets an interval in at
most one node, and the join is an equi-join: an interval is dealt at most 2 log2(buckets) times however long it is, a
point once a level that any cover has, and no pair comes twice. Rows of a key with few rows are not dealt: all its pairs
are compared where the key lies.

Rows that an explode made count for Spark as what they were made from, so joins here are merges by hint: neither side is
sent to the driver as a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs compared for each row of a key, on average, up to which its rows meet on the key alone.
PAIRS_A_ROW = 256


def cover(low: Column, high: Column) -> Column:
    """Array of structs (level, node): the canonical cover of the buckets ``low`` to ``high``, both included; empty if high < low."""
    low, high = low.cast("long"), high.cast("long") + 1
    span = F.greatest(high - low, F.lit(1))
    levels = F.sequence(F.lit(0), F.floor(F.log2(span.cast("double"))).cast("int") + 1)

    def nodes(level):
        left = -F.call_function("shiftright", -low, level)
        right = F.call_function("shiftright", high, level)
        inside = left < right
        return F.array_compact(F.array(F.when(inside & (left.bitwiseAND(1) == 1), F.struct(level.alias("level"), left.alias("node"))), F.when(inside & (right.bitwiseAND(1) == 1), F.struct(level.alias("level"), (right - 1).alias("node")))))

    return F.when(high > low, F.flatten(F.transform(levels, nodes))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))


def nodes_of(bucket: Column, top: int) -> Column:
    """Array of structs (level, node) of the nodes that hold a bucket, up to level ``top``."""
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", bucket.cast("long"), level).alias("node")))


def _bucket(time: Column, unit: float) -> Column:
    return F.floor(time.cast("double") / F.lit(float(unit))).cast("long")


def points_in(points: DataFrame, at: str, intervals: DataFrame, bounds: tuple[str, str], keys: list[str], unit: float) -> DataFrame:
    """Rows of ``points`` with those of ``intervals`` of equal ``keys`` whose bounds, both included, hold the point's ``at``.

    ``unit`` is the length of a bucket: times nearer than that are told apart by the bounds themselves. Columns besides
    the keys need different names on the two sides. A null time or bound, or a null key, meets nothing.
    """
    low, high = bounds
    some = intervals.where(F.col(high) >= F.col(low)).withColumns({"__low": _bucket(F.col(low), unit), "__high": _bucket(F.col(high), unit)})
    longest = some.agg(F.max(F.col("__high") - F.col("__low"))).first()[0]
    top = (int(longest or 0) + 1).bit_length()
    dealt = some.withColumn("__at", F.explode(cover(F.col("__low"), F.col("__high")))).drop("__low", "__high")
    asked = points.where(F.col(at).isNotNull()).withColumn("__at", F.explode(nodes_of(_bucket(F.col(at), unit), top)))
    return asked.join(dealt.hint("merge"), [*keys, "__at"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__at")


def _on_nodes(left: DataFrame, left_bounds: tuple[str, str], right: DataFrame, right_bounds: tuple[str, str], keys: list[str], unit: float) -> DataFrame:
    """As ``overlapping``, on dyadic nodes. Of two intervals that overlap, one starts within the other: either the left one's start lies in the right one, or the right one's lies in the left one behind its start. Both are joins of points and intervals."""
    (s0, e0), (s1, e1) = left_bounds, right_bounds
    meet = (F.col(s0) <= F.col(e1)) & (F.col(s1) <= F.col(e0))
    inside = points_in(left, s0, right, right_bounds, keys, unit).where(meet)
    behind = points_in(right, s1, left, left_bounds, keys, unit).where(meet & (F.col(s1) > F.col(s0)))
    return inside.unionByName(behind)


def overlapping(left: DataFrame, left_bounds: tuple[str, str], right: DataFrame, right_bounds: tuple[str, str], keys: list[str], unit: float) -> DataFrame:
    """Pairs of rows of equal ``keys`` with left start <= right end and right start <= left end, each pair once.

    The rows of each key are counted. Keys with at most PAIRS_A_ROW pairs a row are joined as they are, so that no row is
    repeated; the others meet on dyadic nodes, see ``_on_nodes``. As ``points_in`` for names and nulls.
    """
    (s0, e0), (s1, e1) = left_bounds, right_bounds
    columns = [*keys, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys)]
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m")), keys)
    many = counts.where(F.col("__n").cast("double") * F.col("__m") > (F.col("__n") + F.col("__m")) * float(PAIRS_A_ROW)).select(*keys)
    meet = (F.col(s0) <= F.col(e1)) & (F.col(s1) <= F.col(e0))
    if many.isEmpty():
        return left.join(right.hint("merge"), keys).where(meet).select(*columns)
    few = left.join(many, keys, "left_anti").join(right.hint("merge"), keys).where(meet)
    dealt = _on_nodes(left.join(many, keys, "left_semi"), left_bounds, right.join(many, keys, "left_semi"), right_bounds, keys, unit)
    return few.select(*columns).unionByName(dealt.select(*columns))
