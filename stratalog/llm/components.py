"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b: bigint, a > b) to (node, root): each node of a link but the roots themselves, with the least node of its component.

    Every round is two grouped minima with map-side combine and two equi-joins. Minima are written before they are
    joined, so both sides of a join are plain shuffled tables, and Spark splits the partition of a node with a large
    share of the links. The links of a round are written to the shared folder too: lineage stays short and a lost
    executor costs one round at most. Tables of rounds gone by are deleted. An empty table gives an empty table. Raises
    if ``rounds`` don't suffice (stars halve every path, so 60 rounds are ample).
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(links)
    for _ in range(rounds):
        if not before[0]:
            break
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        least_of = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        moved = large.join(least_of, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        spent, links = links, materialize(moved.unionByName(least_of.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _state(links)
        discard(spent, least, large, least_of)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
