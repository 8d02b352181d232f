"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash, and by how many of them each histogram is finer than the one before.
DIGITS, STEP = 16, 3
#: Sources up to which the thresholds are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Sources whose running sums one task takes.
RUN_ROWS = 50_000


def text_size(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sums_before(rows: DataFrame, order: Sequence[str], columns: Sequence[str], n: int) -> DataFrame:
    """``rows`` (of a written table, ``n`` of them, unique in ``order``) with <column>_before, its sum over all rows before.

    Rows are dealt in ranges of about RUN_ROWS, each summed by its own task; a total a range, of which there are few, comes
    together to set off the sums of the next one.
    """
    ranges = max(1, -(-n // RUN_ROWS))
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(c) for c in columns])
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col("range").alias("of"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_start") for c in columns])
    within = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns})
    out = sums.join(F.broadcast(starts), F.col("range") == F.col("of"))  # a row a range
    return out.select(*rows.columns, *[(F.col(f"{c}_before") + F.col(f"{c}_start")).alias(f"{c}_before") for c in columns])


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sizes`` (source, source_size) to their targets: shares by weight of the sum, stopped at ``most`` times a source's size.

    Sources in code point order, null last, take the weights in turn. What stopped sources leave is shared again by
    weight: in order of most * size / weight the stopped ones come first, so one pass of running sums settles it. Running
    sums are taken range by range, so no task holds all sources.
    """
    sizes = materialize(sizes, "sources").withColumns({"none": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    n, total = sizes.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    t = _sums_before(sizes, ("none", "source"), ("one",), n)
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.col("one_before"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    t = t.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = materialize(t.select("source", "none", "source_size", "weight", "cap", "ratio"), "ratios")
    all_weights = t.agg(F.sum("weight")).first()[0] or 0
    t = _sums_before(t, ("ratio", "none", "source"), ("cap", "weight"), n).withColumns({"left": F.lit(total or 0) - F.col("cap_before"), "weights": F.lit(all_weights) - F.col("weight_before")})
    t = materialize(t.withColumn("stopped", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight")), "stopped")
    level = t.where(~F.col("stopped")).agg(F.min(F.struct("ratio", "none", "source", "left", "weights")).alias("first")).first()["first"]  # one row
    target = F.col("cap").cast("double")
    if level is not None:
        share = (F.col("weight") * F.lit(level["left"])).cast("double") / F.lit(float(level["weights"]))
        target = F.when(F.col("stopped"), target).otherwise(F.least(share, target))
    return t.select("source", "source_size", target.alias("target"))


def _by_source(rows: DataFrame, states: DataFrame, n: int) -> DataFrame:
    states = states.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(states) if n <= BROADCAST_SOURCES else states, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _digest(id_col: str, seed: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, DIGITS)


def source_limits(base: DataFrame, weights: Sequence[int], most: int) -> tuple[DataFrame, int]:
    """Of ``base`` (source, size, h): (source, source_size, target, times, prefix), and the number of sources.

    A document is taken ``times`` times, and once more if its hash lies below ``prefix`` (null: no document does). The
    prefix is where the sum of sizes by leading digits reaches the rest of the target; the bucket that crosses it is the
    only one that is summed again, by more digits, until it holds a single hash.
    """
    sources = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = materialize(sources.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")), "sources")
    n, digits = sources.count(), 0
    state = sources.select("source", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("spent"))
    while n:
        digits = min(DIGITS, digits + STEP)
        inside = _by_source(base, state, n).where(F.col("h").startswith(F.col("prefix")) & (F.col("size") > 0))
        sums = inside.groupBy("source", "rest", "spent", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.col("spent") + F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where("upto > rest").groupBy("source", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("spent"), (F.col("low") != F.col("high")).alias("many"))).alias("b"))
        state = materialize(over.select("source", "rest", F.col("b.bucket").alias("prefix"), F.col("b.spent").alias("spent"), F.col("b.many").alias("many")), "threshold")
        if digits == DIGITS or state.where("many").isEmpty():
            break
        state = state.drop("many")
    limits = state.select(F.col("source").alias("at"), "prefix")
    joined = sources.join(F.broadcast(limits) if n <= BROADCAST_SOURCES else limits, F.col("source").eqNullSafe(F.col("at")), "left")
    return joined.select("source", "source_size", "target", "times", F.when(F.col("rest") > 0, F.col("prefix")).alias("prefix")), n


def _copies() -> Column:
    return F.when(F.col("size") > 0, F.col("times") + F.coalesce(F.col("h") < F.col("prefix"), F.lit(False)).cast("long")).otherwise(0).cast("long")


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_size(F.col(text_col).cast("string")).alias("size"), _digest(id_col, seed).alias("h"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of ``docs``, for a mix of sources by weight.

    Every document of a source is taken floor(target / source_size) times; the rest of the target takes once more the
    documents whose hash, of the id, lies below the source's threshold, the largest at which their sizes don't exceed
    the rest. Nothing is sorted or collected: what comes together is a histogram a source, of 16**STEP buckets at most.

    A null text has size 0; a null source is a source of its own, after all others; null ids share a hash, as do rows
    that repeat an id in a source, and are taken together or not at all. A source without words has target 0. Other
    columns are ignored, whatever their names. An empty table gives an empty one. Equal tables give equal results.
    """
    base = materialize(_base(docs, id_col, text_col, source_col, seed), "sizes")
    sources, n = source_limits(base, weights, most)
    out = _by_source(base, sources.withColumn("source", F.col("source")), n).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any other columns), each as often as the mix takes it. Only sizes and hashes are shuffled; texts stay where they are.

    A document without words, null and empty ones too, is never taken. Rows that repeat an id in a source are taken together,
    each as often. Columns come back as they were, whatever their names. An empty table gives an empty one.
    """
    sources, n = source_limits(materialize(_base(docs, "doc_id", "text", "source", seed), "sizes"), weights, most)
    limits = sources.select(F.col("source").alias("__of"), F.struct("times", "prefix").alias("__limit"))
    rows = docs.join(F.broadcast(limits) if n <= BROADCAST_SOURCES else limits, F.col("source").cast("string").eqNullSafe(F.col("__of")))
    more = F.coalesce(_digest("doc_id", seed) < F.col("__limit.prefix"), F.lit(False)).cast("long")
    copies = F.when(text_size(F.col("text")) > 0, F.col("__limit.times") + more).otherwise(0).cast("int")
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
