"""Line deduplication across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: ASCII white space, \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _row_key() -> Column:
    """16 bytes for a row's id and text; rows that repeat both share it and lose the same lines."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit("")))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of each row of ``docs``: its text without the lines that repeat across documents.

    A line's key is the line without ASCII white space at either end, A-Z in lower case. Keys of at least ``min_chars``
    code points that at least ``min_docs`` distinct doc_ids hold lose all their lines, but those of the largest doc_id
    that holds the key. Other lines stay as they are, joined by \\n. A null or empty text is one empty line. Rows that
    repeat a doc_id are one document when documents are counted, and all of them keep the lines of the largest doc_id;
    null doc_ids together are one document, less than any other. Very long texts are taken whole; what a row loses is an
    array of line numbers. Other columns are ignored, whatever their names; an empty table gives an empty one.

    Lines are exploded once with their numbers, as 16-byte digests, and written to the shared folder. Documents are
    counted on distinct (digest, doc_id), so a line that a third of all documents hold spreads over all tasks, and then
    reaches its digest's task as a row a task. Both sides of the joins on digest and on row are plain shuffled tables,
    whose large partitions Spark splits.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The outer form, as Spark would else split each text once more to see that it has a line, which all have. Lengths are
    # taken before letters are folded, which leaves them as they are.
    held = docs.select("doc_id", _row_key().alias("row"), lines_of(F.col("text")).alias("lines")).select("doc_id", "row", F.posexplode_outer("lines").alias("pos", "line"))
    held = held.where(F.length(F.btrim("line", F.lit(SPACE))) >= min_chars)
    held = materialize(held.select("doc_id", "row", "pos", F.unhex(F.md5(line_key(F.col("line")))).alias("key")), "lines")
    documents = held.select("key", "doc_id").distinct()
    common = documents.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    common = materialize(common.select(F.col("key").alias("common"), "keeper"), "common")
    lost = held.join(common.hint("merge"), F.col("key") == F.col("common")).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = materialize(lost.groupBy(F.col("row").alias("lost_row")).agg(F.collect_set("pos").alias("lost")), "lost")
    out = docs.withColumn("row", _row_key()).join(lost.hint("merge"), F.col("row") == F.col("lost_row"), "left")
    n = F.size(lines_of(F.col("text")))
    # array_except hashes, so reassembly takes a step a line however many of them go; the lines are bound as a lambda's
    # variable, so that the text is split once and not for every line.
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))
    rest = F.get(F.transform(F.array(lines_of(F.col("text"))), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")), F.lit(0))
    out = out.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("lost").isNotNull(), rest).alias("rest"), F.coalesce(F.size("lost"), F.lit(0)).alias("n_lost"))
    return out.select("doc_id", F.coalesce("rest", "text").alias("text"), "n_lines", F.when(F.col("rest").isNull(), 0).otherwise(F.col("n_lost")).cast("long").alias("n_dropped"))
