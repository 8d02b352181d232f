"""A training-data pipeline over ``documents``: quality, near duplicates, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontaminate as leaks
from stratalog.llm import mixing, near_dedup, quality, sharding
from stratalog.llm.common import discard, fold, materialize, scratch

#: What the last stage adds to each row.
SHARD_COLUMNS = ("size", "text_crc32", "copy", "shard", "slot")


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator gives to its results, and these names by the old ones."""
    names = {c: f"__column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(new).alias(old) for old, new in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, doesn't reject. All columns come back as they were, also such as score or predicted."""
    model = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    rows, names = _numbered(docs)
    return _named(quality.score(rows, model, text_col=names["text"]).where("predicted = 1"), names)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (candidates by SimHash and Golay keys; five-word shingles, Jaccard similarity 0.8 or more), the document with the least doc_id. Columns come back as they were, whatever their names; of rows that repeat id and text, the first by its columns."""
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. All columns come back as they were, also such as items or n_words."""
    rows, names = _numbered(docs)
    return _named(leaks.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=names["text"]).where("not contaminated"), names)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most three times. Columns come back as they were, also such as size or source_size."""
    return mixing.mix_documents(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining row with all its columns and its size, checksum, shard and place in it; copies that the mix took of a document are numbered.

    A column of ``docs`` that has the name of one of SHARD_COLUMNS, in any case, comes back with ``_`` behind its name, as
    often as it takes to differ from all others.
    """
    rows, names = _numbered(docs)
    found = sharding.shard(rows, id_col=names["doc_id"], text_col=names["text"], keep=[new for old, new in names.items() if old != "doc_id"])
    taken, own = {c.lower() for c in (*docs.columns, *SHARD_COLUMNS)}, []
    for old, new in names.items():
        to = old
        if old.lower() in SHARD_COLUMNS:
            while to.lower() in taken:
                to += "_"
            taken.add(to.lower())
        if old != "doc_id":
            own.append(F.col(new).alias(to))
    return found.select("doc_id", "size", "text_crc32", "copy", *own, "shard", "slot")


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("source_mixing", mix_stage),
    ("sharding", shard_stage),
]

#: The classifier is trained, which SQL can't express; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next one reads it, and deleted after that.

    Stages keep null, empty and repeated rows as their operators say. A row of the result is a copy of a document that
    the mix took: its columns, size, checksum, copy number, shard and slot. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as written:
            spent, docs = docs, written.keep(materialize(stage(spark, docs, sf_dir), name))
        discard(spent)
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # the last stage has written what it deals
    return out
