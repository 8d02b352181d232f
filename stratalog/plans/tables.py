"""Timed text, tracks and note collections as views of the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, SLICE = 120, 21600 * 10**6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as captions, 30 seconds apart."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return rows.select("video_id", F.col("seq").cast("long").alias("seq"), (F.col("seq") * 30.0).alias("start"), "text")


SEG_DOC = "seg AS (SELECT doc_id AS video_id, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS seq, unnest(string_split(text, chr(10))) AS text FROM documents)"


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), (F.size(F.split("text", "\n")) * 30.0).alias("duration")).where("duration > 0")


def seg_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding captions over the whole of each text that share six characters with their neighbours."""
    last = F.greatest(F.lit(0), F.ceil((F.coalesce(F.length("text"), F.lit(0)) - 26) / 20).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return rows.select("video_id", F.col("k").cast("long").alias("seq"), (F.col("k") * 1.0).alias("start"), F.substring(F.col("text"), F.col("k") * 20 + 1, F.lit(26)).alias("text"))


def seg_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as segments, in microseconds since the user's first."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), us.alias("us"), "value", F.col("event_type").alias("text"))
    rows = rows.join(rows.groupBy("video_id").agg(F.min("us").alias("first")), "video_id").withColumn("start", F.col("us") - F.col("first"))
    return rows.select("video_id", "seq", F.col("start").cast("double").alias("start"), (F.col("start") + F.floor(F.col("value") * 100000000)).cast("double").alias("end"), "text")


SEG_EVT = """evt AS (SELECT user_id AS video_id, event_id AS seq, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS s,
    floor(value * 100000000)::BIGINT AS d, event_type AS text FROM events)"""


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as notes: brand/key/name, an alias and a title."""
    stem = F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"), "p_name")
    return table(spark, sf_dir, "part").select(F.concat(stem, F.lit(".md")).alias("rel"), F.col("p_name").alias("stem"), stem.alias("rel_stem"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("title"), F.array("p_type").alias("aliases"))


VAULT = "vault AS (SELECT p_brand || '/' || p_partkey || '/' || p_name AS rel_stem, p_name AS stem, p_name || p_partkey AS title, p_type AS alias, p_brand AS a, p_partkey::VARCHAR AS b FROM part)"
