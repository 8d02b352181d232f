"""The operators of this subpackage as queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, language_id, license_scan, line_dedup, media_audio, mixing, phrases, pii, quality, sharding, simhash_golay, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op1(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_audio.probe(media_audio.store(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "duration_s", "crc_bad", "seek_offsets")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.simhash_dedup(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.quantize(rows))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.fit(docs))
    base = F.sha2(pii.digest(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256")
    return found.select("doc_id", *map(pii.count_of, pii.KINDS), base, pii.digest(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_decontaminate, op4_media_audio, op5_simhash, op6_quality, op7_license_scan, op8_mixing, op9_token_counts, op10_sharding, op11_hard_negatives, op12_phrases, op13_pii)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
        common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op3_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
                 FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM wins),
        docwins AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT DISTINCT doc_id, i, x.n, item_id FROM docwins x JOIN wins USING (n, win)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_mixing": r"""
        WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                             substring(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
        w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM s),
        c AS (SELECT *, 3 * source_size AS cap FROM w),
        r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
                     sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
              FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
        m AS (SELECT *, cap * weights <= room * weight AS stopped FROM r),
        v AS (SELECT room::DOUBLE AS room, weights::DOUBLE AS weights FROM m WHERE NOT stopped ORDER BY cap / weight, source NULLS LAST LIMIT 1),
        t AS (SELECT m.source, source_size, CASE WHEN stopped OR v.room IS NULL THEN cap::DOUBLE
                     ELSE least((weight * v.room) / v.weights, cap::DOUBLE) END AS target FROM m LEFT JOIN v ON true),
        k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
        j AS (SELECT b.*, source_size, target, times, target - times * source_size AS rest FROM base b JOIN k ON b.source IS NOT DISTINCT FROM k.source),
        u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM j)
        SELECT doc_id, size, source_size, target, size * (times + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS taken FROM u""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
              FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS "rank",
               s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 10""",
    "op12_phrases": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
              FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM g WHERE k > 1 AND f >= 10),
        parts AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, p FROM c),
        scored AS (
            SELECT x.lang, x.k, x.phrase, x.a, cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * x.a * x.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM parts x JOIN g l ON l.lang = x.lang AND l.phrase = array_to_string(x.p[1 : cut], ' ') JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(x.p[cut + 1 : x.k], ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        longer AS (SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
        cover AS (SELECT lang, phrase, max(a) AS over FROM longer GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN cover v ON v.lang = b.lang AND v.phrase = b.phrase WHERE b.k = 3 OR v.over IS NULL OR 100 * v.over < 50 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank", phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
