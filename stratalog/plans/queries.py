"""A query for each operator over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, lexicon, text
from ..operators import condense, folds, gate, intervals, links, quotes, signals, timeline, vault
from ..sources import captions, notes
from ..streaming import incremental
from . import navigation
from . import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _in(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


def _word(words, lower: bool = True) -> str:
    return f"len(list_filter({WORDS}, lambda w: {'lower(w)' if lower else 'w'} IN {_in(words)})) > 0"


TECH_SQL = f"({_any(lexicon.TECH_CN)} OR {_word(lexicon.TECH_EN)})"
TRAP_SQL = f"({_any(lexicon.TRAP_CN)} OR {_word(lexicon.TRAP_EN)})"
CODE_SQL = rf"(regexp_matches(text, '[a-zA-Z_][\p{{L}}\p{{N}}_]*\s*[(=\[<>]|->|\+\+|--|==|!=|<=|>=|;\s*\z') OR {_word(lexicon.CODE_WORDS, lower=False)})"
FORMULA_SQL = r"regexp_matches(text, '[=+\-*/^]|dp\[|f\(|O\(|\\sum|\\le|\\ge|\\in')"
NOISE_SQL = "regexp_matches(text, '^[^\\n]*(" + "|".join(lexicon.NOISE) + ")')"
HITS_SQL = f"list_concat(list_filter([{', '.join(repr(w) for w in lexicon.TECH_CN)}], lambda k: contains(text, k)), list_transform(list_filter({WORDS}, lambda w: lower(w) IN {_in(lexicon.TECH_EN)}), lambda w: lower(w)))"
FOLD_SQL = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
CHUNKS_SQL = "chunks AS (SELECT video_id, i::INTEGER AS chunk_id, (i * 120)::DOUBLE AS t0, least((i + 1) * 120, dur)::DOUBLE AS t1 FROM (SELECT doc_id AS video_id, 30 * len(string_split(text, chr(10))) AS dur, unnest(range((30 * len(string_split(text, chr(10))) + 119) // 120)) AS i FROM documents))"
TEXTS_SQL = "texts AS (SELECT video_id, (seq // 4)::INTEGER AS chunk_id, string_agg(text, '' ORDER BY seq) AS text, count(*) AS n_segments FROM seg GROUP BY ALL)"


@query(f"WITH {CHUNKS_SQL} SELECT * FROM chunks")
def tl_1_plan_chunks(spark, sf_dir):
    return timeline.plan_chunks(t.durations(spark, sf_dir), t.CHUNK)


@query(f"WITH {t.SEG_DOC}, {TEXTS_SQL} SELECT video_id, chunk_id, md5(text) AS text_md5, n_segments FROM texts")
def tl_2_chunk_texts(spark, sf_dir):
    return timeline.chunk_texts(t.seg_doc(spark, sf_dir), t.CHUNK).select("video_id", "chunk_id", F.md5("text").alias("text_md5"), "n_segments")


@query(f"""WITH {t.SEG_DOC}, {TEXTS_SQL}, h AS (SELECT *, {HITS_SQL} AS hits FROM texts)
    SELECT video_id, chunk_id, array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i)[1:5], '|') AS keywords,
           array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i)[1:3], '|') AS topic_hints,
           len(hits)::BIGINT AS n_hits, length(text)::BIGINT AS n_chars, least(1.0, len(hits) / greatest(1.0, length(text) / 80.0::DOUBLE))::DOUBLE AS density, {CODE_SQL} AS has_code, {FORMULA_SQL} AS has_formula, {TRAP_SQL} AS has_warning FROM h""")
def ag_1_signals(spark, sf_dir):
    rows = timeline.chunk_texts(t.seg_doc(spark, sf_dir), t.CHUNK).withColumn("s", signals.analyze(F.col("text")))
    return rows.select("video_id", "chunk_id", F.array_join("s.keywords", "|").alias("keywords"), F.array_join("s.topic_hints", "|").alias("topic_hints"), "s.n_hits", "s.n_chars", "s.density", "s.has_code", "s.has_formula", "s.has_warning")


@query(f"""WITH {CHUNKS_SQL}, {t.SEG_DOC}, {TEXTS_SQL}, j AS (SELECT c.*, coalesce(x.text, '') AS text FROM chunks c LEFT JOIN texts x USING (video_id, chunk_id))
    SELECT video_id, chunk_id, printf('%02d:%02d:%02d', t0::BIGINT // 3600, t0::BIGINT % 3600 // 60, t0::BIGINT % 60) AS start,
           printf('%02d:%02d:%02d', t1::BIGINT // 3600, t1::BIGINT % 3600 // 60, t1::BIGINT % 60) AS "end", t1 - t0 AS duration_s, 'ready' AS status,
           length(text)::BIGINT AS chars, len({HITS_SQL})::BIGINT AS n_hits, {TRAP_SQL} AS has_warning FROM j""")
def tl_10_chunk_index(spark, sf_dir):
    chunks = timeline.plan_chunks(t.durations(spark, sf_dir), t.CHUNK)
    rows = timeline.chunk_index(chunks, timeline.chunk_texts(t.seg_doc(spark, sf_dir), t.CHUNK), None, t.CHUNK)
    return rows.select("video_id", "chunk_id", "start", "end", "duration_s", "status", "chars", "n_hits", "has_warning")


@query(f"""WITH {t.SEG_DOC} SELECT video_id, count(*) FILTER ({TECH_SQL}) AS n_tech, count(*) FILTER ({TRAP_SQL}) AS n_trap, count(*) FILTER ({CODE_SQL}) AS n_code,
    count(*) FILTER ({FORMULA_SQL}) AS n_formula, count(*) FILTER ({NOISE_SQL}) AS n_noise FROM seg GROUP BY video_id""")
def pr_1_to_6_flags(spark, sf_dir):
    c = F.col("text")
    return t.seg_doc(spark, sf_dir).groupBy("video_id").agg(F.count_if(signals.has_tech_word(c)).alias("n_tech"), F.count_if(signals.has_trap(c)).alias("n_trap"), F.count_if(signals.has_code(c)).alias("n_code"), F.count_if(signals.has_formula(c)).alias("n_formula"), F.count_if(signals.is_noise(c)).alias("n_noise"))


LINES_SQL = f"""{t.SEG_DOC}, lines AS (SELECT video_id, seq, 30.0 * seq AS sec, text, ({TECH_SQL} OR {CODE_SQL}) AS tech, {TRAP_SQL} AS trap FROM (SELECT * REPLACE (trim(text) AS text) FROM seg) WHERE text <> ''),
    marked AS (SELECT *, tech OR trap AS signal, sum((tech OR trap)::INT) OVER (PARTITION BY video_id ORDER BY seq) AS island FROM lines),
    runs AS (SELECT *, min(sec) OVER r AS t0, max(sec) OVER r AS t1, count(*) OVER r AS n, min(seq) OVER r AS head FROM marked WINDOW r AS (PARTITION BY video_id, island, signal)),
    idle AS (SELECT *, NOT signal AND t1 - t0 >= 90 AND n >= 3 AS folded FROM runs),
    folded AS (SELECT video_id, seq, CASE WHEN folded THEN 'fold' ELSE 'line' END AS kind, (CASE WHEN folded THEN t0 ELSE sec END)::DOUBLE AS t_from, (CASE WHEN folded THEN t1 ELSE sec END)::DOUBLE AS t_to,
               (CASE WHEN folded THEN n ELSE 1 END)::BIGINT AS n_lines, CASE WHEN NOT folded THEN text END AS text FROM idle WHERE NOT folded OR seq = head)"""


@query(f"WITH {LINES_SQL} SELECT video_id, seq, kind, t_from, t_to, n_lines, md5(text) AS text_md5 FROM folded")
def wn_3_fold_idle(spark, sf_dir):
    return condense.condense(t.seg_doc(spark, sf_dir))[0].select("video_id", "seq", "kind", "t_from", "t_to", "n_lines", F.md5("text").alias("text_md5"))


@query(f"""WITH {LINES_SQL}, known AS (SELECT video_id, list(DISTINCT text) AS traps FROM lines WHERE trap GROUP BY video_id),
    j AS (SELECT f.video_id, f.seq, f.text, f.t_from, traps, printf('[%02d:%02d:%02d] ', t_from::BIGINT // 3600, t_from::BIGINT % 3600 // 60, t_from::BIGINT % 60) || f.text AS line FROM folded f LEFT JOIN known USING (video_id) WHERE kind = 'line')
    SELECT video_id, count(*) AS n_lines, sum(length(body))::BIGINT AS evidence_chars FROM (SELECT video_id, text AS body, traps, line AS text FROM j)
    WHERE {TECH_SQL} OR {CODE_SQL} OR {FORMULA_SQL} OR {TRAP_SQL} OR len(list_filter(coalesce(traps, []), lambda x: contains(x, body))) > 0 GROUP BY video_id""")
def cd_4_evidence(spark, sf_dir):
    rows, found, _ = condense.condense(t.seg_doc(spark, sf_dir))
    return condense.evidence(rows, found).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("evidence_chars"))


@query(f"""WITH RECURSIVE {t.SEG_EVT}, o AS (SELECT *, s + d AS e, row_number() OVER (PARTITION BY video_id ORDER BY s, seq) AS rn FROM evt),
    f AS (SELECT video_id, rn, 1 AS g, seq, s, e, text FROM o WHERE rn = 1
        UNION ALL
        SELECT o.video_id, o.rn, CASE WHEN over THEN g ELSE g + 1 END, CASE WHEN keep THEN x.kseq ELSE o.seq END, CASE WHEN keep THEN x.ks ELSE o.s END, CASE WHEN keep THEN x.ke ELSE o.e END, CASE WHEN keep THEN x.ktext ELSE o.text END
        FROM (SELECT f.video_id, f.rn, f.g, f.seq AS kseq, f.s AS ks, f.e AS ke, f.text AS ktext, n.rn AS nrn,
                     least(f.e, n.e) - greatest(f.s, n.s) > 0 AND least(f.e - f.s, n.e - n.s) > 0 AND 10 * (least(f.e, n.e) - greatest(f.s, n.s)) > 7 * least(f.e - f.s, n.e - n.s) AS over,
                     over AND NOT (contains(n.text, f.text) OR contains(f.text, n.text) OR length(n.text) > length(f.text)) AS keep
              FROM f JOIN o n ON n.video_id = f.video_id AND n.rn = f.rn + 1) x JOIN o ON o.video_id = x.video_id AND o.rn = x.nrn)
    SELECT video_id, max_by(seq, rn) AS seq, max_by(s, rn)::DOUBLE AS start, max_by(e, rn)::DOUBLE AS "end", max_by(text, rn) AS text FROM f GROUP BY video_id, g""")
def tl_5_drop_overlaps(spark, sf_dir):
    return folds.drop_overlaps(t.seg_evt(spark, sf_dir))


_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(13))"


def _heads_sql(items: str) -> str:
    """Relation ``folded`` (video_id, rows: list of seq and text) of a relation ``items`` (video_id, items: list of kept and out): each text without the head that repeats the last kept one."""
    same = "list_max(list_filter(range(3, 25), lambda i: i <= length(a.kept) AND i <= length(x.kept) AND right(a.kept, i) = left(x.kept, i)))"
    return f"""folded AS (SELECT video_id, list_reduce(list_prepend({{'kept': '', 'out': [{{'seq': -1::BIGINT, 'text': ''}}]}}, items), lambda a, x: list_transform([{_TRIM.format(f"substring(x.kept, coalesce({same}, 0) + 1)")}],
        lambda cut: {{'kept': CASE WHEN cut = '' THEN a.kept ELSE cut END, 'out': CASE WHEN cut = '' THEN a.out ELSE list_append(a.out, {{'seq': x.out[1].seq, 'text': cut}}) END}})[1]).out AS rows FROM ({items}))"""


_SLIDES = f"""SELECT video_id, list_transform(range(last + 1), lambda i: {{'kept': {_TRIM.format("substring(whole, i * 20 + 1, 26)")}, 'out': [{{'seq': i, 'text': ''}}]}}) AS items
        FROM (SELECT doc_id AS video_id, coalesce(text, '') AS whole, greatest(0, ceil((length(coalesce(text, '')) - 26) / 20.0)::BIGINT) AS last FROM documents)"""


@query(f"WITH {_heads_sql(_SLIDES)} SELECT video_id, u.seq AS seq, u.text AS text FROM (SELECT video_id, unnest(rows) AS u FROM folded) WHERE u.seq >= 0")
def f_2_drop_repeated_heads(spark, sf_dir):
    return folds.drop_repeated_heads(t.seg_slide(spark, sf_dir)).select("video_id", "seq", "text")


_LINES = f"""SELECT doc_id AS video_id, list_transform(string_split(text, chr(10)), lambda l, i: {{'kept': {_TRIM.format("l")}, 'out': [{{'seq': i - 1, 'text': ''}}]}}) AS items FROM documents"""
HEADS_SQL = LINES_SQL.replace(t.SEG_DOC, f"{_heads_sql(_LINES)}, {t.SEG_DOC.replace('seg AS', 'raw AS')}, seg AS (SELECT video_id, u.seq AS seq, u.text AS text FROM (SELECT video_id, unnest(rows) AS u FROM folded) WHERE u.seq >= 0)").replace("folded AS (SELECT video_id, seq, CASE", "idle_rows AS (SELECT video_id, seq, CASE")


@query(f"""WITH {HEADS_SQL} SELECT s.video_id, raw_chars, coalesce(dedup_chars, 0)::BIGINT AS dedup_chars, (raw_chars - coalesce(dedup_chars, 0))::BIGINT AS dedup_removed, coalesce(clean_chars, 0)::BIGINT AS clean_chars, coalesce(folds, 0) AS folds, coalesce(n, 0) AS traps_count
    FROM (SELECT video_id, sum(length(trim(text)))::BIGINT AS raw_chars FROM raw GROUP BY video_id) s
    LEFT JOIN (SELECT video_id, sum(length(text)) AS dedup_chars FROM seg GROUP BY video_id) d USING (video_id)
    LEFT JOIN (SELECT video_id, sum(length(text)) AS clean_chars, count(*) FILTER (kind = 'fold') AS folds FROM idle_rows GROUP BY video_id) c USING (video_id)
    LEFT JOIN (SELECT video_id, count(*) FILTER (trap) AS n FROM lines GROUP BY video_id) x USING (video_id)""")
def cd_1_condense_stats(spark, sf_dir):
    return condense.condense(t.seg_doc(spark, sf_dir), captions=True)[2].select("video_id", "raw_chars", "dedup_chars", "dedup_removed", "clean_chars", "folds", "traps_count")


def _conv_lines(spark, sf_dir):
    ts = F.when(F.col("turn") % 3 == 0, clock.fmt_ts(F.col("turn") * 45))
    return t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("ord"), ts.alias("ts"), "text")


@query("""SELECT conv_id AS video_id, turn AS seq, coalesce(max(CASE WHEN turn % 3 = 0 THEN turn * 45 END) OVER (PARTITION BY conv_id ORDER BY turn), 0)::DOUBLE AS start
    FROM conversations WHERE trim(text) <> ''""")
def wn_1_caption_times(spark, sf_dir):
    return captions.to_segments(_conv_lines(spark, sf_dir)).select("video_id", "seq", "start")


@query("""SELECT conv_id AS video_id, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, sum(turn)::BIGINT AS sum_minutes FROM conversations GROUP BY conv_id""")
def src_2_parse_blocks(spark, sf_dir):
    line = F.concat(F.col("turn").cast("string"), F.lit("\n00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00,000 --> 00:59:00,000\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    files = t.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("value"))
    rows = captions.parse_blocks(files)
    return rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.substring("ts", 4, 2).cast("long")).alias("sum_minutes"))


def _chapters(spark, sf_dir):
    rows = t.seg_evt(spark, sf_dir).where("text = 'signup'").select("video_id", F.expr("row_number() over (partition by video_id order by start, seq)").alias("ord"), "start", F.concat(F.lit("s"), "seq").alias("title"))
    return timeline.chapter_ends(rows.withColumn("duration", F.lit(30.0 * 86400 * 10**6))).select("video_id", "ord", "start", "end", "title")


CHAPTERS_SQL = f"""{t.SEG_EVT}, chapters AS (SELECT video_id, row_number() OVER w AS ord, s::DOUBLE AS start, coalesce(lead(s) OVER w, 2592000000000)::DOUBLE AS "end", 's' || seq AS title FROM evt WHERE text = 'signup' WINDOW w AS (PARTITION BY video_id ORDER BY s, seq))"""


@query(f"WITH {CHAPTERS_SQL} SELECT video_id, ord::INTEGER AS ord, start, \"end\", title FROM chapters")
def tl_8_chapter_ends(spark, sf_dir):
    return _chapters(spark, sf_dir)


@query(f"""WITH {CHAPTERS_SQL}, c AS (SELECT video_id, unnest(range(120))::INTEGER AS chunk_id FROM (SELECT DISTINCT video_id FROM evt))
    SELECT video_id, chunk_id, coalesce(string_agg(title, '|' ORDER BY ord), '') AS titles
    FROM c LEFT JOIN chapters h USING (video_id) WHERE h.ord IS NULL OR true
    GROUP BY ALL""".replace("LEFT JOIN chapters h USING (video_id) WHERE h.ord IS NULL OR true", "LEFT JOIN (SELECT * FROM chapters) h ON h.video_id = c.video_id AND h.start < (c.chunk_id + 1) * 21600000000.0 AND h.\"end\" > c.chunk_id * 21600000000.0").replace("SELECT video_id, chunk_id, coalesce", "SELECT c.video_id, chunk_id, coalesce"))
def tl_3_chapter_overlaps(spark, sf_dir):
    media = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct().withColumn("duration", F.lit(30.0 * 86400 * 10**6))
    chunks = timeline.plan_chunks(media, t.SLICE)
    return timeline.chapter_overlaps(chunks, _chapters(spark, sf_dir), t.SLICE).select("video_id", "chunk_id", F.array_join("titles", "|").alias("titles"))


@query(f"""WITH {t.SEG_EVT}, x AS (SELECT *, s + d AS e, unnest([s // 21600000000, s // 21600000000 + 1]) AS c FROM evt)
    SELECT video_id, seq, c::BIGINT AS chunk, greatest(s, c * 21600000000)::DOUBLE AS start, least(e, (c + 1) * 21600000000)::DOUBLE AS "end" FROM x
    WHERE s + e >= 2 * c * 21600000000 AND s + e < 2 * (c + 1) * 21600000000""")
def tl_4_own_by_midpoint(spark, sf_dir):
    c = F.floor(F.col("start") / t.SLICE)
    rows = t.seg_evt(spark, sf_dir).withColumn("chunk", F.explode(F.array(c, c + 1))).withColumns({"t0": F.col("chunk") * float(t.SLICE), "t1": (F.col("chunk") + 1) * float(t.SLICE)})
    return timeline.own_by_midpoint(rows).select("video_id", "seq", "chunk", "start", "end")


@query(f"""WITH {CHUNKS_SQL}, w AS (SELECT *, least(t0 + 20, greatest(t0, t1 - 25)) AS s0 FROM chunks), x AS (SELECT *, least(t1, s0 + 20) AS e0 FROM w)
    SELECT video_id, chunk_id, CASE WHEN e0 > s0 THEN s0 ELSE t0 END AS s, CASE WHEN e0 > s0 THEN e0 ELSE least(t1, t0 + 20) END AS e FROM x""")
def src_9_scout_windows(spark, sf_dir):
    return timeline.scout_windows(timeline.plan_chunks(t.durations(spark, sf_dir), t.CHUNK)).select("video_id", "chunk_id", "s", "e")


@query(f"""WITH {CHUNKS_SQL}, {t.SEG_DOC}, {TEXTS_SQL} SELECT c.video_id, c.chunk_id FROM chunks c ANTI JOIN (SELECT * FROM texts WHERE {TECH_SQL}) x USING (video_id, chunk_id)""")
def tl_7_missing_chunks(spark, sf_dir):
    have = timeline.chunk_texts(t.seg_doc(spark, sf_dir), t.CHUNK).where(signals.has_tech_word(F.col("text")))
    return timeline.missing_chunks(timeline.plan_chunks(t.durations(spark, sf_dir), t.CHUNK), have).select("video_id", "chunk_id")


@query("SELECT doc_id AS video_id, CASE WHEN lang = 'en' THEN 'L0-subtitle' WHEN source = 'src0' THEN 'L0-manifest' ELSE 'L0-empty' END AS nav_level FROM documents")
def tl_13_first_non_empty(spark, sf_dir):
    rows = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "lang", "source")
    levels = [("L0-subtitle", rows.where("lang = 'en'").select("video_id")), ("L0-manifest", rows.where("source = 'src0'").select("video_id")), ("L0-empty", rows.select("video_id"))]
    return timeline.first_non_empty(levels)


CUES_SQL = f"""{t.SEG_DOC}, win AS (SELECT video_id, seq AS window_id, 30 * seq AS s0, text AS quote FROM seg),
    near AS (SELECT w.video_id, w.window_id, w.quote, c.seq, c.text FROM win w JOIN seg c ON c.video_id = w.video_id AND c.seq <> w.window_id AND 30 * c.seq <= w.s0 + 20 + 25 AND 30 * c.seq + 20 >= greatest(0, w.s0 - 25))"""


def _cues(spark, sf_dir):
    rows = t.seg_doc(spark, sf_dir)
    cues = rows.select(F.col("video_id").alias("archive_id"), F.lit(0).alias("source_no"), F.col("seq").alias("cue_no"), F.col("start").alias("s"), (F.col("start") + 20).alias("e"), "text")
    windows = rows.select(F.col("video_id").alias("archive_id"), F.col("seq").alias("window_id"), F.col("start").alias("s0"), (F.col("start") + 20).alias("e0"), F.col("text").alias("quote"))
    return cues, windows


@query(f"""WITH {t.SEG_EVT}, i AS (SELECT video_id, seq, s, s + 20 * d AS e FROM evt)
    SELECT a.video_id, a.seq, count(*) AS n_meets, min(b.seq) AS least_seq FROM i a JOIN i b ON a.video_id = b.video_id AND a.s <= b.e AND b.s <= a.e AND a.seq <> b.seq GROUP BY ALL""")
def jn_4_overlapping_events(spark, sf_dir):
    rows = t.seg_evt(spark, sf_dir).withColumn("end", F.col("start") + (F.col("end") - F.col("start")) * 20)
    left, right = rows.select("video_id", "seq", "start", "end"), rows.select("video_id", F.col("seq").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"))
    pairs = intervals.overlapping(left, ("start", "end"), right, ("s", "e"), ["video_id"], t.SLICE / 60).where("seq <> other")
    return pairs.groupBy("video_id", "seq").agg(F.count(F.lit(1)).alias("n_meets"), F.min("other").alias("least_seq"))


@query(f"WITH {CUES_SQL} SELECT video_id AS archive_id, window_id, seq AS cue_no FROM near")
def tl_14_cues_near(spark, sf_dir):
    cues, windows = _cues(spark, sf_dir)
    return timeline.cues_near(cues, windows).where("cue_no <> window_id").select("archive_id", "window_id", "cue_no")


@query(f"""WITH {CUES_SQL}, said AS (SELECT video_id, window_id, {FOLD_SQL.format("any_value(quote)")} AS q, {FOLD_SQL.format("string_agg(text, ' ' ORDER BY seq)")} AS a FROM near GROUP BY video_id, window_id),
    g AS (SELECT video_id, window_id, list_distinct(list_transform(range(1, length(q)), lambda i: substring(q, i, 2))) AS q, list_distinct(list_transform(range(1, length(a)), lambda i: substring(a, i, 2))) AS a FROM said WHERE length(q) >= 2)
    SELECT video_id AS archive_id, window_id, len(q)::BIGINT AS n_quote, len(list_intersect(q, a))::BIGINT AS n_hit FROM g""")
def jn_11_recall(spark, sf_dir):
    cues, windows = _cues(spark, sf_dir)
    # A line is no evidence for itself: each window has an archive of its own, with the neighbours' cues alone.
    own = F.struct("archive_id", "window_id")
    beside = cues.withColumn("window_id", F.explode(F.array(F.col("cue_no") - 1, F.col("cue_no") + 1))).withColumn("archive_id", own).drop("window_id")
    return quotes.recall(beside, windows.withColumn("archive_id", own)).select("archive_id.archive_id", "window_id", "n_quote", "n_hit")


@query(f"SELECT doc_id, item_id AS quote_id FROM (SELECT doc_id, {FOLD_SQL.format('text')} AS hay FROM documents) d JOIN (SELECT item_id, {FOLD_SQL.format('text')} AS needle FROM benchmark) q ON needle <> '' AND contains(hay, needle)")
def jn_9_contained_quotes(spark, sf_dir):
    q = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return quotes.contained(q, t.table(spark, sf_dir, "documents"))


NAMES_SQL = f"""{t.VAULT}, names AS (SELECT DISTINCT unnest([stem, rel_stem, title, alias]) AS name, rel_stem, a, b, stem FROM vault),
    idx AS (SELECT name, count(DISTINCT rel_stem) AS n, first(rel_stem ORDER BY a, b, stem) AS alias FROM names GROUP BY name)"""


@query(f"WITH {NAMES_SQL} SELECT name, n::BIGINT AS n_candidates, alias, n > 1 AS conflict FROM idx")
def ag_4_name_index(spark, sf_dir):
    return vault.name_index(t.vault(spark, sf_dir)).select("name", F.size("candidates").cast("long").alias("n_candidates"), "alias", "conflict")


@query(f"WITH {NAMES_SQL} SELECT name, row_number() OVER (PARTITION BY name ORDER BY a, b, stem) AS ordinal, rel_stem FROM names")
def ag_4_name_candidates(spark, sf_dir):
    return vault.name_candidates(t.vault(spark, sf_dir))


def _edited(text):
    """Text with every eleventh character written otherwise."""
    return F.regexp_replace(text, "(?s)(.{10}).", "$1x")


def jn_10_fuzzy_quotes(spark, sf_dir):
    """The first words of all benchmark items, edited, in whole documents. Matching blocks aren't expressible in SQL."""
    asked = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), _edited(F.substring("text", 1, 100)).alias("quote"))
    return quotes.fuzzy_join(asked, t.table(spark, sf_dir, "documents"))


query()(jn_10_fuzzy_quotes)


def _terms(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ord"), F.explode(F.array(F.concat("p_name", F.col("p_partkey").cast("string")), F.col("p_type"), F.concat(F.lit("missing"), F.col("p_partkey").cast("string")))).alias("term"))


@query(f"""WITH {NAMES_SQL}, terms AS (SELECT p_partkey AS ord, unnest([p_name || p_partkey, p_type, 'missing' || p_partkey]) AS term FROM part)
    SELECT ord, term, coalesce(n, 0)::BIGINT AS n_candidates, CASE WHEN n = 1 THEN alias END AS target FROM terms LEFT JOIN idx ON name = term""")
def jn_6_resolve_names(spark, sf_dir):
    return vault.resolve_names(_terms(spark, sf_dir), vault.name_targets(t.vault(spark, sf_dir)))


@query(f"""WITH {t.VAULT}, keys AS (SELECT DISTINCT lower(unnest([stem, rel_stem, title, alias])) AS k FROM vault), x AS (SELECT unnest([upper(p_name) || '.md', p_brand || '\\' || p_partkey || '\\' || p_name, 'no' || p_partkey]) AS target FROM part)
    SELECT target, count(*) AS n FROM x WHERE replace(lower(regexp_replace(target, '\\.md$', '')), '\\', '/') IN (SELECT k FROM keys) GROUP BY target""".replace("\\\\", "\\"))
def jn_7_known_targets(spark, sf_dir):
    slash = F.concat_ws("\\", "p_brand", F.col("p_partkey").cast("string"), "p_name")
    x = t.table(spark, sf_dir, "part").select(F.explode(F.array(F.concat(F.upper("p_name"), F.lit(".md")), slash, F.concat(F.lit("no"), F.col("p_partkey").cast("string")))).alias("target"))
    return vault.known_targets(x, t.vault(spark, sf_dir)).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def _linked_notes(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("note_id"), F.concat(F.lit("see [["), "p_name", F.lit("|x]] and [[nope"), F.col("p_partkey").cast("string"), F.lit("#part]] or [["), F.lower("p_type"), F.lit("]]")).alias("value"))


@query(f"""WITH {t.VAULT}, keys AS (SELECT DISTINCT unnest([stem, rel_stem, rel_stem || '.md', title, alias]) AS k FROM vault), x AS (SELECT p_partkey::VARCHAR AS note_id, unnest([p_name, 'nope' || p_partkey, lower(p_type)]) AS target FROM part)
    SELECT note_id, target FROM x WHERE target NOT IN (SELECT k FROM keys)""")
def jn_8_dangling_links(spark, sf_dir):
    return vault.dangling(_linked_notes(spark, sf_dir), t.vault(spark, sf_dir))


@query("""SELECT coalesce(n.k, o.k) AS rel, CASE WHEN n.k IS NULL THEN 'remove' WHEN o.k IS NOT NULL AND n.s = o.s THEN 'reuse' ELSE 'parse' END AS action
    FROM (SELECT p_partkey AS k, p_size AS s FROM part) n FULL JOIN (SELECT p_partkey + 7 AS k, p_size + p_partkey % 2 AS s FROM part) o ON n.k = o.k""")
def vx_1_scan_plan(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    now = p.select(F.col("p_partkey").alias("rel"), F.lit(0.0).alias("mtime"), F.col("p_size").cast("long").alias("size"))
    return vault.scan_plan(now, p.select((F.col("p_partkey") + 7).alias("rel"), F.lit(0.0).alias("mtime"), (F.col("p_size") + F.col("p_partkey") % 2).alias("size")))


@query("""SELECT source AS video_id, doc_id AS ord, lang, is_auto FROM (SELECT *, doc_id % 2 = 1 AS is_auto, row_number() OVER (PARTITION BY source ORDER BY doc_id % 2, doc_id) AS r FROM documents WHERE lang = 'fr') WHERE r = 1""")
def wn_4_pick_track(spark, sf_dir):
    rows = t.table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("ord"), "lang", (F.col("doc_id") % 2 == 1).alias("is_auto"))
    return captions.pick_track(rows, "FR")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def src_14_pending(spark, sf_dir):
    stored = t.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return notes.pending(t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), stored)


@query("""WITH s AS (SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS n, printf('%02d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) AS clock FROM orders)
    SELECT o_orderkey, clock, n::DOUBLE AS lenient, n::INTEGER AS strict, (n % 3600)::DOUBLE AS short FROM s""")
def fn_1_to_3_clock(spark, sf_dir):
    c = clock.fmt_ts(F.col("o_totalprice"))
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey", c.alias("clock"))
    return rows.select("o_orderkey", "clock", clock.parse_ts(F.col("clock")).alias("lenient"), clock.ts_to_sec(F.col("clock")).alias("strict"), clock.parse_ts(F.substring_index("clock", ":", -2)).alias("short"))


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(left(l, 7) || ltrim(substring(l, 8), chr(32) || chr(9) || chr(10) || chr(13)), chr(32) || chr(9) || chr(10) || chr(13))), lambda l: l <> ''), chr(10))) AS plain_md5 FROM documents""")
def fn_4_strip_timestamps(spark, sf_dir):
    """Stamps before, within and after each line, and lines of stamps alone."""
    stamped = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("[00:01] "), F.substring(x, 1, 7), F.lit("[1:02:03]"), F.substring(x, 8, 1 << 30), F.lit(" [00:02 - 01:00:03 tag]\n[00:09]\n \t"))), "\n")
    return t.table(spark, sf_dir, "documents").select("doc_id", F.md5(clock.strip_timestamps(stamped)).alias("plain_md5"))


@query(f"""WITH f AS MATERIALIZED (SELECT doc_id, {FOLD_SQL.format('text')} AS f FROM documents), c AS MATERIALIZED (SELECT doc_id, f, string_split(f, '') AS c FROM f)
    SELECT doc_id, md5(f) AS fold_md5, len(list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])))::BIGINT AS n_bigrams FROM c""")
def fn_5_and_7_fold_bigrams(spark, sf_dir):
    from ..functions.dialect import fold

    return t.table(spark, sf_dir, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("fold_md5"), F.size(text.bigrams(F.col("text"))).cast("long").alias("n_bigrams"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'BV1x' || o_custkey || 'z_p' || (o_orderkey % 7) WHEN 1 THEN lpad(o_custkey::VARCHAR, 11, 'a') ELSE 'a_b_' || o_custkey END AS id FROM orders""")
def fn_8_resolve_id(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    source = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://x/video/BV1x"), key, F.lit("z?a=1&p="), (F.col("o_orderkey") % 7).cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://y/watch?v="), F.lpad(key, 11, "a"))).otherwise(F.concat(F.lit("/media/a b@"), key, F.lit("/?q=1")))
    return t.table(spark, sf_dir, "orders").select("o_orderkey", clock.resolve_video_id(source).alias("id"))


@query("SELECT o_orderkey, substring(sha1(o_orderstatus || '|' || o_custkey || '|None|beam=5'), 1, 16) AS run_key FROM orders")
def fn_9_run_key(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").select("o_orderkey", clock.run_key(F.col("o_orderstatus"), F.col("o_custkey"), F.lit(None), F.lit("beam=5")).alias("run_key"))


@query("""SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_concat(range(least(n_nationkey, n_regionkey), greatest(n_nationkey, n_regionkey) + 1), [n_nationkey + 40]))), ',') AS ids FROM nation""")
def fn_10_chunk_ids(spark, sf_dir):
    spec = F.concat(F.col("n_nationkey").cast("string"), F.lit(" - "), F.col("n_regionkey").cast("string"), F.lit(", x,,"), (F.col("n_nationkey") + 40).cast("string"))
    return t.table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(clock.parse_chunk_ids(spec).cast("array<string>"), ",").alias("ids"))


@query(r"SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g'))::BIGINT AS n_chars, len(regexp_extract_all(html, '<h[1-6]'))::BIGINT AS n_headings FROM pages")
def fn_15_and_ag_7_strip_tags(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", F.length(text.strip_tags(F.col("html"))).cast("long").alias("n_chars"), F.regexp_count("html", F.lit("<h[1-6]")).cast("long").alias("n_headings"))


@query(f"""WITH t AS (SELECT DISTINCT unnest([p_name, p_type, p_brand, 'The', substring(p_name, 1, 1)]) AS term FROM part)
    SELECT term, length(term) BETWEEN 2 AND 40 AND lower(term) NOT IN {_in(lexicon.STOPWORDS)} AND regexp_matches(term, '^[\\p{{L}}\\p{{N}}_\\-./+]+(\\s+[\\p{{L}}\\p{{N}}_\\-./+]+)*$') AS valid FROM t""")
def fn_11_valid_terms(spark, sf_dir):
    terms = t.table(spark, sf_dir, "part").select(F.explode(F.array("p_name", "p_type", "p_brand", F.lit("The"), F.substring("p_name", 1, 1))).alias("term")).distinct()
    return terms.select("term", text.is_valid_term(F.col("term")).alias("valid"))


@query(f"""WITH {NAMES_SQL}, terms AS (SELECT p_partkey AS ord, unnest([p_name || p_partkey, p_type, 'concept' || p_partkey]) AS term FROM part)
    SELECT ord, term, CASE WHEN NOT regexp_matches(term, '^[\\p{{L}}\\p{{N}}_\\-./+]+(\\s+[\\p{{L}}\\p{{N}}_\\-./+]+)*$') THEN 'invalid' WHEN n = 1 THEN 'strong' WHEN n > 1 THEN 'ambiguous' ELSE 'concept' END AS kind,
           CASE WHEN n = 1 THEN alias WHEN n IS NULL THEN term END AS target, CASE WHEN n > 1 THEN n END::INTEGER AS n_candidates FROM terms LEFT JOIN idx ON name = term""")
def lk_3_link_plan(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    terms = p.select(F.col("p_partkey").alias("ord"), F.explode(F.array(F.concat("p_name", F.col("p_partkey").cast("string")), F.col("p_type"), F.concat(F.lit("concept"), F.col("p_partkey").cast("string")))).alias("term")).withColumns({"type": F.lit("concept"), "target": F.lit(None).cast("string")})
    return links.link_plan(terms, vault.name_index(t.vault(spark, sf_dir)), t.vault(spark, sf_dir)).select("ord", "term", "kind", "target", F.size("candidates").alias("n_candidates"))


@query()
def lk_6_inject(spark, sf_dir):
    words = spark.createDataFrame([(0, "that", "term", "nouns/that.md"), (1, "the", "concept", None), (2, "concept-x", "concept", None)], "ord int, term string, type string, target string")
    entries = spark.createDataFrame([("nouns/that.md", "that", "nouns/that", None, ["this"])], "rel string, stem string, rel_stem string, title string, aliases array<string>")
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("note_id"), F.col("text").alias("value"))
    out = links.inject(docs, links.link_plan(words, vault.name_index(entries), entries))
    return out.select("note_id", F.length("value").alias("n_chars"), F.array_join("linked", ",").alias("linked"), "n_strong", "n_weak", "n_footer")


@query(r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS lines, doc_id % 5 AS kind, regexp_matches(text, '\S') AS said FROM documents WHERE text IS NOT NULL),
    v AS (SELECT doc_id AS video_id, CASE WHEN kind = 0 AND said THEN 0 WHEN kind = 1 THEN 1 WHEN kind = 2 THEN 2 ELSE 3 END AS level, lines, (30 * len(lines) + 119) // 120 AS n FROM x)
    SELECT video_id, ['L0-subtitle', 'L0-manifest', 'L0-A (chapters)', 'L0-B (audio scout)'][level + 1] AS nav_level, ['subtitle:own', 'whisper', 'chapters', 'whisper_scout'][level + 1] AS content_source, n::BIGINT AS chunk_count,
           (CASE level WHEN 0 THEN list_sum(list_transform(lines, lambda l: length(l))) WHEN 1 THEN length(lines[1]) WHEN 2 THEN n * length('of ' || video_id) ELSE list_sum(list_transform(range(n), lambda i: length('heard ' || i))) END)::BIGINT AS chars,
           CASE level WHEN 0 THEN n WHEN 1 THEN 1 ELSE 0 END::BIGINT AS ready, CASE level WHEN 1 THEN 'pending' WHEN 2 THEN 'meta_indexed' WHEN 3 THEN 'scouted' ELSE 'ready' END AS status FROM v""")
def tl_13_navigation(spark, sf_dir):
    """Records of documents as videos: a fifth each has captions, stored results, a chapter, and two fifths nothing, so that they are listened to."""
    rows = t.seg_doc(spark, sf_dir)
    kind = F.pmod("video_id", F.lit(5))
    media = t.durations(spark, sf_dir).withColumn("title", F.lit(None).cast("string"))
    chapters = media.where(kind == 2).select("video_id", F.lit(0).alias("ord"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.concat(F.lit("of "), F.col("video_id").cast("string")).alias("title"))
    manifests = timeline.plan_chunks(media.where(kind == 1), t.CHUNK).withColumn("status", F.lit("pending"))
    results = rows.where((kind == 1) & (F.col("seq") == 0)).select("video_id", F.lit(0).alias("chunk_id"), "seq", "text")

    def hear(batches):
        for batch in batches:
            yield batch.assign(text="heard " + batch["chunk_id"].astype(str))[["video_id", "chunk_id", "text"]]

    out = navigation.navigate(media, t.CHUNK, rows.where(kind == 0).withColumn("lang", F.lit("own")), manifests, results, chapters, hear)
    j = F.from_json("payload", "chunk_count bigint, chunk_index array<struct<chars: bigint, status: string>>")
    out = out.select("video_id", "nav_level", "content_source", j.alias("j"))
    return out.select("video_id", "nav_level", "content_source", "j.chunk_count", F.aggregate("j.chunk_index", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("chars"), F.size(F.filter("j.chunk_index", lambda x: x["status"] == "ready")).cast("long").alias("ready"), F.when((F.col("nav_level") == "L0-manifest"), "pending").otherwise(F.element_at("j.chunk_index", -1)["status"]).alias("status"))


def _doc_notes(spark, sf_dir):
    head = F.when(F.col("doc_id") % 2 == 0, F.lit("---\ntitle: x\n---\n")).otherwise("")
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit("\n```python\nx\n```\nO(n)")).when(F.col("doc_id") % 3 == 1, F.lit("\n```c\nx")).otherwise(F.lit("\n[05:20] 🎥 来源"))
    return t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("note_id"), F.concat(head, "text", tail).alias("value"))


@query(r"""WITH x AS (SELECT *, len(regexp_extract_all(text, '\$\$'))::BIGINT AS marks, regexp_matches(text, '\[\[[^\]]*\[\[') OR regexp_matches(text, '\]\][^\[]*\]\]') AS nested,
        regexp_matches(text, '\[\d{1,2}:\d{2}(:\d{2})?[^\]]*\]|[?&]t=\d+') AS timed, regexp_matches(text, '时间复杂度|空间复杂度|O\([0-9A-Za-z\s^*+\-\\,.]*\)') AS complex,
        len(regexp_extract_all(text, '(^|\n)[ \t]*```'))::BIGINT AS own_fences FROM documents)
    SELECT doc_id::VARCHAR AS note_id, doc_id % 2 = 0 AS has_frontmatter, own_fences + (CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS fences, marks AS math_marks, 0::BIGINT AS mermaid_count, nested AS nested_links,
    contains(text, '🎯') AS has_goal, len(regexp_extract_all(text, '🎯\s*学完你能'))::BIGINT AS module_goals, len(regexp_extract_all(text, '(^|\n)##\s+模块'))::BIGINT AS modules, contains(text, '闭环自测') OR contains(lower(text), 'active recall') AS has_recall,
    timed OR doc_id % 3 = 2 AS has_time_anchor, (CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS provenance_tags, complex OR doc_id % 3 = 0 AS has_complexity, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS code_blocks FROM x""")
def gate_1_to_8_features(spark, sf_dir):
    return gate.features(_doc_notes(spark, sf_dir)).select("note_id", "has_frontmatter", "fences", "math_marks", "mermaid_count", "nested_links", "has_goal", "module_goals", "modules", "has_recall", "has_time_anchor", "provenance_tags", "has_complexity", "code_blocks")


GATE_SQL = r"""WITH x AS (SELECT doc_id, doc_id % 2 = 1 AS bare, doc_id % 3 = 1 AS fence, len(regexp_extract_all(text, '\$\$')) % 2 = 1 AS math FROM documents),
    s AS (SELECT *, greatest(0, 100 - 40 * (fence::INT + math::INT)) AS format, CASE WHEN doc_id % 3 = 2 THEN 100 ELSE 20 END AS trace, CASE WHEN fence THEN 0 ELSE 100 END AS code FROM x)
    SELECT doc_id::VARCHAR AS note_id, NOT bare AND NOT fence AND NOT math AND 20 * format + 20 * 55 + 20 * trace + 15 * code + 25 * 100 >= 6950 AS passed,
           format::BIGINT AS format, 55::BIGINT AS teaching, trace::BIGINT AS trace, code::BIGINT AS code,
           concat_ws(',', CASE WHEN bare THEN 'no_frontmatter' END, CASE WHEN fence THEN 'open_fence' END, CASE WHEN math THEN 'open_math' END) AS errors FROM s"""


@query(GATE_SQL)
def gate_9_scores(spark, sf_dir):
    def hundred(c):
        return F.round(F.col(c) * 100).cast("long").alias(c)

    return gate.validate(_doc_notes(spark, sf_dir)).select("note_id", "passed", hundred("format"), hundred("teaching"), hundred("trace"), hundred("code"), F.array_join("errors", ",").alias("errors"))


@query("SELECT user_id AS video_id, strftime(time_bucket(INTERVAL 600 SECONDS, ts), '%Y-%m-%d %H:%M:%S') AS t0, count(*) AS n, sum(length(event_type))::BIGINT AS chars FROM events GROUP BY ALL")
def st_1_windows(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    return incremental.windowed(rows, 600).select("video_id", F.date_format("t0", "yyyy-MM-dd HH:mm:ss").alias("t0"), "n", "chars")


@query(f"SELECT bool_and(passed) AS passed, count(*) AS n, count(*) FILTER (NOT passed) AS n_failed FROM ({GATE_SQL})")
def src_15_batch_gate(spark, sf_dir):
    """The gate over a collection: whether every note passed."""
    return gate.validate(_doc_notes(spark, sf_dir)).agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("passed")).alias("n_failed"))
