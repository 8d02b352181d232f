"""Queries for what the tables' own texts don't hold: Chinese text, Markdown, links, anchors, captions.

Each document carries the cases. A case's strings hold a word of the document wherever they have the mark §, and its keys
begin with the document's id, so both sides derive their rows from ``documents``, by the same expressions, and their number
grows with it. Cases whose rows belong together (a video's segments, a track and its body) all come to each document; of
others each document takes one. SQL computes the result where DuckDB can; where it lacks look-around, ordered state or a
matcher, it states the rows that follow from the rules.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, dialect, text
from ..operators import condense, folds, gate, links, quotes, signals, timeline, vault
from ..sources import captions, media, notes
from . import queries as q
from . import tables as t

query = q.query
#: Columns that name what rows belong to; they begin with the document's id.
OWN_KEYS = ("video_id", "note_id", "archive_id", "audit_id", "url", "rel")
#: Marks of the document's word and of its id.
WORD, ID = "§", "¤"
_DOCS = "(SELECT doc_id, 'qx' || regexp_extract(coalesce(text, ''), '[a-z]{4,}') AS own FROM documents)"


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_value, x)) + "]"
    return "'" + x.replace("'", "''") + "'"


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in re.split(r", (?![^<]*>)", schema)]


def _rows_sql(schema: str, rows: list[tuple], cast) -> str:
    """``rows`` for the documents, as a SELECT."""
    columns = _columns(schema)
    keyed = any(c in OWN_KEYS for c, _ in columns)
    own = lambda c, kind: f"doc_id || '/' || \"{c}\"" if c in OWN_KEYS else f"replace(replace(\"{c}\", '{WORD}', own), '{ID}', doc_id::VARCHAR)" if kind == "string" else f'"{c}"'
    listed_rows = ", ".join("(" + ", ".join(map(_value, (i, *r))) + ")" for i, r in enumerate(rows))
    names = ", ".join(f'"{c}"' for c, _ in columns)
    return f"SELECT {', '.join(cast(own(c, kind), c, kind) for c, kind in columns)} FROM {_DOCS} JOIN (VALUES {listed_rows}) cases(nth, {names}) ON {'true' if keyed else f'doc_id % {len(rows)} = nth'}"


def values(name: str, schema: str, rows: list[tuple]) -> str:
    """``rows`` for the documents, as a relation for WITH."""
    return f"{name} AS ({_rows_sql(schema, rows, lambda e, c, _: f'{e} AS {chr(34)}{c}{chr(34)}')})"


#: Cases without a table: (SQL, function) by name; tests hold them, nothing registers them.
ALONE: dict = {}


def case(sql: str):
    def add(f):
        ALONE[f.__name__] = (sql, f)
        return f

    return add


def listed_alone(schema: str, rows: list[tuple]) -> str:
    columns = _columns(schema)
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    names = ", ".join(f'"{c}"' for c, _ in columns)
    return f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}::{kinds[kind]} AS {chr(34)}{c}{chr(34)}' for c, kind in columns)} FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) r({names})"


def listed(schema: str, rows: list[tuple]) -> str:
    """The rows themselves, for the documents, as a result, columns with the types of ``schema``."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    return _rows_sql(schema, rows, lambda e, c, kind: f'({e})::{kinds[kind]} AS "{c}"')


def made(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` for the documents of ``sf_dir``, as a table."""
    columns = _columns(schema)
    word = F.concat(F.lit("qx"), F.regexp_extract(F.coalesce("text", F.lit("")), "[a-z]{4,}", 0))
    docs = t.table(spark, sf_dir, "documents").select("doc_id", word.alias("own"))
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"nth int, {schema}")
    if any(c in OWN_KEYS for c, _ in columns):  # a fixed number of cases for each document
        cases = cases.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("cases"))
        one = cases.first()["cases"]
        kind = cases.schema["cases"].dataType.simpleString()
        held = docs.withColumn("case", F.explode(F.from_json(F.lit(json.dumps([r.asDict(True) for r in one], ensure_ascii=False)), kind))).select("doc_id", "own", "case.*")
    else:
        held = docs.withColumn("nth", F.pmod("doc_id", F.lit(len(rows))).cast("int")).join(F.broadcast(cases), "nth")
    text_id = F.col("doc_id").cast("string")
    own = lambda c, kind: F.concat(text_id, F.lit("/"), F.col(c)) if c in OWN_KEYS else F.replace(F.replace(c, F.lit(WORD), F.col("own")), F.lit(ID), text_id) if kind == "string" else F.col(c)
    return held.select(*[own(c, kind).alias(c) for c, kind in columns])


def joined(column, between: str = "|"):
    return F.array_join(column, between)


# --- captions -------------------------------------------------------------------------------------------------------

JSON_FILES = [
    ("v1", '{"body":[{"from":61.5,"content":" a &lt; § "},{"from":70,"content":" "},{"from":3725,"content":"你好 &amp; 再见"},{"content":"x"}]}'),
    ("v2", '{"body":[{"from":1,"content":"tail"'),
    ("v3", ' {"body":[]}'),
    ("v4", "1\n00:00:01,000 --> 00:00:02,000\nno json"),
]


@query(f"""WITH {values("files", "video_id string, value string", JSON_FILES)}, e AS (SELECT video_id, unnest(json_extract(value, '$.body[*]')) AS e, generate_subscripts(json_extract(value, '$.body[*]'), 1) - 1 AS ord
        FROM files WHERE ltrim(value) LIKE '{{%' AND json_valid(value)),
    x AS (SELECT video_id, ord::INTEGER AS ord, coalesce((e->>'from')::DOUBLE, 0)::BIGINT - CASE WHEN coalesce((e->>'from')::DOUBLE, 0)::BIGINT > coalesce((e->>'from')::DOUBLE, 0) THEN 1 ELSE 0 END AS s, replace(replace(trim(e->>'content'), '&lt;', '<'), '&amp;', '&') AS text FROM e)
    SELECT video_id, ord, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS ts, text FROM x WHERE text <> ''""")
def src_1_caption_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.parse_json(made(spark, sf_dir, JSON_FILES, "video_id string, value string"))


BLOCK_FILES = [
    ("srt", "1\n00:01:02,000 --> 00:01:04,000\n<i>Hi</i> &amp; §\n2024\n\n2\n00:01:05,000 --> 00:01:06,000\nbye"),
    ("vtt", "WEBVTT\n\n01:05.250 --> 01:07.000\n第一行\n<b>第二行</b>\n\nNOTE free text\n"),
    ("crlf", "\n\n7\r\n1:00:00.5 --> 1:00:01.5\r\n一\r\n\r\n8\r\n"),
]
BLOCK_ROWS = [
    ("srt", 2, "00:01:02", "Hi & §"), ("srt", 3, "00:01:02", "2024"), ("srt", 7, "00:01:05", "bye"),
    ("vtt", 3, "00:01:05", "第一行"), ("vtt", 4, "00:01:05", "第二行"), ("vtt", 6, None, "NOTE free text"), ("crlf", 2, "01:00:00", "一"),
]


@query(listed("video_id string, ord int, ts string, text string", BLOCK_ROWS))
def src_2_caption_blocks(spark, sf_dir):
    """Tags, entities, spoken digits, a missing hour, text outside of cues, both kinds of newlines."""
    return captions.parse_blocks(made(spark, sf_dir, BLOCK_FILES, "video_id string, value string"))


TRACKS = [("a", 0, "srt", "u0"), ("a", 1, "json", "u1"), ("a", 2, "json", "u2"), ("b", 0, "vtt", "u3"), ("c", 0, "srt", "u4"), ("c", 1, None, "u5"), ("d", 0, "json", None), ("e", 0, "json", "u6"), ("e", 1, "srt", "u7")]
BODIES = [("u0", "1\n00:00:01,0 --> 00:00:02,0\nhi"), ("u1", "{bad"), ("u2", '{"body":[{"from":1,"content":"x"}]}'), ("u3", None), ("u4", "00:00:01,0 --> 00:00:02,0\nx"), ("u5", "00:00:01,0 --> 00:00:02,0\ny"), ("u6", '{"body":[]}'), ("u7", "00:00:03.0 --> 00:00:04.0\nz")]


@query(f"""WITH {values("tracks", "video_id string, ord int, ext string, url string", TRACKS)}, {values("bodies", "url string, value string", BODIES)}
    SELECT video_id, url FROM tracks JOIN bodies USING (url) WHERE (value LIKE '{{%' AND json_valid(value) AND json_array_length(value, '$.body') > 0) OR value LIKE '%-->%'
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY coalesce(ext, '') <> 'json', ord) = 1""")
def src_4_choose_download(spark, sf_dir):
    return media.choose_download(made(spark, sf_dir, TRACKS, "video_id string, ord int, ext string, url string"), made(spark, sf_dir, BODIES, "url string, value string"))


SOURCES = [("bilibili", "BV1b7411N798_p43"), ("bilibili", "BV1x?p2"), ("bilibili", "BV1x&7"), ("bilibili", "BV1x"), ("bilibili", "https://b/BV1x_p2"), ("youtube", "abc"), ("bilibili", "BV1x_px")]


@query(f"""WITH {values("s", "platform string, source string", SOURCES)} SELECT source, CASE WHEN platform <> 'bilibili' OR source LIKE 'http%://%' THEN source
    WHEN regexp_matches(source, '^BV[a-zA-Z0-9]+[_?&][pP]?[0-9]+$') THEN 'https://www.bilibili.com/video/' || regexp_replace(source, '^(BV[a-zA-Z0-9]+)[_?&][pP]?([0-9]+)$', '\\1?p=\\2') ELSE 'https://www.bilibili.com/video/' || source END AS url FROM s""")
def src_5_media_url(spark, sf_dir):
    return made(spark, sf_dir, SOURCES, "platform string, source string").select("source", media.media_url(F.col("source"), F.col("platform")).alias("url"))


STORED_META = [("b", "1", "title", "{}", None), ("b", "2", "", "{}", "{}"), ("b", "3", "t", None, None), ("y", "1", "t", None, "{}"), ("b", "9", "t", "{}", "{}")]
ASKED_META = [("b", "1"), ("b", "2"), ("b", "3"), ("y", "1"), ("y", "2")]


@query(f"""WITH {values("stored", "platform string, video_id string, title string, subtitles string, automatic_captions string", STORED_META)}, {values("asked", "platform string, video_id string", ASKED_META)}
    SELECT platform, video_id FROM asked a WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.platform = a.platform AND s.video_id = a.video_id AND title <> '' AND (subtitles IS NOT NULL OR automatic_captions IS NOT NULL))""")
def src_5_missing_metadata(spark, sf_dir):
    stored = made(spark, sf_dir, STORED_META, "platform string, video_id string, title string, subtitles string, automatic_captions string")
    return media.missing_metadata(made(spark, sf_dir, ASKED_META, "platform string, video_id string"), stored)


AUDIO = [("b", "1", 102400, 3.5), ("b", "2", 102399, 3.5), ("b", "3", 999999, None), ("b", "4", 999999, 0.0), ("y", "1", 102400, 1.0)]


@query(f"""WITH {values("files", "platform string, video_id string, length bigint, seconds double", AUDIO)}, {values("asked", "platform string, video_id string", ASKED_META)}
    SELECT f.platform, f.video_id FROM files f JOIN asked USING (platform, video_id) WHERE length >= 102400 AND seconds > 0""")
def src_6_usable_audio(spark, sf_dir):
    files = made(spark, sf_dir, AUDIO, "platform string, video_id string, length bigint, seconds double")
    return media.usable_audio(files, made(spark, sf_dir, ASKED_META, "platform string, video_id string")).select("platform", "video_id")


HEARD = [(0, 598.0, 601.0, "mostly first"), (0, 599.9, 603.0, "mostly second"), (1, 598.0, 601.0, "mostly first"), (1, 599.9, 603.0, " mostly second "), (1, 700.12345, 701.5, "in"), (1, 1199.5, 1200.6, "past the end"), (1, 800.0, 801.0, "  ")]


@query(f"""WITH {values("heard", "video_id string, chunk_id int, s double, e double, text string", [("v", *h) for h in HEARD])}
    SELECT chunk_id, round(greatest(s, chunk_id * 600.0), 3)::DOUBLE AS start, round(least(e, (chunk_id + 1) * 600.0), 3)::DOUBLE AS "end", trim(text) AS text FROM heard
    WHERE (s + e) / 2 >= chunk_id * 600 AND (s + e) / 2 < (chunk_id + 1) * 600 AND trim(text) <> ''""")
def src_8_transcribe(spark, sf_dir):
    """A transcriber that says what is listed, to chunks of ten minutes."""
    import pandas as pd

    heard = list(HEARD)

    def say(batches):
        for batch in batches:
            rows = [(c.video_id, c.chunk_id, c.t0, c.t1, s, e, words) for c in batch.itertuples() for at, s, e, words in heard if at == c.chunk_id and c.s <= s + 1]
            yield pd.DataFrame(rows, columns=["video_id", "chunk_id", "t0", "t1", "start", "end", "text"])

    chunks = timeline.plan_chunks(made(spark, sf_dir, [("v", 1200.0)], "video_id string, duration double"), 600)
    return media.transcribe(chunks, say).select("chunk_id", "start", "end", "text")


TERM_FILES = [('[{"term":"dp","type":"concept"},{"term":"树","target":"t.md"}]',), ('{"terms":[{"term":"x §"}]}',), ('{"other":1}',)]


@query(f"""WITH {values("files", "value string", TERM_FILES)}, l AS (SELECT CASE WHEN value LIKE '[%' THEN json_extract(value, '$[*]') ELSE json_extract(value, '$.terms[*]') END AS l FROM files)
    SELECT (i - 1)::INTEGER AS ord, e->>'term' AS term, e->>'type' AS type, e->>'target' AS target FROM (SELECT unnest(l) AS e, generate_subscripts(l, 1) AS i FROM l)""")
def src_11_terms(spark, sf_dir):
    return notes.parse_terms(made(spark, sf_dir, TERM_FILES, "value string"))


ARCHIVES = [("json", '{"content":"§","content_plain":"","transcript":"t","lines":["l1","l2"]}'), ("none", '{"other":"x"}'), ("bad", '{"content":"a"'), ("raw", "[00:01] hi"), ("odd", '{"content_dehydrated":"d","lines":7}')]


@query(listed("archive_id string, value string", [("json", "§\nt\nl1\nl2"), ("none", ""), ("bad", '{"content":"a"'), ("raw", "[00:01] hi"), ("odd", "d")]))
def src_12_archives(spark, sf_dir):
    return notes.parse_archives(made(spark, sf_dir, ARCHIVES, "archive_id string, value string"))


ZH_TRACKS = [
    ("a", 0, "en", False), ("a", 1, "zh-TW", False), ("a", 2, "zh-Hans", False), ("b", 0, "ai-zh", True), ("b", 1, "zh-HK", False), ("c", 0, "zh-HK", True), ("c", 1, "yue-zh", False),
    ("d", 0, "fr", False), ("e", 0, "zh", True), ("e", 1, "zh-auto", True), ("f", 0, "en-GB", False), ("f", 1, "en", True), ("g", 0, "en-US", True), ("g", 1, "en-orig-long", False), ("g", 2, "zh-CN", False),
]
_RANKED = f"""{values("tracks", "video_id string, ord int, lang string, is_auto boolean", ZH_TRACKS)}, zh AS (SELECT *, CASE WHEN NOT is_auto AND list_position(['zh-hans', 'zh-cn', 'zh', 'zh-hant', 'zh-tw'], lower(lang)) > 0 THEN 100 + list_position(['zh-hans', 'zh-cn', 'zh', 'zh-hant', 'zh-tw'], lower(lang))
        WHEN is_auto AND list_position(['ai-zh', 'zh-auto'], lower(lang)) > 0 THEN 200 + list_position(['ai-zh', 'zh-auto'], lower(lang)) WHEN contains(lower(lang), 'zh') THEN 300 + is_auto::INT END AS rank FROM tracks)"""


@query(f"WITH {_RANKED} SELECT video_id, ord, lang, is_auto FROM zh WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY rank, ord) = 1")
def wn_4_chinese_tracks(spark, sf_dir):
    return captions.pick_track(made(spark, sf_dir, ZH_TRACKS, "video_id string, ord int, lang string, is_auto boolean"))


@query(f"""WITH {_RANKED}, p AS (SELECT *, CASE WHEN lang = 'en' THEN is_auto::INT WHEN lang LIKE 'en%' THEN 10 + is_auto::INT ELSE rank END AS r FROM zh)
    SELECT video_id, ord, lang, is_auto FROM p WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY r, CASE WHEN r IN (10, 11) THEN -length(lang) ELSE 0 END, ord) = 1""")
def wn_4_preferred_tracks(spark, sf_dir):
    return captions.pick_track(made(spark, sf_dir, ZH_TRACKS, "video_id string, ord int, lang string, is_auto boolean"), "en")


# --- functions ------------------------------------------------------------------------------------------------------

NORMALIZED = [("优化 啊 aab", "异或ab"), ("五二比特哈希", "512比特哈希"), ("对吧对吧好", "对好"), ("MAX值", "mac值"), ("Hello,, World", "heloworld"), ("你看这个沙溢", "sha1"), ("", ""), ("欧派的", "opad的"), ("A_B", "ab")]


@query(listed("raw string, plain string", NORMALIZED))
def fn_6_normalize(spark, sf_dir):
    return made(spark, sf_dir, [(a,) for a, _ in NORMALIZED], "raw string").select("raw", text.normalize_tokens(F.col("raw")).alias("plain"))


PLACES = [("use dp §", "dp", 5), ("dp§数组", "dp", 0), ("the DP", "dp", 5), ("学递归法", "递归", 2), ("a递归", "递归", 0), ("递归_x 递归", "递归", 6), ("x c++ y", "c++", 0), ("c++x", "c++", 1), ("adp dp", "dp", 5), ("", "dp", 0)]


@query(listed("text string, term string, at int", PLACES))
def fn_12_term_position(spark, sf_dir):
    return made(spark, sf_dir, [p[:2] for p in PLACES], "text string, term string").select("text", "term", text.term_position(F.col("text"), F.col("term")).alias("at"))


@query(f"""WITH {values("x", "note_id string, text string", [(str(i), a) for i, (a, _, _) in enumerate(PLACES)])}, terms(ord, term) AS (VALUES (0, 'dp'), (1, '递归')),
    h AS (SELECT note_id, ord, term, CASE WHEN term = 'dp' THEN regexp_extract(text, '(?i)^(|.*?[^\\p{{L}}\\p{{N}}_])dp($|[^\\p{{L}}\\p{{N}}_])', 1) ELSE regexp_extract(text, '^(|.*?[^A-Za-z0-9_])递归($|[^A-Za-z0-9_])', 1) END AS head,
        CASE WHEN term = 'dp' THEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])dp($|[^\\p{{L}}\\p{{N}}_])') ELSE regexp_matches(text, '(^|[^A-Za-z0-9_])递归($|[^A-Za-z0-9_])') END AS hit FROM x, terms)
    SELECT note_id, ord::BIGINT AS ord, term, length(head) + 1 AS at FROM h WHERE hit""")
def wn_5_first_mentions(spark, sf_dir):
    rows = made(spark, sf_dir, [(str(i), a) for i, (a, _, _) in enumerate(PLACES)], "note_id string, value string")
    return links.first_mentions(rows, spark.createDataFrame([(0, "dp"), (1, "递归"), (7, "dp")], "ord int, term string"))


ENTITIES = [("a &amp;&lt;b&gt;", "a &<b>"), ("&#39;x&#x27; &quot;", "'x' \""), ("&copy; &hellip; &notanentity;", "© … ¬anentity;"), ("plain §", "plain §")]


@query(listed("raw string, plain string", ENTITIES))
def fn_15_entities(spark, sf_dir):
    return made(spark, sf_dir, [(a,) for a, _ in ENTITIES], "raw string").select("raw", text.html_unescape(F.col("raw")).alias("plain"))


HEADS = [
    ("a.md", "---\ntitle: One §\naliases: [uno, '§', uno]\n---\nx", "One §", "uno|§"), ("b/c.md", "---\naliases:\n  - due\n  - \"zwei\"\n---\n", None, "due|zwei"),
    ("d.md", "no head\n---\ntitle: x\n---\n", None, ""), ("e.md", "---\r\ntitle: '树'\r\nalias: [林, ]\r\n---\r\n", "树", ""),  # the key is "aliases"
]


@query(listed("rel string, stem string, title string, aliases string", [(r, r.split("/")[-1][:-3], t, a) for r, _, t, a in HEADS]))
def fn_17_front_matter(spark, sf_dir):
    rows = made(spark, sf_dir, [h[:2] for h in HEADS] + [(".git/x.md", ""), ("a/.b/x.md", "")], "rel string, value string")
    return vault.note_entries(rows).select("rel", "stem", "title", joined("aliases").alias("aliases"))


RATIOS = [(1, 3, "33.3%"), (1, 800, "0.1%"), (1, 400, "0.2%"), (3, 400, "0.8%"), (0, 5, "0.0%"), (5, 5, "100.0%"), (2, 0, "200.0%"), (2, 3, "66.7%")]


@query(listed("a bigint, b bigint, ratio string", RATIOS))
def fn_14_ratios(spark, sf_dir):
    return made(spark, sf_dir, [r[:2] for r in RATIOS], "a bigint, b bigint").select("a", "b", dialect.ratio_text(F.col("a"), F.col("b")).alias("ratio"))


ROUNDED = [(0.125, 0.12), (0.285, 0.28), (2.675, 2.67), (0.375, 0.38), (-0.125, -0.12), (1.0, 1.0)]


@query(listed("x double, y double", ROUNDED))
def fn_14_rounding(spark, sf_dir):
    return made(spark, sf_dir, [r[:1] for r in ROUNDED], "x double").select("x", text.py_round2(F.col("x")).alias("y"))


# --- predicates -----------------------------------------------------------------------------------------------------

TALK = [("dp数组 §",), ("特别",), ("for for dp",), ("注意 麦克风",), ("谢谢老板送的礼物",), ("感谢大家送出的大飞机",), ("我喝口水",), ("§动态规划",), ("用 DP 做 §",), ("x[i] 越界",), ("int main",), ("好吧\n扣1",), ("",), ("错误error处理",), ("an error § here",), ("f 函数",), ("a;",)]


@query(f"""WITH {values("x", "text string", TALK)} SELECT text AS line, {q.TECH_SQL} AS tech, {q.TRAP_SQL} AS trap, {q.CODE_SQL} AS code, {q.FORMULA_SQL} AS formula, {q.NOISE_SQL} AS noise FROM x""")
def pr_1_to_6_chinese(spark, sf_dir):
    c = F.col("line")
    rows = made(spark, sf_dir, TALK, "line string")
    return rows.select("line", signals.has_tech_word(c).alias("tech"), signals.has_trap(c).alias("trap"), signals.has_code(c).alias("code"), signals.has_formula(c).alias("formula"), signals.is_noise(c).alias("noise"))


@query(f"""WITH {values("x", "text string", TALK)}, h AS (SELECT text, {q.HITS_SQL} AS hits FROM x)
    SELECT text AS line, array_to_string(list_filter(hits, lambda w, i: list_position(hits, w) = i)[1:5], '|') AS keywords, len(hits)::BIGINT AS n_hits, least(1.0, len(hits) / greatest(1.0, length(text) / 80.0::DOUBLE))::DOUBLE AS density FROM h""")
def ag_1_chinese_signals(spark, sf_dir):
    rows = made(spark, sf_dir, TALK, "line string").withColumn("s", signals.analyze(F.col("line")))
    return rows.select("line", joined("s.keywords").alias("keywords"), "s.n_hits", "s.density")


FILLED = [("然后然后然后走",), ("就是然后好§",), ("对吧对吧，，，好！！",), ("那个x那个",), ("。！？end",), ("也就是说也就是说",)]


@query(f"""WITH {values("x", "raw string", FILLED)} SELECT raw, regexp_replace(regexp_replace(raw, '(对吧|就是|然后|那个|怎么说|听懂了吗|也就是说|好吧|其实就是){{2,}}', '\\1', 'g'), '([，。！？；]){{2,}}', '\\1', 'g') AS tidy FROM x""")
def pr_7_tidy(spark, sf_dir):
    return made(spark, sf_dir, FILLED, "raw string").select("raw", condense.tidy(F.col("raw")).alias("tidy"))


PATHS = [("a/b.md",), (".git/x.md",), ("a/.b/c.md",), ("a.b/c.md",), ("_x.md",)]


@query(f"WITH {values('p', 'rel string', PATHS)} SELECT rel FROM p WHERE NOT regexp_matches(rel, '(^|/)\\.')")
def pr_11_visible(spark, sf_dir):
    return made(spark, sf_dir, PATHS, "rel string").where(vault.visible(F.col("rel")))


PAYLOADS = [("v", "raw", "dry§", "ev", "plain"), ("w", None, "d2", None, "p2")]
PAYLOAD = "video_id string, content string, content_dehydrated string, content_evidence string, content_plain string"


@query(listed("video_id string, kind string, payload string", [
    ("v", "archive", '{"video_id":"¤/v","content":"raw","content_dehydrated":"dry§","content_plain":"plain"}'), ("w", "archive", '{"video_id":"¤/w","content_dehydrated":"d2","content_plain":"p2"}'),
    ("v", "llm", '{"video_id":"¤/v","content_dehydrated":"dry§"}'), ("w", "llm", '{"video_id":"¤/w","content_dehydrated":"d2"}'),
    ("v", "evidence", '{"video_id":"¤/v","content_dehydrated":"ev","content_evidence":"ev"}'), ("w", "evidence", '{"video_id":"¤/w"}'),
]))
def pr_12_payloads(spark, sf_dir):
    rows = made(spark, sf_dir, PAYLOADS, PAYLOAD)
    kinds = {"archive": notes.archive_payload(rows, full=True), "llm": notes.archive_payload(rows), "evidence": notes.archive_payload(rows, evidence=True)}
    a, b, c = (df.withColumn("kind", F.lit(k)) for k, df in kinds.items())
    return a.unionByName(b).unionByName(c).select("video_id", "kind", "payload")


# --- timelines ------------------------------------------------------------------------------------------------------

PLAN = [("v", 0, 0.0, 600.0, "done"), ("v", 1, 600.0, 1200.0, "pending"), ("v", 2, 1200.0, 1500.0, None), ("w", 0, 0.0, 90.0, "done")]
PLAN_SCHEMA = "video_id string, chunk_id int, t0 double, t1 double, status string"
RESULTS = [("v", 0, 1, 0.0, 4.0, "讲递归"), ("v", 0, 0, 2.0, 5.0, "dp 数组"), ("v", 1, 0, 601.0, 610.0, "注意边界§"), ("w", 0, 0, 1.0, 2.0, "hi")]
RESULT_SCHEMA = "video_id string, chunk_id int, seq bigint, start double, end double, text string"


def _plan(spark, sf_dir) -> DataFrame:
    return made(spark, sf_dir, PLAN, PLAN_SCHEMA)


def _results(spark, sf_dir) -> DataFrame:
    return made(spark, sf_dir, RESULTS, RESULT_SCHEMA)


_PLAN_SQL = values("plan", PLAN_SCHEMA, PLAN) + ", " + values("results", RESULT_SCHEMA.replace("end ", "stop ").replace("start ", "begin "), RESULTS)


@query(f"WITH {_PLAN_SQL} SELECT 'chosen' AS kind, video_id, chunk_id::INTEGER AS chunk_id FROM plan WHERE chunk_id IN (0, 2) UNION ALL SELECT 'done', video_id, chunk_id FROM plan SEMI JOIN results USING (video_id, chunk_id) UNION ALL SELECT 'all', video_id, chunk_id FROM plan")
def tl_6_and_pr_8_selection(spark, sf_dir):
    """Chunks by number (a list, none, all) and those that have a result."""
    plan, results = _plan(spark, sf_dir), _results(spark, sf_dir)
    kinds = {"chosen": timeline.select_chunks(plan, [0, 2]), "none": timeline.select_chunks(plan, []), "all": timeline.select_chunks(plan, None), "done": timeline.finished_chunks(plan, results)}
    a, b, c, d = (df.select(F.lit(k).alias("kind"), "video_id", "chunk_id") for k, df in kinds.items())
    return a.unionByName(b).unionByName(c).unionByName(d)


@query(listed("video_id string, seq bigint, text string", [("v", 0, "dp 数组"), ("v", 1, "讲递归"), ("w", 0, "hi")]))
def tl_5_and_jn_1_merge(spark, sf_dir):
    """Chosen chunks merged; those two overlap by two of three seconds, which is under 0.7."""
    return timeline.merge_chunks(_plan(spark, sf_dir), _results(spark, sf_dir), [0]).select("video_id", "seq", "text")


@query(f"""WITH {_PLAN_SQL}, t AS (SELECT video_id, chunk_id, string_agg(text, '' ORDER BY seq) AS text FROM results GROUP BY ALL), j AS (SELECT p.*, t.text AS own, coalesce(t.text, '') AS text FROM plan p LEFT JOIN t USING (video_id, chunk_id))
    SELECT video_id, chunk_id::INTEGER AS chunk_id, CASE WHEN own IS NOT NULL THEN 'ready' ELSE coalesce(status, 'unknown') END AS status, length(text)::BIGINT AS chars, array_to_string({q.HITS_SQL}, '|') AS keywords, {q.TRAP_SQL} AS has_warning FROM j""")
def tl_9_index_of_results(spark, sf_dir):
    out = timeline.chunk_index_from_results(_plan(spark, sf_dir), _results(spark, sf_dir), None, 600)
    return out.select("video_id", "chunk_id", "status", "chars", joined("keywords").alias("keywords"), "has_warning")


CHAPTERS = [("v", 0, 0.0, 700.0, "递归 basics"), ("v", 1, 700.0, 1500.0, "dp")]


@query(listed("video_id string, chunk_id int, status string, chars bigint, hints string, keywords string", [("v", 0, "meta_indexed", 9, "递归 basics", "递归"), ("v", 1, "meta_indexed", 12, "递归 basics|dp", "递归|dp"), ("v", 2, "meta_indexed", 2, "dp", "dp"), ("w", 0, "meta_indexed", 0, "", "")]))
def tl_11_index_of_chapters(spark, sf_dir):
    chapters = made(spark, sf_dir, CHAPTERS, "video_id string, ord int, start double, end double, title string")
    out = timeline.chunk_index_from_chapters(_plan(spark, sf_dir), chapters, 600)
    return out.select("video_id", "chunk_id", "status", "chars", joined("topic_hints").alias("hints"), joined("keywords").alias("keywords"))


@query(f"""WITH {_PLAN_SQL} SELECT video_id, chunk_id::INTEGER AS chunk_id, printf('%02d:%02d:%02d', t0::BIGINT // 3600, t0::BIGINT % 3600 // 60, t0::BIGINT % 60) AS start, (t1 - t0)::DOUBLE AS duration_s, 'pending' AS status, 0::BIGINT AS chars, 0.0::DOUBLE AS density, '' AS keywords, false AS has_code FROM plan""")
def tl_12_empty_index(spark, sf_dir):
    return timeline.empty_index(_plan(spark, sf_dir)).select("video_id", "chunk_id", "start", "duration_s", "status", "chars", "density", joined("keywords").alias("keywords"), "has_code")


def _envelope(video, title, duration, clock_text, rows):
    row = {"status": "pending", "chars": 0, "keywords": [], "topic_hints": [], "density": 0.0, "has_code": False, "has_formula": False, "has_warning": False}
    index = [{"id": i, "start": a, "end": b, "duration_s": d, **row} for i, a, b, d in rows]
    return json.dumps({"video_id": video, "title": title, "duration": duration, "duration_str": clock_text, "content_source": "none", "nav_level": "L0-empty", "chunk_count": len(index), "chunk_index": index}, ensure_ascii=False, separators=(",", ":"))


@query(listed("video_id string, payload string", [
    ("v", _envelope("¤/v", "课§", 1500.0, "00:25:00", [(0, "00:00:00", "00:10:00", 600.0), (1, "00:10:00", "00:20:00", 600.0), (2, "00:20:00", "00:25:00", 300.0)])),
    ("w", _envelope("¤/w", "", 90.0, "00:01:30", [(0, "00:00:00", "00:01:30", 90.0)])), ("x", _envelope("¤/x", "none", 0.0, "00:00:00", [])),
]))
def snk_3_envelopes(spark, sf_dir):
    videos = made(spark, sf_dir, [("v", "课§", 1500.0), ("w", None, 90.0), ("x", "none", 0.0)], "video_id string, title string, duration double")
    return timeline.index_envelopes(timeline.empty_index(_plan(spark, sf_dir)), videos, "none", "L0-empty")


DESCRIPTIONS = [
    ("v", 600.0, "intro §\n00:00 开场§\n[01:30] - 递归：入门\n(02:00) http://x\n1:05:00 — 结束", []), ("w", 50.0, "no times", []), ("x", 90.0, "00:10 ignored", [(0.0, 40.0, " one "), (40.0, 50.0, " ")]),
]


@query(listed("video_id string, ord int, start double, end double, title string", [("v", 0, 0.0, 90.0, "开场§"), ("v", 1, 90.0, 3900.0, "递归：入门"), ("v", 3, 3900.0, 600.0, "结束"), ("x", 0, 0.0, 40.0, "one")]))
def tl_8_description_chapters(spark, sf_dir):
    rows = made(spark, sf_dir, DESCRIPTIONS, "video_id string, duration double, description string, chapters array<struct<start_time: double, end_time: double, title: string>>")
    return timeline.chapters_from_description(rows)


# --- condensation ---------------------------------------------------------------------------------------------------

LECTURE = [
    ("v", 0, 0.0, "你好"), ("v", 1, 45.0, "今天，天气"), ("v", 2, 90.0, "嗯嗯"), ("v", 3, 135.0, "然后然后写dp[i]"), ("v", 4, 180.0, "写dp[i]麦克风好"), ("v", 5, 225.0, "注意麦克风，扣1"), ("v", 6, 270.0, "a"), ("v", 7, 315.0, "b"),
    ("w", 0, 0.0, "循环里别写错"), ("w", 1, 10.0, "别写错"), ("w", 2, 20.0, "就这样"),
]
LECTURE_SCHEMA = "video_id string, seq bigint, start double, text string"


def _lecture(spark, sf_dir) -> DataFrame:
    return made(spark, sf_dir, LECTURE, LECTURE_SCHEMA)


@query(listed("video_id string, line string", [("v", "[00:00:00 - 00:01:30 闲聊互动/休息闲谈，已自动折叠]"), ("v", "[00:02:15] 然后写dp[i]"), ("v", "[00:03:45] 注意麦克风，"), ("v", "[00:04:30] a"), ("v", "[00:05:15] b"), ("w", "[00:00:00] 循环里别写错"), ("w", "[00:00:20] 就这样")]))
def cd_1_and_5_captions(spark, sf_dir):
    """Repeated heads out, small talk out, an idle run folded, lines rendered."""
    return condense.render(condense.condense(_lecture(spark, sf_dir), captions=True)[0]).select("video_id", "line")


@query(listed("video_id string, raw_chars bigint, dedup_chars bigint, dedup_removed bigint, clean_chars bigint, folds bigint, traps_count bigint, compression_ratio string", [("v", 39, 33, 6, 16, 1, 1, "59.0%"), ("w", 12, 9, 3, 9, 0, 1, "25.0%")]))
def cd_1_and_ag_2_caption_stats(spark, sf_dir):
    return condense.condense(_lecture(spark, sf_dir), captions=True)[2].select("video_id", "raw_chars", "dedup_chars", "dedup_removed", "clean_chars", "folds", "traps_count", "compression_ratio")


@query(listed("video_id string, seq bigint, time string, text string", [("v", 5, "00:03:45", "注意麦克风，"), ("w", 0, "00:00:00", "循环里别写错")]))
def cd_1_traps(spark, sf_dir):
    return condense.condense(_lecture(spark, sf_dir), captions=True)[1].select("video_id", "seq", "time", "text")


@query(listed("video_id string, seq bigint, kind string, text string", [("v", 3, "line", "然后写dp[i]"), ("v", 5, "line", "注意麦克风，"), ("v", 6, "line", "a"), ("v", 7, "line", "b")]))
def cd_3_selection_below(spark, sf_dir):
    """Chunks of 100 seconds from the second on: the idle run lies in the first, and what is left has none of it."""
    return condense.condense_selected(_lecture(spark, sf_dir), [1, 2, 3], 100, captions=True)[0].select("video_id", "seq", "kind", "text")


@query(listed("video_id string, orig_chars bigint, evidence_chars bigint, evidence_reduction string", [("v", 16, 14, "12.5%"), ("w", 9, 6, "33.3%")]))
def cd_4_and_ag_3_evidence_stats(spark, sf_dir):
    rows, found, _ = condense.condense(_lecture(spark, sf_dir), captions=True)
    return condense.evidence_stats(rows, condense.evidence(rows, found))


FOLDED = [("a", 0, 0.0, "递归讲到这里了吗同学们"), ("a", 1, 1.0, "讲到这里了吗同学们下课"), ("b", 0, 0.0, "abcdefghijkl"), ("b", 1, 1.0, "cdefghijklmn"), ("b", 2, 2.0, "lmn"), ("b", 3, 3.0, "mnop")]


@query(listed("video_id string, seq bigint, text string", [("a", 0, "递归讲到这里了吗同学们"), ("a", 1, "讲到这里了吗同学们下课"), ("b", 0, "abcdefghijkl"), ("b", 1, "mn"), ("b", 2, "lmn"), ("b", 3, "mnop")]))
def f_2_chinese_window(spark, sf_dir):
    """A head of nine characters stays after Chinese text, whose window is eight; one of ten goes elsewhere; two characters are too few."""
    return folds.drop_repeated_heads(made(spark, sf_dir, FOLDED, LECTURE_SCHEMA)).select("video_id", "seq", "text")


# --- quotations -----------------------------------------------------------------------------------------------------

FUZZY = [("abcdefghij", "xxabcdefgXijyy", True), ("abcdefghij", "zyxwvutsrq", False), ("abc", "abd", False), ("动态规划的本质是状态转移", "那么动态规划本质就是状态的转移了对吧", True), ("动态规划的本质是状态转移", "贪心每一步都选最优", False), ("abcdef", "", False)]


@query(listed("needle string, hay string, near boolean", FUZZY))
def jn_10_fuzzy(spark, sf_dir):
    return made(spark, sf_dir, [r[:2] for r in FUZZY], "needle string, hay string").select("needle", "hay", quotes.fuzzy_match(F.col("needle"), F.col("hay")).alias("near"))


CUES = [("n", "=== SOURCE: one\n[00:10 --> 00:15] 先看递归的边界\n[00:50 --> 00:55] 递归要有出口\n=== SOURCE: two\n[00:12 --> 00:20] 递归一定要有出口 不然就死循环")]
WINDOWS = [("n", 0, 12.0, 14.0, "递归要有出口"), ("n", 1, 500.0, 510.0, "递归要有出口"), ("n", 2, 30.0, 31.0, "x")]


@query(listed("archive_id string, window_id int, n_quote bigint, n_hit bigint", [("n", 0, 5, 4)]))
def ag_10_recall_over_sources(spark, sf_dir):
    """The better of two sources counts; windows without a cue near, and quotes of one character, have no row."""
    return quotes.recall(quotes.parse_cues(made(spark, sf_dir, CUES, "archive_id string, value string")), made(spark, sf_dir, WINDOWS, "archive_id string, window_id int, s0 double, e0 double, quote string"))


def _anchor(quote, name="老师", a="00:10", b="00:20", mic="🎙️"):
    return f'> [!quote] {mic} 原片教学锚点（{name}）\n> "{quote}"\n> —— [{a} - {b}]\n\n'


ANCHORED = [
    ("literal", _anchor("递归要有出口")), ("marks", _anchor("递归，要有出口！", mic="🎤")), ("made up", _anchor("完全没有说过的一句话§而已")), ("recall", _anchor("递归必须要有出口")), ("none", _anchor("没有存档的引文")),
    ("many", "".join(_anchor(f"第{i}句") for i in range(7))), ("twice", _anchor("同一句") * 2), ("long", _anchor("长" * 102)), ("no name", _anchor("引文", name=" ")), ("late", _anchor("引文", a="00:30")), ("clock", _anchor("引文", b="00:99")),
    ("drift", "> 原片教学锚点（x）\n"), ("torn", "> [!quote] 🎙️ 原片教学锚点（x）\n> 无引号\n"), ("dots", _anchor("先这样…再那样")), ("blank", _anchor("  ")),
]
ARCHIVED = [(k, "[00:05 --> 00:12] 那么递归呢它要\n[00:12 --> 00:25] 有出口的 递归要有出口") for k in ("literal", "marks", "made up")] + [("recall", "[00:05 --> 00:12] 递归它必须得\n[00:12 --> 00:25] 必须要有那个出口 要有出口"), ("none", "")]
ANCHOR_ROWS = [
    ("literal", 1, "", ""), ("marks", 1, "", ""), ("made up", 1, "unsupported", ""), ("recall", 1, "", ""), ("none", 1, "", "no_archive"), ("many", 7, "too_many", "|".join(["no_archive"] * 7)),
    ("twice", 2, "duplicate", "no_archive|no_archive"), ("long", 1, "long_quote", "no_archive"), ("no name", 1, "no_name", "no_archive"), ("late", 1, "reversed_time", "no_archive"), ("clock", 1, "bad_time", "no_archive"),
    ("drift", 0, "format_drift", ""), ("torn", 0, "incomplete", ""), ("dots", 1, "", "ellipsis|no_archive"), ("blank", 1, "empty_quote", ""),
]


@query(listed("note_id string, anchor_count bigint, errors string, warnings string", ANCHOR_ROWS))
def gate_10_and_jn_12_anchors(spark, sf_dir):
    found = quotes.check_anchors(made(spark, sf_dir, ANCHORED, "note_id string, value string"), made(spark, sf_dir, ARCHIVED, "archive_id string, value string"))
    return found.select("note_id", "anchor_count", joined("errors").alias("errors"), joined("warnings").alias("warnings"))


@query(f"""WITH {values("x", "note_id string, i int, quote string", [(n, i, x) for n, v in ANCHORED for i, x in enumerate(re.findall('> "([^"]*)"', v))])}
    SELECT note_id, i AS ord, quote, row_number() OVER (PARTITION BY note_id, quote ORDER BY i) > 1 AS again FROM (SELECT note_id, i::INTEGER AS i, trim(quote) AS quote FROM x)""")
def ag_8_repeated_quotes(spark, sf_dir):
    found = quotes.anchors(made(spark, sf_dir, ANCHORED, "note_id string, value string"))
    return found.select("note_id", "ord", "quote", (F.expr("row_number() over (partition by note_id, quote order by ord)") > 1).alias("again"))


# --- links ----------------------------------------------------------------------------------------------------------

MARKDOWN = "---\na: §\n---\n# dp head\ndp `dp` [[dp]] https://x/dp $dp$ and DP\n```\ndp\n```\n[dp](u) $$x\ny$$ 尾"


@query(listed("note_id string, nth int, kind string, chunk string", [("m", *r) for r in [
    (0, "frontmatter", "---\na: §\n---\n# dp head"), (1, "text", "\ndp "), (2, "inlinecode", "`dp`"), (3, "text", " "), (4, "wikilink", "[[dp]]"), (5, "text", " "), (6, "url", "https://x/dp"), (7, "text", " "), (8, "mathinline", "$dp$"),
    (9, "text", " and DP\n"), (10, "codeblock", "```\ndp\n```"), (11, "text", "\n"), (12, "mdlink", "[dp](u)"), (13, "text", " "), (14, "math", "$$x\ny$$"), (15, "text", " 尾"),
]]))
def lk_1_protected(spark, sf_dir):
    """The head and the heading touch: one span, of the longer's kind."""
    split = F.udf(lambda t: links.pieces(t), "array<struct<kind: string, chunk: string>>")
    rows = made(spark, sf_dir, [("m", MARKDOWN)], "note_id string, value string").select("note_id", F.posexplode(split("value")).alias("nth", "p"))
    return rows.select("note_id", "nth", "p.kind", "p.chunk")


VAULT = [("algo/dp.md", "---\ntitle: 动态规划\n---\n"), ("algo/tree.md", "---\naliases: [树, 树形, forest]\n---\n"), ("a/same.md", ""), ("b/same.md", ""), ("图.md", "")]
TERMS = [
    (0, "dp", "term", None), (1, "动态规划", "term", None), (2, "树形", "concept", None), (3, "same", "term", None), (4, "recursion", "concept", None), (5, "递归", "algorithm", None), (6, "forest", "term", "algo/tree.md"),
    (7, "lost", "concept", "nowhere.md"), (8, "the", "concept", None), (9, "plain", "term", None), (10, "图", "term", "图"), (11, "图论", "concept", None), (12, "C++", "concept", None),
]
TERM_SCHEMA = "ord int, term string, type string, target string"
LINKED = [
    ("one.md", "§ dp 与 动态规划，dp 和 树形\r\n`树形` 递归 recursion"), ("algo/dp.md", "dp 和 forest，图 论"), ("two.md", ""), ("three.md", "same lost plain 图论 [[dp]]\n# dp\n"), ("four.md", "---\nx: 1\n---\n"),
]
_ALL = "\n\n## 🔗 关联概念\n\n{}\n"
_CLASH = "\n\n## ⚠️ 知识消歧提示\n\n- **same**：知识库中存在多个同名节点（`a/same`、`b/same`），已跳过正文强链（可通过 LLM 术语表指定 `target`）\n"


def _footer(*terms):
    return _ALL.format("\n".join(f"- [[{x}]]" for x in terms))


LINK_ROWS = [
    ("one.md", "§ [[algo/dp|dp]] 与 [[algo/dp|动态规划]]，dp 和 [[algo/tree|树形]]\n`树形` 递归 recursion" + _footer("C++", "lost", "recursion", "图论", "递归") + _CLASH, "动态规划|dp|树形", 3, 0, 5, 8, "lost>nowhere.md", "same", ""),
    ("algo/dp.md", "dp 和 [[algo/tree|forest]]，图 论" + _footer("C++", "lost", "recursion", "图论", "递归") + _CLASH, "forest", 1, 0, 5, 10, "lost>nowhere.md", "same", "动态规划>algo/dp|dp>algo/dp"),
    ("two.md", _footer("C++", "lost", "recursion", "图论", "递归"), "", 0, 0, 5, 11, "", "", ""),
    ("three.md", "same lost plain 图论 [[dp]]\n# dp\n" + _footer("C++", "lost", "recursion", "图论", "递归") + _CLASH, "", 0, 0, 5, 11, "lost>nowhere.md", "same", ""),
    ("four.md", "---\nx: 1\n---\n" + _footer("C++", "lost", "recursion", "图论", "递归"), "", 0, 0, 5, 11, "", "", ""),
]
LINK_SCHEMA = "note_id string, value string, linked string, n_strong bigint, n_weak bigint, n_footer bigint, skipped_not_in_text bigint, invalid_targets string, ambiguous string, selfish string"


def _linked(spark, sf_dir, weak_links: str) -> DataFrame:
    entries = vault.note_entries(spark.createDataFrame(VAULT, "rel string, value string"))
    plan = links.link_plan(spark.createDataFrame(TERMS, TERM_SCHEMA), vault.name_index(entries), entries, weak_links)
    out = links.inject(made(spark, sf_dir, LINKED, "note_id string, value string"), plan, weak_links)
    pairs = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["term"], F.lit(">"), x["target"])), "|")
    return out.withColumns({"linked": joined("linked"), "invalid_targets": pairs("invalid_targets"), "ambiguous": F.array_join(F.transform("ambiguous_terms", lambda x: x["term"]), "|"), "selfish": pairs("skipped_self_links")})


@query(listed(LINK_SCHEMA, LINK_ROWS))
def lk_2_to_6_inject(spark, sf_dir):
    """Longest terms first, first free places, ambiguity, a missing target, self links, footers; C++ has no word bound and 'the' is a stop word, 图 too short."""
    return _linked(spark, sf_dir, "footer").select(*[c.split()[0] for c in LINK_SCHEMA.split(", ")])


BODY_ROWS = [
    ("one.md", "§ [[algo/dp|dp]] 与 [[algo/dp|动态规划]]，dp 和 [[algo/tree|树形]]\n`树形` [[递归]] [[recursion]]" + _CLASH, "recursion|动态规划|dp|树形|递归", 3, 2, 0), ("algo/dp.md", "dp 和 [[algo/tree|forest]]，图 论" + _CLASH, "forest", 1, 0, 0),
    ("two.md", "", "", 0, 0, 0), ("three.md", "same lost plain [[图论]] [[dp]]\n# dp\n" + _CLASH, "图论", 0, 1, 0), ("four.md", "---\nx: 1\n---\n", "", 0, 0, 0),
]


@query(listed("note_id string, value string, linked string, n_strong bigint, n_weak bigint, n_footer bigint", BODY_ROWS))
def lk_3_weak_links_in_the_text(spark, sf_dir):
    return _linked(spark, sf_dir, "body").select("note_id", "value", "linked", "n_strong", "n_weak", "n_footer")


@query(listed("note_id string, terms_input bigint, skipped_invalid bigint, skipped_not_in_text bigint, footers boolean", [(n, 13, 2, 11 - k, False) for (n, *_), k in zip(LINKED, (3, 1, 0, 0, 0))]))
def ag_6_link_audit(spark, sf_dir):
    out = _linked(spark, sf_dir, "none")
    return out.select("note_id", "terms_input", "skipped_invalid", "skipped_not_in_text", F.contains("value", F.lit("## ")).alias("footers"))


@case(listed_alone("ord int, term string, kind string, target string, candidates string, in_footer boolean", [
    (0, "dp", "strong", "algo/dp", None, False), (1, "动态规划", "strong", "algo/dp", None, False), (2, "树形", "strong", "algo/tree", None, False), (3, "same", "ambiguous", None, "a/same|b/same", False), (4, "recursion", "concept", "recursion", None, True),
    (5, "递归", "concept", "递归", None, True), (6, "forest", "strong", "algo/tree.md", None, False), (7, "lost", "bad_target", "nowhere.md", None, True), (8, "the", "invalid", "the", None, False), (9, "plain", "none", None, None, False),
    (10, "图", "invalid", "图", None, False), (11, "图论", "concept", "图论", None, True), (12, "C++", "concept", "C++", None, True),
]))
def lk_2_link_plan(spark, sf_dir):
    entries = vault.note_entries(spark.createDataFrame(VAULT, "rel string, value string"))
    plan = links.link_plan(spark.createDataFrame(TERMS, TERM_SCHEMA), vault.name_index(entries), entries)
    return plan.select("ord", "term", "kind", "target", joined("candidates").alias("candidates"), "in_footer")


STATES = [("a.md", 1.0, 5), ("b.md", 1.0, 5), ("c.md", 2.0, 5), ("e.md", 1.0, 6)]
BEFORE = [("a.md", 1.0, 5), ("b.md", 1.5, 5), ("d.md", 1.0, 5), ("e.md", 1.0, 5)]


@query(f"""WITH {values("n", "rel string, mtime double, size bigint", STATES)}, {values("o", "rel string, mtime double, size bigint", BEFORE)}
    SELECT count(*) FILTER (n.rel IS NOT NULL AND o.mtime = n.mtime AND o.size = n.size) AS reused, count(*) FILTER (n.rel IS NOT NULL AND (o.rel IS NULL OR o.mtime <> n.mtime OR o.size <> n.size)) AS parsed, count(*) FILTER (n.rel IS NULL) AS removed FROM n FULL JOIN o ON n.rel = o.rel""")
def ag_5_scan_counts(spark, sf_dir):
    schema = "rel string, mtime double, size bigint"
    return vault.scan_counts(vault.scan_plan(made(spark, sf_dir, STATES, schema), made(spark, sf_dir, BEFORE, schema)))


# --- the gate -------------------------------------------------------------------------------------------------------

GOOD = "---\ntitle: x\n---\n🎯 **全篇通关目标**\n[05:20] [🎥 原片]\n## 模块一\n🎯 学完你能\n[[dp]] [[nope|x]] [[nope#h]] [[树]]\n```python\nx\n```\nO(N log N)\n## 闭环自测\n### 1. a\n### 2. b\n题 3：c\n<details>1. x</details>\n<details>y</details>\n参考答案\n## 尾\n4. no\n"
GATED = [
    ("good", GOOD + "§\n"), ("fence", GOOD + "```\n"), ("math", GOOD + "$$ x\n"), ("bare", GOOD.replace("title", "t").replace("---\n", "", 1)), ("nested", GOOD + "[[a [[b]] c]]\n"), ("chart", GOOD + "```mermaid\ngraph TD\n```\n```mermaid\npie\n```\n"),
    ("few", GOOD.replace("### 2. b\n题 3：c\n", "")), ("answers", GOOD.replace("<details>y</details>\n参考答案\n", "")), ("no recall", GOOD.replace("闭环自测", "闭环主动自测")), ("no goal", GOOD.replace("🎯 **全篇通关目标**", "").replace("🎯 学完你能", "")),
    ("no time", GOOD.replace("[05:20] [🎥 原片]", "")), ("no cost", GOOD.replace("O(N log N)", "")), ("quote", GOOD + _anchor("完全没有说过的一句话而已")),
]
FEATURES = "note_id string, fences bigint, mermaid_count bigint, mermaid_bad bigint, nested_links boolean, has_goal boolean, module_goals bigint, modules bigint, has_recall boolean, questions bigint, answers bigint"


def _features(note, fences=2, charts=0, bad=0, nested=False, goal=True, module_goals=1, recall=True, questions=3, answers=3):
    return note, fences, charts, bad, nested, goal, module_goals, 1, recall, questions, answers


@query(listed(FEATURES, [
    _features("good"), _features("fence", fences=3), _features("math"), _features("bare"), _features("nested", nested=True), _features("chart", fences=6, charts=2, bad=1), _features("few", questions=1), _features("answers", answers=1),
    _features("no recall", recall=False, questions=0, answers=0), _features("no goal", goal=False, module_goals=0), _features("no time"), _features("no cost"), _features("quote"),
]))
def gate_3_to_6_features(spark, sf_dir):
    """Charts, nested links, goals, and questions and answers of the self-test section."""
    return gate.features(made(spark, sf_dir, GATED, "note_id string, value string")).select(*[c.split()[0] for c in FEATURES.split(", ")])


VERDICTS = "note_id string, passed boolean, format bigint, teaching bigint, trace bigint, code bigint, wikilink bigint, anchor bigint, dangling bigint, wikilinks bigint, errors string, warnings string"


def _verdict(note, passed=True, format=100, teaching=100, trace=100, code=100, wikilink=83, anchor=100, dangling=1, wikilinks=4, errors="", warnings="dangling_links"):
    return note, passed, format, teaching, trace, code, wikilink, anchor, dangling, wikilinks, errors, warnings


@query(listed(VERDICTS, [
    _verdict("good"), _verdict("fence", False, format=60, code=0, errors="open_fence"), _verdict("math", False, format=60, errors="open_math"), _verdict("bare", False, errors="no_frontmatter"),
    _verdict("nested", False, format=60, wikilink=75, dangling=2, wikilinks=5, errors="nested_links"), _verdict("chart", warnings="mermaid_type|dangling_links"), _verdict("few", teaching=85, warnings="few_questions|dangling_links"),
    _verdict("answers", teaching=85, warnings="few_answers|dangling_links"), _verdict("no recall", teaching=75, warnings="no_recall|dangling_links"), _verdict("no goal", teaching=60, warnings="no_goal|module_goals|dangling_links"),
    _verdict("no time", trace=20, warnings="no_time_anchor|no_provenance|dangling_links"), _verdict("no cost", code=80, warnings="no_complexity|dangling_links"), _verdict("quote", False, anchor=0, errors="unsupported"),
]))
def gate_13_and_ag_9_verdicts(spark, sf_dir):
    """The whole gate with a collection and archives: links of which one target is unknown, and a quotation nobody said."""
    entries = vault.note_entries(spark.createDataFrame(VAULT, "rel string, value string"))
    archives = made(spark, sf_dir, [("quote", "[00:05 --> 00:12] 那么递归呢它要有出口")], "archive_id string, value string")
    out = gate.validate(made(spark, sf_dir, GATED, "note_id string, value string"), entries, archives)
    hundred = [F.round(F.col(c) * 100).cast("long").alias(c) for c, _ in gate.WEIGHTS]
    return out.select("note_id", "passed", *hundred, "dangling", "wikilinks", joined("errors").alias("errors"), joined("warnings").alias("warnings"))


@query(listed("note_id string, head string", [("good", "¤/good: passed (98/100)"), ("fence", "¤/fence: failed (75/100)")]))
def snk_6_reports(spark, sf_dir):
    entries = vault.note_entries(spark.createDataFrame(VAULT, "rel string, value string"))
    out = gate.reports(gate.validate(made(spark, sf_dir, GATED[:2], "note_id string, value string"), entries))
    return out.select("note_id", F.substring_index("text", "\n", 1).alias("head"))


AUDITS = [
    ("whole", '{"video_id":"v","candidates":[{"quote":"q","kept":true,"reason":{"irreplaceable":"x","non_derivable":"y","memorable":"z"}},{"kept":false,"reason_failed":"r"}],"final_anchors":["q"]}'),
    ("half", '{"video_id":"v","candidates":[{"quote":"q","kept":true,"reason":{"irreplaceable":"x"}},{"kept":false}],"final_anchors":1}'), ("empty", "{}"),
]


@query(listed("audit_id string, issues string", [("whole", ""), ("half", "reason:non_derivable|reason:memorable|reason_failed"), ("empty", "missing:video_id|missing:candidates|missing:final_anchors")]))
def gate_11_audits(spark, sf_dir):
    return gate.check_audits(made(spark, sf_dir, AUDITS, "audit_id string, value string")).select("audit_id", joined("issues").alias("issues"))


def _template(*found):
    made = [{"quote": x, "timestamp": f"{a}-{b}", "up_name": n, "kind": "analogy", "kept": True, "reason": gate.TEMPLATE_REASONS} for x, a, b, n in found]
    return json.dumps({"video_id": "v", "source_title": "课", "candidates": made, "final_anchors": [x for x, *_ in found]}, ensure_ascii=False, separators=(",", ":"))


@query(listed("note_id string, value string", [("two", _template(("一句§", "00:10", "00:20", "老师"), ("二句", "01:00", "1:02:03", "师"))), ("none", _template())]))
def gate_12_templates(spark, sf_dir):
    rows = [("two", _anchor(" 一句§ ") + _anchor("二句", name="师 ", a="01:00", b="1:02:03")), ("none", "> x")]
    return gate.audit_templates(made(spark, sf_dir, rows, "note_id string, value string"), "v", "课")


KEYS = [("v", "base", 600), ("w", "base", 600), ("v", "large", None)]


@query(f"WITH {values('k', 'video_id string, model string, len int', KEYS)} SELECT video_id, model, substring(sha1(video_id || '|' || model || '|' || coalesce(len::VARCHAR, 'None')), 1, 16) AS run_key FROM k")
def st_3_run_keys(spark, sf_dir):
    """A key a video and all that affects its results."""
    rows = made(spark, sf_dir, KEYS, "video_id string, model string, len int")
    return rows.select("video_id", "model", clock.run_key(F.col("video_id"), F.col("model"), F.col("len")).alias("run_key"))
