"""Condensation of transcripts: noise out, idle runs folded, evidence kept, with statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.clock import fmt_ts, strip_timestamps
from ..functions.dialect import ratio_text, starts_within, strip
from ..storage import checkpointed
from .folds import drop_repeated_heads
from .signals import has_code, has_formula, has_tech_word, has_trap, is_noise
from .substrings import within

SENTENCE = r"([^，。！？；…\n]+)([，。！？；…\n]*)"


def tidy(sentence: Column) -> Column:
    """Repeated fillers and punctuation once, the last one of each run."""
    once = F.regexp_replace(sentence, rf"{starts_within(lexicon.REPEATED)}({'|'.join(lexicon.REPEATED)}){{2,}}", "$1")
    return F.regexp_replace(once, "([，。！？；]){2,}", "$1")


def sentences(segments: DataFrame) -> DataFrame:
    """(video_id, seq, start, sub, text, code, tech, trap, noise): each segment's sub-sentences with their flags."""
    parts = F.transform(F.arrays_zip(F.regexp_extract_all("body", F.lit(SENTENCE), 1).alias("a"), F.regexp_extract_all("body", F.lit(SENTENCE), 2).alias("b")), lambda p: F.when(p["a"].rlike(r"(?U)\S"), F.concat(strip(p["a"]), p["b"])))
    rows = segments.withColumn("body", strip(F.coalesce("text", F.lit("")))).select("video_id", "seq", "start", F.posexplode(F.filter(parts, lambda p: p.isNotNull())).alias("sub", "raw"))
    rows = rows.select("video_id", "seq", "start", "sub", tidy(strip(F.col("raw"))).alias("text")).where("text <> ''")
    rows = rows.withColumns({"code": has_code(F.col("text")), "trap": has_trap(F.col("text")), "word": has_tech_word(F.col("text")), "chat": is_noise(F.col("text"))})
    return rows.select("video_id", "seq", "start", "sub", "text", "code", (F.col("code") | F.col("word")).alias("tech"), "trap", (F.col("chat") & ~F.col("code") & ~F.col("trap")).alias("noise"))


def traps(parsed: DataFrame) -> DataFrame:
    return parsed.where("trap").select("video_id", "seq", "sub", fmt_ts(F.col("start")).alias("time"), F.col("start").alias("sec"), "text")


def clean_lines(parsed: DataFrame) -> DataFrame:
    """(video_id, seq, start, text, tech, trap, n_traps): sub-sentences joined again without noise; empty lines vanish, none of them with a trap."""
    kept = F.transform(F.array_sort(F.collect_list(F.when(~F.col("noise"), F.struct("sub", "text")))), lambda x: x["text"])
    rows = parsed.groupBy("video_id", "seq", "start").agg(strip(F.array_join(kept, "")).alias("text"), F.bool_or("tech").alias("tech"), F.bool_or("trap").alias("trap"), F.count_if("trap").alias("n_traps"))
    return rows.where("text <> ''")


def fold_idle(lines: DataFrame, seconds: float = 90, least: int = 3) -> DataFrame:
    """(video_id, seq, kind, t_from, t_to, n_lines, text, n_traps): maximal runs without signal of ``seconds`` and ``least`` lines become one row of kind fold."""
    by = W.partitionBy("video_id").orderBy("seq")
    signal = F.col("tech") | F.col("trap")
    rows = lines.withColumns({"signal": signal, "island": F.sum(signal.cast("int")).over(by)})
    run = W.partitionBy("video_id", "island", "signal")
    rows = rows.withColumns({"n_lines": F.count(F.lit(1)).over(run), "t_from": F.min("start").over(run), "t_to": F.max("start").over(run), "head": F.min("seq").over(run)})
    idle = ~F.col("signal") & (F.col("t_to") - F.col("t_from") >= seconds) & (F.col("n_lines") >= least)
    rows = rows.withColumn("idle", idle).where(~F.col("idle") | (F.col("seq") == F.col("head")))
    return rows.select(
        "video_id",
        "seq",
        F.when(F.col("idle"), "fold").otherwise("line").alias("kind"),
        F.when(F.col("idle"), F.col("t_from")).otherwise(F.col("start")).alias("t_from"),
        F.when(F.col("idle"), F.col("t_to")).otherwise(F.col("start")).alias("t_to"),
        F.when(F.col("idle"), F.col("n_lines")).otherwise(1).cast("long").alias("n_lines"),
        F.when(~F.col("idle"), F.col("text")).alias("text"),
        "n_traps",
    )


def condense(segments: DataFrame, captions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments (video_id, seq, start, text) to (condensed rows, trap rows, statistics a video). Select chunks before, never after: folds see their neighbours."""
    kept = checkpointed(drop_repeated_heads(segments)) if captions else segments  # read twice, folded once
    # One exchange, before the parsing: lines, runs and statistics are all within a video and need no other.
    parsed = sentences(kept.repartition("video_id"))
    rows, found = fold_idle(clean_lines(parsed)), traps(parsed)
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    raw = segments.groupBy("video_id").agg(F.sum(n).alias("raw_chars"))
    clean = rows.groupBy("video_id").agg(F.sum(F.coalesce(n, F.lit(0))).alias("clean_chars"), F.count_if(F.col("kind") == "fold").alias("folds"), F.sum("n_traps").alias("traps_count"))
    if captions:
        raw = raw.join(kept.groupBy("video_id").agg(F.sum(n).alias("dedup_chars")), "video_id", "left")
    else:
        raw = raw.withColumn("dedup_chars", F.col("raw_chars"))
    stats = raw.join(clean, "video_id", "left").na.fill(0)
    stats = stats.withColumns({"dedup_removed": F.col("raw_chars") - F.col("dedup_chars"), "compression_ratio": ratio_text(F.greatest(F.lit(0), F.col("raw_chars") - F.col("clean_chars")), F.col("raw_chars"))})
    return rows, found, stats


def condense_selected(segments: DataFrame, ids: list[int] | None, chunk_len: float, captions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``condense`` of the segments that start in chosen chunks (None: all). The choice lies below: runs and repeated heads see only what was chosen, so the result is no part of the whole one's."""
    return condense(segments if ids is None else segments.where(F.floor(F.col("start") / chunk_len).isin(*ids) if ids else F.lit(False)), captions)


def evidence_stats(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(video_id, orig_chars, evidence_chars, evidence_reduction) of condensed rows and their evidence: characters without stamps, and the share that went."""
    n = F.sum(F.length(F.replace(strip_timestamps(F.col("text")), F.lit("\n"), F.lit("")))).alias("n")
    before = rows.where("kind = 'line'").groupBy("video_id").agg(n).withColumnRenamed("n", "orig_chars")
    after = kept.groupBy("video_id").agg(n).withColumnRenamed("n", "evidence_chars")
    out = before.join(after, "video_id", "left").na.fill(0)
    return out.withColumn("evidence_reduction", ratio_text(F.greatest(F.lit(0), F.col("orig_chars") - F.col("evidence_chars")), F.col("orig_chars")))


def render(rows: DataFrame) -> DataFrame:
    """Condensed rows as lines; only a sink needs them."""
    fold = F.concat(F.lit("["), fmt_ts(F.col("t_from")), F.lit(" - "), fmt_ts(F.col("t_to")), F.lit(" 闲聊互动/休息闲谈，已自动折叠]"))
    return rows.select("video_id", "seq", F.when(F.col("kind") == "fold", fold).otherwise(F.concat(F.lit("["), fmt_ts(F.col("t_from")), F.lit("] "), F.col("text"))).alias("line"))


def evidence(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Condensed lines with a technical word, code, a formula or a trap, or whose text is, or is in, a trap's sentence. Flags see the line as rendered."""
    lines = rows.where("kind = 'line'").select("video_id", "seq", "t_from", "text").withColumn("line", F.concat(F.lit("["), fmt_ts(F.col("t_from")), F.lit("] "), F.col("text")))
    flagged = has_tech_word(F.col("line")) | has_code(F.col("line")) | has_formula(F.col("line")) | has_trap(F.col("line"))
    # Written once, as lines are asked, counted and returned; numbers stay with their rows.
    lines = checkpointed(lines.select("video_id", "seq", "t_from", "text", flagged.alias("flagged"), F.monotonically_increasing_id().alias("id")))
    inside = within(lines.where(~F.col("flagged")), found, ["video_id"])
    kept = lines.where("flagged").unionByName(lines.where(~F.col("flagged")).join(inside, "id", "left_semi").select(*lines.columns))
    return kept.select("video_id", "seq", "t_from", "text")
