"""The quality gate: deterministic rules, scores and a verdict for every note at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import newlines
from .quotes import anchors, with_anchor_codes
from .vault import dangling, targets_of

#: Patterns of the rules, weights and bound of the score, fixed values.
SECTION = r"(?is)(?:##(?U:\s+)[^\n]*?(?:闭环自测|自测练习|Active Recall|Post-test)[^\n]*?\n)(.*?)(?=\n##(?U:\s+)|\z)"
QUESTION = r"(?U)(?:^|\n)\s*(?:#{1,6}\s*)?(?:\d+[.、]|\bQ\d+[:：]|题\s*\d+[:：]|第\s*[一二三四五\d]+\s*题[:：])\s*[^\n]+"
ANSWER = r"(?i)(?:> \[!(?:TIP|NOTE|SUCCESS|QUESTION|EXAMPLE|INFO)\]-?|<details>|<!--(?U:\s*)details(?U:\s*)-->|参考答案|答案[:：])"
PROVENANCE = r"(?U)(\[🎥\s*原片\]|\[📎\s*补充推导\]|\[⚠️\s*教学解释\]|🎥\s*来源(?:原片)?|>\s*🎥\s*来源)"
WEIGHTS = (("format", 0.20), ("teaching", 0.20), ("trace", 0.20), ("code", 0.15), ("wikilink", 0.15), ("anchor", 0.10))
PASS_SCORE = 0.70
FRONT_MATTER, FENCE, MATH = r"(?s)\A---\r?\n.*?\r?\n---\r?\n", r"(?m)^(?U:\s*)```", r"\$\$"
CHART, CHART_TYPE = r"(?s)```mermaid(?U:\s*)\n(.*?)\n```", r"(?U)\b(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram)\b"
NESTED = (r"\[\[[^\]]*\[\[", r"\]\][^\[]*\]\]")
GOAL, MODULE_GOAL, MODULE = r"(?U)🎯\s*\*\*全篇通关目标\*\*", r"(?U)🎯\s*学完你能", r"(?mU)^##\s+模块"
TIME_ANCHOR = r"(\[\d{1,2}:\d{2}(?::\d{2})?[^\]]*\]|[?&]t=\d+)"
COMPLEXITY = r"(时间复杂度|空间复杂度|O\([0-9A-Za-z\s\^*+\-\\,.]*\))"
CODE_BLOCK = r"(?s)```(?:c|cpp|python|java|go|rust)(?U:\s*)\n.*?\n```"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def features(notes: DataFrame) -> DataFrame:
    """(note_id, value, …): counts and flags of each rule, of notes (note_id, value)."""
    rows = notes.select("note_id", newlines(F.col("value")).alias("value")).withColumn("section", F.regexp_extract("value", SECTION, 1))
    v = F.col("value")
    asked = F.regexp_replace(F.regexp_replace("section", r"(?s)```.*?```|`[^`\n]+`", ""), r"(?is)<details(?:(?U:\s+)[^>]*)?>.*?</details>", "")
    charts = F.regexp_extract_all(v, F.lit(CHART), 1)
    return rows.withColumns({
        "has_frontmatter": v.rlike(FRONT_MATTER),
        "fences": _count(v, FENCE),
        "math_marks": _count(v, MATH),
        "mermaid_count": F.size(charts).cast("long"),
        "mermaid_bad": F.size(F.filter(charts, lambda c: ~c.rlike(CHART_TYPE))).cast("long"),
        "nested_links": v.rlike(NESTED[0]) | v.rlike(NESTED[1]),
        "has_goal": v.rlike(GOAL),
        "module_goals": _count(v, MODULE_GOAL),
        "modules": _count(v, MODULE),
        "has_recall": v.rlike(SECTION),
        "questions": _count(asked, QUESTION),
        "answers": _count(F.col("section"), ANSWER),
        "has_time_anchor": v.rlike(TIME_ANCHOR),
        "provenance_tags": _count(v, PROVENANCE),
        "has_complexity": v.rlike(COMPLEXITY),
        "code_blocks": _count(v, CODE_BLOCK),
    }).drop("section")


def validate(notes: DataFrame, entries: DataFrame | None = None, archives: DataFrame | None = None) -> DataFrame:
    """A row for each of notes (note_id, value): passed, overall (unrounded), six scores, error and warning codes, counts.

    Scores look at error codes, never at messages. Links are checked where ``entries`` of a collection are given,
    quotations where ``archives`` have a row for the note; without either, a note is judged in its row and nothing is joined.
    """
    rows = with_anchor_codes(features(notes), archives)
    targets = targets_of(F.col("value"))
    rows = rows.withColumns({"wikilinks": F.size(targets).cast("long"), "targets": F.size(F.array_distinct(targets)).cast("long")})
    if entries is None:
        rows = rows.withColumn("dangling", F.lit(0).cast("long"))
    else:
        lost = dangling(rows, entries).groupBy("note_id").agg(F.count_distinct("target").alias("dangling"))
        rows = rows.join(lost, "note_id", "left")
    rows = rows.na.fill(0, ["dangling"])
    no_complexity = (F.col("code_blocks") > 0) & ~F.col("has_complexity")
    weak_recall = F.col("has_recall") & ((F.col("questions") < 3) | (F.col("answers") < F.col("questions")))
    errors = F.array_compact(F.array(F.when(~F.col("has_frontmatter"), "no_frontmatter"), F.when(F.col("fences") % 2 != 0, "open_fence"), F.when(F.col("math_marks") % 2 != 0, "open_math"), F.when(F.col("nested_links"), "nested_links")))
    warnings = F.array_compact(F.array(
        F.when(F.col("mermaid_bad") > 0, "mermaid_type"), F.when(~F.col("has_goal"), "no_goal"),
        F.when((F.col("modules") > 0) & (F.col("module_goals") < F.col("modules")), "module_goals"),
        F.when(~F.col("has_recall"), "no_recall"), F.when(F.col("has_recall") & (F.col("questions") < 3), "few_questions"),
        F.when(F.col("has_recall") & (F.col("answers") < F.col("questions")), "few_answers"),
        F.when(~F.col("has_time_anchor"), "no_time_anchor"), F.when(F.col("provenance_tags") == 0, "no_provenance"),
        F.when(no_complexity, "no_complexity"), F.when(F.col("dangling") > 0, "dangling_links"),
    ))

    def minus(condition: Column, points: float) -> Column:
        return F.when(condition, points).otherwise(0.0)

    broken = F.size(F.filter(errors, lambda e: e.isin("open_fence", "open_math", "nested_links")))
    teaching = 1.0 - minus(~F.col("has_goal"), 0.2) - minus(~F.col("has_recall"), 0.25) - minus(weak_recall, 0.15) - minus((F.col("modules") > 0) & (F.col("module_goals") == 0), 0.2)
    rows = rows.withColumns({
        "errors": F.concat(errors, F.col("anchor_errors")),
        "warnings": F.concat(warnings, F.col("anchor_warnings")),
        "format": F.greatest(F.lit(0.0), 1.0 - broken * 0.4),
        "teaching": F.greatest(F.lit(0.0), teaching),
        "trace": 1.0 - minus(~F.col("has_time_anchor"), 0.5) - minus(F.col("provenance_tags") == 0, 0.3),
        "code": F.when(F.col("fences") % 2 != 0, 0.0).when(no_complexity, 0.8).otherwise(1.0),
        "wikilink": F.greatest(F.lit(0.0), 1.0 - F.col("dangling") / F.greatest(F.lit(1), F.col("targets")) * 0.5),
        "anchor": F.when(F.size("anchor_errors") == 0, 1.0).otherwise(0.0),
    })
    overall = sum((F.col(name) * weight for name, weight in WEIGHTS[1:]), F.col(WEIGHTS[0][0]) * WEIGHTS[0][1])
    rows = rows.withColumn("overall", overall).withColumn("passed", (F.size("errors") == 0) & (F.round(overall, 6) >= PASS_SCORE - 0.005))
    return rows.select("note_id", "passed", "overall", *[n for n, _ in WEIGHTS], "errors", "warnings", "code_blocks", "mermaid_count", "provenance_tags", "has_time_anchor", "questions", "answers", "wikilinks", "dangling", "anchor_count")


def reports(results: DataFrame) -> DataFrame:
    """(note_id, json, text): a report of each row of :func:`validate`, as one JSON line and as lines to read. Write it with any text or JSON sink."""

    def listed(column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"\n{column} ("), F.size(column).cast("string"), F.lit("):\n  - "), F.array_join(column, "\n  - "))).otherwise("")

    scores = [F.concat(F.lit(f"{n} "), F.format_string("%.0f%%", F.col(n) * 100)) for n, _ in WEIGHTS]
    head = F.concat(F.coalesce("note_id", F.lit("")), F.when(F.col("passed"), ": passed (").otherwise(": failed ("), F.format_string("%.0f/100", F.col("overall") * 100), F.lit(")\n"))
    data = F.to_json(F.struct("note_id", "passed", "overall", F.struct(*[n for n, _ in WEIGHTS]).alias("scores"), "errors", "warnings"))
    return results.select("note_id", data.alias("json"), F.concat(head, F.concat_ws(" | ", *scores), listed("errors"), listed("warnings")).alias("text"))


def exit_code(results: DataFrame) -> int:
    """0 if every note passed, 1 if one failed, 2 if there is no note. One aggregate row comes to the driver."""
    row = results.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("passed")).alias("ok")).first()
    return 2 if not row["n"] else int(row["ok"] < row["n"])


AUDIT_SCHEMA = "video_id string, candidates array<struct<quote:string,timestamp:string,kept:boolean,reason:struct<irreplaceable:string,non_derivable:string,memorable:string>,reason_failed:string>>, final_anchors string"


def check_audits(audits: DataFrame) -> DataFrame:
    """(audit_id, issues) of audits (audit_id, value): missing keys, kept candidates without each of three reasons, dropped ones without the reason why."""
    rows = audits.withColumn("a", F.from_json("value", AUDIT_SCHEMA))

    def blank(x):
        return F.coalesce(x == "", F.lit(True))

    keys = F.array_compact(F.array(*[F.when(F.col(f"a.{k}").isNull(), f"missing:{k}") for k in ("video_id", "candidates", "final_anchors")]))
    reasons = F.transform(F.col("a.candidates"), lambda c: F.when(F.coalesce(c["kept"], F.lit(False)), F.array_compact(F.array(*[F.when(blank(c["reason"][d]), f"reason:{d}") for d in ("irreplaceable", "non_derivable", "memorable")]))).otherwise(F.array_compact(F.array(F.when(blank(c["reason_failed"]), "reason_failed")))))
    return rows.select("audit_id", F.concat(keys, F.coalesce(F.flatten(reasons), F.array().cast("array<string>"))).alias("issues"))


#: Reasons that a template gives until someone writes better ones, fixed texts.
TEMPLATE_REASONS = {
    "irreplaceable": "名师独家比喻，改写为抽象术语后损失记忆抓手",
    "non_derivable": "直觉心智模型，正文严密推导尚未涵盖该通俗生活实体",
    "memorable": "形象直观，一周后仍可作为快速唤醒词",
}


def audit_templates(notes: DataFrame, video_id: str = "BV_TODO", source_title: str = "TODO") -> DataFrame:
    """(note_id, value): a JSON audit for each of notes (note_id, value) that keeps every complete anchor, in order. The time it was made is left to the sink."""
    reasons = F.struct(*[F.lit(text).alias(name) for name, text in TEMPLATE_REASONS.items()])
    candidate = F.struct("quote", F.concat("ts_start", F.lit("-"), "ts_end").alias("timestamp"), "up_name", F.lit("analogy").alias("kind"), F.lit(True).alias("kept"), reasons.alias("reason"))
    listed = anchors(notes).groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("ord", candidate.alias("c")))).alias("a"))
    rows = notes.select("note_id").join(listed, "note_id", "left")
    found = F.coalesce(F.transform("a", lambda x: x["c"]), F.array())
    record = F.struct(F.lit(video_id).alias("video_id"), F.lit(source_title).alias("source_title"), found.alias("candidates"), F.transform(found, lambda c: c["quote"]).alias("final_anchors"))
    return rows.select("note_id", F.to_json(record).alias("value"))
