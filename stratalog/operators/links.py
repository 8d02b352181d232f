"""Idempotent link injection: protected spans, resolution by joins, rewriting a note at a time with one automaton for all terms."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import is_valid_term
from .vault import known_targets

#: Kinds of protected spans, fixed patterns.
PROTECTED = (
    ("frontmatter", re.compile(r"\A---\r?\n.*?\r?\n---\r?\n", re.DOTALL)),
    ("codeblock", re.compile(r"```[^\r\n]*\r?\n.*?```", re.DOTALL)),
    ("inlinecode", re.compile(r"`[^`\r\n]+`")),
    ("wikilink", re.compile(r"\[\[[^\]\r\n]+\]\]")),
    ("mdlink", re.compile(r"\[[^\]\r\n]+\]\([^\)\r\n]+\)")),
    ("url", re.compile(r"https?://\S+")),
    ("math", re.compile(r"\$\$.*?\$\$", re.DOTALL)),
    ("mathinline", re.compile(r"\$[^$\r\n]+\$")),
    ("heading", re.compile(r"^#{1,6}\s+[^\r\n]+$", re.MULTILINE)),
)
#: Bytes of terms, targets and candidates of a plan. Each note lists the plan's terms in its footers and audit, so a larger one has no use.
PLAN_BYTES = 16 << 20
#: Headings and sentences of the footers, fixed texts.
FOOTER, UNCLEAR = "\n\n## 🔗 关联概念\n\n", "\n\n## ⚠️ 知识消歧提示\n\n"
UNCLEAR_LINE = "- **{}**：知识库中存在多个同名节点（{}），已跳过正文强链（可通过 LLM 术语表指定 `target`）"


def protected_spans(text: str) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, kind) in order; spans that overlap or touch are one, of the kind of the longest.

    A sweep over the ends of all spans: an island lasts while any span is open, and openings at a place come before closings.
    """
    opened = [m.span() + (kind,) for kind, pattern in PROTECTED for m in pattern.finditer(text)]
    ends = sorted([(a, 0) for a, _, _ in opened] + [(b, 1) for _, b, _ in opened])
    islands, depth = [], 0
    for at, closes in ends:
        if not depth:
            islands.append([at, at])
        depth += -1 if closes else 1
        islands[-1][1] = at
    starts = [a for a, _ in islands]
    longest: dict[int, tuple[int, int, str]] = {}
    for a, b, kind in opened:
        i = bisect_right(starts, a) - 1
        longest[i] = max(longest.get(i, (0, 0, "")), (b - a, -a, kind), key=lambda x: x[:2])
    return [(a, b, longest[i][2]) for i, (a, b) in enumerate(islands)]


def pieces(text: str) -> list[tuple[str, str]]:
    """(kind, chunk) whose chunks join to the text; kind 'text' is free for links."""
    out, at = [], 0
    for start, end, kind in protected_spans(text):
        out += [("text", text[at:start]), (kind, text[start:end])]
        at = end
    return [p for p in [*out, ("text", text[at:])] if p[1]]


def _folded(text: str) -> str:
    """The text in lower case, a character for a character; letters that a search without case takes for i and s are those."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    return low if low.isascii() else low.translate({0x131: "i", 0x17F: "s"})


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _stands(text: str, lo: int, hi: int, start: int, end: int, ascii_term: bool) -> bool:
    """Whether a hit is bounded within text[lo:hi]: ASCII terms by word bounds, others by no neighbour of [A-Za-z0-9_]."""
    before = text[start - 1] if start > lo else ""
    after = text[end] if end < hi else ""
    if ascii_term:
        return (bool(before) and _is_word(before)) != _is_word(text[start]) and (bool(after) and _is_word(after)) != _is_word(text[end - 1])
    return not any(c.isascii() and _is_word(c) for c in (before, after) if c)


class Finder:
    """Places of many terms in a text by one pass of an automaton."""

    def __init__(self, terms: Iterable[str]):
        import ahocorasick

        self.automaton, self.known = ahocorasick.Automaton(), 0
        by: dict[str, list[str]] = {}
        for term in dict.fromkeys(terms):
            if term:
                by.setdefault(_folded(term), []).append(term)
        for folded, own in by.items():
            self.automaton.add_word(folded, (len(folded), own))
            self.known += 1
        if self.known:
            self.automaton.make_automaton()

    def places(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Of each term, where it stands, in order, whatever is around; the case of terms beyond ASCII counts."""
        out: dict[str, list[tuple[int, int]]] = {}
        if self.known and text:
            for last, (n, own) in self.automaton.iter(_folded(text)):
                start, end = last + 1 - n, last + 1
                for term in own:
                    if term.isascii() or text[start:end] == term:
                        out.setdefault(term, []).append((start, end))
        return out


def _chosen(text: str, plan: list[dict], finder: Finder) -> list[tuple[int, int, dict]]:
    """(start, end, step) of the links, in the order in which they are made: of each term its first free place.

    What is protected or linked bounds the pieces that are searched, so a term beside a link stands at a piece's end.
    """
    found = finder.places(text)
    taken = [(a, b) for a, b, _ in protected_spans(text)] if found else []
    out, linked = [], set()
    for step in plan:
        term = step["term"]
        if term in linked:
            continue
        for start, end in found.get(term, ()):
            i = bisect_right(taken, (start, len(text) + 1))
            lo = taken[i - 1][1] if i else 0
            hi = taken[i][0] if i < len(taken) else len(text)
            if lo <= start and end <= hi and _stands(text, lo, hi, start, end, term.isascii()):
                insort(taken, (start, end))
                linked.add(term)
                out.append((start, end, step))
                break
    return out


def _written(text: str, links: list[tuple[int, int, dict]]) -> str:
    out, at = [], 0
    for start, end, step in sorted(links, key=lambda x: x[0]):
        target, shown = step["target"].removesuffix(".md"), text[start:end]
        out += [text[at:start], f"[[{shown}]]" if target == shown and "/" not in target else f"[[{target}|{shown}]]"]
        at = end
    return "".join([*out, text[at:]])


def link_text(text: str, plan: list[dict], finder: Finder | None = None) -> tuple[str, list[str]]:
    """The text with the first free hit of each planned (term, target) as a link, in the plan's order, and the terms linked. What a link takes isn't searched again."""
    links = _chosen(text, plan, finder or Finder(step["term"] for step in plan))
    return _written(text, links), [step["term"] for _, _, step in links]


def note_stem(path: Column) -> Column:
    """The last part of a path or target, '\\' or '/' between parts, without '.md' at its end."""
    return F.regexp_replace(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), r"\.md\z", "")


def link_plan(terms: DataFrame, names: DataFrame, entries: DataFrame, weak_links: str = "footer") -> DataFrame:
    """(ord, term, kind, target, candidates, stem, in_footer): what each of terms (ord, term, type, target) becomes.

    kind is invalid, strong, weak, bad_target, ambiguous, concept (for the footer) or none. An explicit target has to
    name a note; else one note by the term's name makes a strong link, several an ambiguity; concepts make weak links in
    the text only with ``weak_links='body'``. stem is the target's name without its path; in_footer says that the term is
    a valid concept that names no note, which the footer lists where the text has no link of it.
    """
    asked = terms.where("target is not null and target <> ''").select("target").distinct()
    known = known_targets(asked, entries).select(F.col("target").alias("asked"), F.lit(True).alias("exists"))
    rows = terms.join(known, F.col("target") == F.col("asked"), "left").join(names.select(F.col("name"), "candidates"), F.col("term") == F.col("name"), "left")
    explicit, concept, n = F.coalesce(F.col("target") != "", F.lit(False)), F.coalesce(F.col("type").isin(*lexicon.CONCEPT_TYPES), F.lit(False)), F.size("candidates")
    valid = is_valid_term(F.col("term"))
    kind = (
        F.when(~valid, "invalid")
        .when(explicit & F.col("exists"), "strong")
        .when(explicit, "bad_target")
        .when(n == 1, "strong")
        .when(n > 1, "ambiguous")
        .when(concept, "weak" if weak_links == "body" else "concept")
        .otherwise("none")
    )
    target = F.when(explicit, F.col("target")).when(n == 1, F.element_at("candidates", 1)).when(concept & (kind != "ambiguous"), F.col("term"))
    return rows.select("ord", "term", kind.alias("kind"), target.alias("target"), F.when(kind == "ambiguous", F.col("candidates")).alias("candidates"), note_stem(target).alias("stem"), (valid & concept & F.col("name").isNull()).alias("in_footer"))


_PAIRS = pa.list_(pa.struct([("term", pa.string()), ("target", pa.string())]))
_UNCLEAR = pa.list_(pa.struct([("term", pa.string()), ("candidates", pa.list_(pa.string()))]))
_RESULT = (
    ("value", pa.string(), "string"), ("linked", pa.list_(pa.string()), "array<string>"), ("n_strong", pa.int64(), "bigint"), ("n_weak", pa.int64(), "bigint"),
    ("n_footer", pa.int64(), "bigint"), ("terms_input", pa.int64(), "bigint"), ("skipped_invalid", pa.int64(), "bigint"), ("skipped_not_in_text", pa.int64(), "bigint"),
    ("invalid_targets", _PAIRS, "array<struct<term: string, target: string>>"), ("ambiguous_terms", _UNCLEAR, "array<struct<term: string, candidates: array<string>>>"),
    ("skipped_self_links", _PAIRS, "array<struct<term: string, target: string>>"),
)


def _once(rows: Iterable[dict]) -> list[dict]:
    return list({repr(r): r for r in rows}.values())


def linked_note(text: str, own: str, steps: list[dict], finder: Finder, weak_links: str) -> dict:
    """The row of one note: its text with links and footers, and what became of the plan's terms."""
    free = any(kind == "text" for kind, _ in pieces(text))
    makes = [s for s in steps if s["kind"] in ("strong", "weak")]
    selfish = [s for s in makes if own in (s["stem"], s["term"], s["target"])]
    links = _chosen(text, [s for s in makes if own not in (s["stem"], s["term"], s["target"])], finder)
    linked = [s["term"] for _, _, s in links]
    value = _written(text, links)
    footer = sorted({s["term"] for s in steps if s["in_footer"] and s["term"] != own} - set(linked)) if weak_links == "footer" else []
    unclear = _once({"term": s["term"], "candidates": s["candidates"]} for s in steps if s["kind"] == "ambiguous") if free else []
    if footer:
        value += FOOTER + "\n".join(f"- [[{t}]]" for t in footer) + "\n"
    if unclear and weak_links != "none":
        value += UNCLEAR + "\n".join(UNCLEAR_LINE.format(u["term"], "、".join(f"`{c}`" for c in u["candidates"])) for u in unclear) + "\n"
    valid = sum(s["kind"] != "invalid" for s in steps)
    pairs = lambda some: _once({"term": s["term"], "target": s["target"]} for s in some) if free else []
    return {
        "value": value, "linked": linked, "n_strong": sum(s["kind"] == "strong" for _, _, s in links), "n_weak": sum(s["kind"] == "weak" for _, _, s in links), "n_footer": len(footer),
        "terms_input": len(steps), "skipped_invalid": len(steps) - valid, "skipped_not_in_text": valid - len(linked),
        "invalid_targets": pairs(s for s in steps if s["kind"] == "bad_target"), "ambiguous_terms": unclear, "skipped_self_links": pairs(selfish),
    }


def _steps(plan: DataFrame) -> list[dict]:
    """The plan's rows, longest terms first, after a check of their size."""
    size = F.coalesce(F.octet_length("term"), F.lit(0)) + F.coalesce(F.octet_length("target"), F.lit(0)) + F.coalesce(F.octet_length(F.array_join("candidates", " ")), F.lit(0))
    held = plan.agg(F.sum(size + F.lit(64))).first()[0] or 0
    if held > PLAN_BYTES:
        raise ValueError(f"a plan of {held} bytes: the terms of a plan are bounded by {PLAN_BYTES}")
    rows = plan.select("ord", "term", "kind", "target", "candidates", "stem", "in_footer").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: (-len(r["term"] or ""), r["ord"]))]


def inject(notes: DataFrame, plan: DataFrame, weak_links: str = "footer") -> DataFrame:
    """Of notes (note_id, value): note_id, value with links and footers, and the audit: terms linked, counts, and the terms that weren't, by reason.

    Longest terms come first, each linked at its first free place; a note's own name is never linked in it. Linking a
    linked note again changes nothing but its footer. A term that is listed twice with one outcome counts once in the
    lists of the audit, which are empty for a note without free text. The plan travels with the tasks, after a check of
    its size; an automaton over its terms is built once a task, so a note costs a pass over its text. A null value is empty.
    """
    spark = notes.sparkSession
    shared = spark.sparkContext.broadcast(_steps(plan))
    rows = notes.select("note_id", F.coalesce(F.replace("value", F.lit("\r\n"), F.lit("\n")), F.lit("")).alias("value"), note_stem(F.coalesce(F.col("note_id").cast("string"), F.lit(""))).alias("own"))

    def run(batches):
        steps = shared.value
        finder = Finder(s["term"] for s in steps if s["kind"] in ("strong", "weak"))
        for batch in batches:
            done = [linked_note(text, own, steps, finder, weak_links) for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[name] for d in done], kind) for name, kind, _ in _RESULT)], ["note_id", *(name for name, _, _ in _RESULT)])

    return rows.mapInArrow(run, ", ".join([f"note_id {rows.schema['note_id'].dataType.simpleString()}", *(f"{name} {kind}" for name, _, kind in _RESULT)]))


def first_mentions(notes: DataFrame, terms: DataFrame) -> DataFrame:
    """(note_id, ord, term, at): each term's first place, from 1, in notes (note_id, value), regardless of protected spans.

    ``terms`` (ord, term) travel with the tasks after a check of their size; of a term listed twice the first counts.
    """
    spark, none = notes.sparkSession, F.lit(None).cast("string")
    listed = _steps(terms.select("ord", "term", none.alias("kind"), none.alias("target"), F.array().cast("array<string>").alias("candidates"), none.alias("stem"), F.lit(False).alias("in_footer")))
    order: dict = {}
    for s in sorted(listed, key=lambda s: s["ord"]):
        order.setdefault(s["term"], s["ord"])
    shared = spark.sparkContext.broadcast(order)

    def run(batches):
        known = shared.value
        finder = Finder(known)
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for term, places in finder.places(text or "").items():
                    at = next((a for a, b in places if _stands(text, 0, len(text), a, b, term.isascii())), None)
                    if at is not None:
                        rows.append((k, known[term], term, at + 1))
            rows.sort(key=lambda r: (r[0], r[1]))
            owner = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([owner, *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int64())))], ["note_id", "ord", "term", "at"])

    rows = notes.select("note_id", "value")
    return rows.mapInArrow(run, f"note_id {rows.schema['note_id'].dataType.simpleString()}, ord bigint, term string, at bigint")
