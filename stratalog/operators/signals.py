"""Lexical signals of a text: keywords, density, and code, formula, warning flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.dialect import contains_any, starts_within, word_pattern


def has_tech_word(text: Column, cn=lexicon.TECH_CN, en=lexicon.TECH_EN) -> Column:
    return contains_any(text, cn) | text.rlike(word_pattern(en))


def has_trap(text: Column, cn=lexicon.TRAP_CN, en=lexicon.TRAP_EN) -> Column:
    return contains_any(text, cn) | text.rlike(word_pattern(en))


def has_code(text: Column) -> Column:
    """Case counts: an identifier before an opening bracket or comparison, an operator, a final semicolon, or a code word."""
    return text.rlike(lexicon.CODE_MARKS) | text.rlike(word_pattern(lexicon.CODE_WORDS, ignore_case=False))


def has_formula(text: Column) -> Column:
    return text.rlike(lexicon.FORMULA_MARKS)


def is_noise(text: Column) -> Column:
    """Small talk: a pattern on the first line of the text."""
    parts = "|".join(lexicon.NOISE)
    return text.rlike(rf"(?d)\A.*{starts_within(parts.split('|'))}(?:{parts})")


def tech_hits(text: Column, cn=lexicon.TECH_CN, en=lexicon.TECH_EN) -> Column:
    """Each listed substring once, in the list's order, then every whole-word hit in the text's order."""
    listed = F.filter(F.lit(list(cn)), lambda k: F.contains(text, k))
    return F.concat(listed, F.transform(F.regexp_extract_all(text, F.lit(word_pattern(en)), 1), lambda k: F.lower(k)))


def analyze(text: Column, hints: Column | None = None) -> Column:
    """A struct of keywords (5), topic_hints, density parts and flags. Empty text: no signal but the hints it got.

    density is min(1, n_hits / max(1, n_chars / 80)), kept unrounded beside its integer parts.
    """
    text = F.coalesce(text, F.lit(""))
    hits = tech_hits(text)
    own = F.slice(F.array_distinct(hits), 1, 3)
    hints = F.array().cast("array<string>") if hints is None else F.coalesce(hints, F.array().cast("array<string>"))
    return F.struct(
        F.slice(F.array_distinct(hits), 1, 5).alias("keywords"),
        F.when(F.size(hints) > 0, hints).otherwise(own).alias("topic_hints"),
        F.size(hits).cast("long").alias("n_hits"),
        F.length(text).cast("long").alias("n_chars"),
        F.least(F.lit(1.0), F.size(hits) / F.greatest(F.lit(1.0), F.length(text) / F.lit(80.0))).alias("density"),
        has_code(text).alias("has_code"),
        has_formula(text).alias("has_formula"),
        has_trap(text).alias("has_warning"),
    )
