"""Text functions of matching and linking."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon
from .dialect import fold, strip


def normalize_tokens(text: Column, homophones=lexicon.HOMOPHONES, fillers=lexicon.FILLERS) -> Column:
    """Lower case, ordered replacements, letters and digits only, fillers out in order, repeated characters once."""
    s = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), homophones, F.lower(text))
    s = F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")
    s = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), fillers, s)
    return F.regexp_replace(s, r"(?s)(.)\1+", "$1")


def bigrams(text: Column) -> Column:
    """The set of pairs of neighbouring characters of the folded text."""
    # The characters are bound as a lambda's variable, so that they are folded and split once, not for every pair.
    pairs = F.transform(F.array(characters(fold(text))), lambda c: F.array_distinct(F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.concat(a, b))))
    return F.get(pairs, F.lit(0))


def characters(text: Column) -> Column:
    """Code points as an array."""
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def is_valid_term(term: Column, stopwords=lexicon.STOPWORDS) -> Column:
    """2 to 40 characters, no stop word, made of words of letters, digits, '_-./+' with white space between."""
    one = r"[\p{L}\p{N}_\-./+]+"
    return F.coalesce(F.length(term).between(2, 40) & ~term.isin(*stopwords) & ~F.lower(term).isin(*stopwords) & strip(term).rlike(rf"\A{one}(?:(?U:\s+){one})*\z"), F.lit(False))


def term_position(text: Column, term: Column) -> Column:
    """1-based place of the first hit of a term: ASCII terms as whole words in any case, others not next to [A-Za-z0-9_]."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    ascii_only = term.rlike(r"\A\p{ASCII}*\z")
    found = F.when(ascii_only, F.concat(F.lit(r"(?iU)\b"), quoted, F.lit(r"\b"))).otherwise(F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])")))
    return F.regexp_instr(text, found)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """All named and numeric entities, which have no JVM function."""
    return text.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.DoubleType())
def py_round2(x: pd.Series) -> pd.Series:
    """Two decimals, correctly rounded on the binary value, which neither round nor bround gives."""
    return x.map(lambda v: None if pd.isna(v) else round(v, 2))
