"""Regular expressions and text primitives with one meaning on the JVM: Unicode letters and digits, white space, newlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHAR = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def fold(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def starts_within(words) -> str:
    """A lookahead for the range of the words' first characters: one comparison spares the alternatives at most places."""
    first = [ord(w[0]) for w in words]
    return rf"(?=[\x{{{min(first):x}}}-\x{{{max(first):x}}}])"


def contains_any(text: Column, words) -> Column:
    """Whether any of the literal words is a substring."""
    return text.rlike(starts_within(words) + "(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")")


def word_pattern(words, ignore_case: bool = True) -> str:
    """A pattern of whole words, bounded by characters that are no letter, digit or underscore of any script."""
    flags, guard = "iU" if ignore_case else "U", ""
    if all(w[0].isascii() and w[0].isalpha() for w in words):
        # Cheap and implied by what follows; the last four fold to s, k and i where case is ignored.
        letters = "".join(sorted({c for w in words for c in (w[0].lower(), w[0].upper())}))
        guard = rf"(?-iU:(?=[{letters}\x{{17f}}\x{{212a}}\x{{130}}\x{{131}}])(?<![A-Za-z0-9_]))"
    return rf"(?{flags}){guard}\b({'|'.join(words)})\b"


def ratio_text(numerator: Column, denominator: Column) -> Column:
    """'x.x%' of integer parts, half to even on the exact quotient."""
    tenths = numerator.cast("decimal(38,0)") * 1000 / F.greatest(denominator, F.lit(1)).cast("decimal(38,0)")
    return F.concat(F.format_string("%.1f", (F.bround(tenths, 0) / 10).cast("double")), F.lit("%"))
