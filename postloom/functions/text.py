"""String expressions that stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

BLANK = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(c, BLANK, " ")


def collapse_strip_lower(c: Column) -> Column:
    return F.lower(strip(collapse(c)))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null or blank text."""
    s = strip(c)
    return F.when(c.isNull() | (s == ""), F.lit(0)).otherwise(F.size(F.split(s, BLANK)))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9']+)"), F.lit(1))


def ngrams_all(words: Column, n: int) -> Column:
    """All n-grams with repeats, each joined by one blank; empty where there are fewer than n words.

    The words are bound once: an expression used inside a lambda would be evaluated anew for each place.
    """

    def grams(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), grams), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams."""
    return F.array_distinct(ngrams_all(words, n))


def line_count(c: Column) -> Column:
    """Line feeds plus 1; an empty text has one line."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def once(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated one time, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def equals(value):
    """A test for the functions that take one; the value is bound here, as default arguments of a lambda would count as its parameters."""
    return lambda x: x == value


def _bases() -> tuple[str, str]:
    """Letters that decompose into an ASCII letter and marks, and these letters."""
    found = [(chr(k), unicodedata.normalize("NFKD", chr(k))[0]) for k in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in found if a != b and b.isascii()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_MARKED, _PLAIN = _bases()


def ascii_fold(c: Column) -> Column:
    """Latin letters without their marks; what is no ASCII then is left out."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"[^\x00-\x7F]", "")


def rewrite_spans(c: Column, pattern: str | Column, f) -> Column:
    """The text with each match of ``pattern`` replaced by ``f(match)``, in one pass: text put in is never matched again.

    The text is split at the matches, and the pieces are joined again with what the matches become. Null stays null.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces = F.zip_with(F.split(c, p), F.regexp_extract_all(c, p, F.lit(0)), lambda plain, span: F.concat(F.coalesce(plain, F.lit("")), F.coalesce(f(span), F.lit(""))))
    return F.when(c == "", c).otherwise(F.array_join(pieces, ""))
