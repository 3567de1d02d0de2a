"""Pieces of the SQL that checks queries."""

from __future__ import annotations

import re

_BLANKS = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASSES = {"s": _BLANKS, "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", "d": r"\p{Nd}"}


def re2(pattern: str) -> str:
    """A pattern in Java's form for RE2, as an SQL literal."""
    m = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    flags, rest = (m[1], pattern[m.end() :]) if m else ("", pattern)
    if "U" in flags:
        out, inside, i = [], False, 0
        while i < len(rest):
            c = rest[i]
            if c == "\\" and rest[i + 1].lower() in _CLASSES:
                body = _CLASSES[rest[i + 1].lower()]
                negative = rest[i + 1].isupper()
                out.append(body if inside else f"[{'^' * negative}{body}]")
                i += 2
                continue
            if c == "\\":
                out.append(rest[i : i + 2])
                i += 2
                continue
            inside = c == "[" or (inside and c != "]")
            out.append(c)
            i += 1
        rest = "".join(out)
    kept = "".join(f for f in flags if f in "ims")
    return "'" + (f"(?{kept})" if kept else "") + rest.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {re2(r'(?U)^\s+')}, ''), {re2(r'(?U)\s+$')}, '')"


def words(x: str) -> str:
    """Word count of a text that isn't null."""
    return f"len(regexp_extract_all({x}, {re2(r'(?U)\S+')}))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {re2(pattern)}))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {re2(pattern)})"


def folder_type(x: str = "file") -> str:
    return f"coalesce(nullif(split_part(lower({x}), '/', 2), ''), 'unknown')"


def base_subject(x: str = "subject") -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '(?i)^\\s*((re|fw|fwd)\\s*:\\s*)+', ''), E' \\t\\r\\n'))"
