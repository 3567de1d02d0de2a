"""Expressions over mail fields: addresses, subjects, paths and wall-clock dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns that define the features, in Java's form ((?U) gives \\s, \\w, \\d and \\b their Unicode meaning, (?d) makes only \\n end a line).
EMAIL = r"(?U)[\w.+'-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?U)\(?\b\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"
MONEY = r"(?Ui)\$\s?\d[\d,]*(?:\.\d+)?\s?(?:million|billion|mm|k|m|b)?"
URL = r"(?Ui)https?://\S+|www\.\S+"
ATTACHMENT = r"(?Ui)\b(attach(?:ed|ment)|\.xls|\.doc|\.pdf|\.ppt)\b"
GREETING = r"(?Ui)^\s*(hi|hello|dear|hey|all|team|good (morning|afternoon))\b"
SIGNOFF = r"(?Uidm)(thanks|thank you|regards|best|sincerely|cheers)[,!.]?\s*$"
TRAILER_MARKS = (
    r"(?Uidm)^\s*-{2,}\s*Original Message\s*-{2,}\s*$",
    r"(?Uidm)^\s*-{5,}\s*Forwarded by .*$",
    r"(?Uidm)^\s*-{2,}\s*Forwarded (?:message|by).*$",
    r"(?Udm)^\s*_{5,}\s*$",
    r"(?Udm)^\s*On .{5,80} wrote:\s*$",
    r"(?Udm)^\s*>+ ",
)


def folder_type(file: Column) -> Column:
    """Second segment of the path in lower case; 'unknown' where there is none."""
    return F.coalesce(F.nullif(F.get(F.split(F.lower(file), "/"), F.lit(1)), F.lit("")), F.lit("unknown"))


def owner(file: Column) -> Column:
    return F.get(F.split(file, "/"), F.lit(0))


def domain(address: Column) -> Column:
    """What follows the last @; empty without one."""
    return F.when(F.contains(address, F.lit("@")), F.substring_index(address, "@", -1)).otherwise(F.lit(""))


def base_subject(subject: Column) -> Column:
    """Without leading reply and forward marks, trimmed, in lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^\s*((re|fw|fwd)\s*:\s*)+", ""), F.lit(" \t\r\n")))


def wall_clock(date: Column) -> Column:
    """Local time of an ISO date with offset, as written; the instant is ``F.try_to_timestamp(date)``."""
    return F.try_to_timestamp(F.left(date, F.lit(19)))


def split_trailer(text: Column, keep: str = "body") -> Column:
    """The part before the first mark of quoted history, without white space at its end, or (``keep='trailer'``) the rest without line feeds around it."""
    at = F.least(*(F.nullif(F.regexp_instr(text, F.lit(mark)), F.lit(0)) for mark in TRAILER_MARKS))
    cut = F.coalesce(at, F.length(text) + 1)
    if keep == "body":
        return F.regexp_replace(F.substr(text, F.lit(1), cut - 1), r"(?U)\s+$", "")
    return F.btrim(F.substr(text, cut, F.length(text)), F.lit("\n"))


def is_external(address: Column, internal: str) -> Column:
    return ~F.endswith(F.lower(address), F.lit("@" + internal.lower()))
