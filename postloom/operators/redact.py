"""Replacing contacts, numbers, dates and people in one pass, and finding what was left."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from postloom.functions import text as tx
from postloom.operators import identity
from postloom.operators.dates import numeric_date

#: Kinds of spans, in the order in which they are tried at one place.
SPANS = (
    ("EMAIL", r"[A-Za-z0-9_.+'-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"),
    ("URL", r"https?://[^\s]+|www\.[^\s]+"),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("PHONE", r"(?:\([0-9]{3}\) ?|\b[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}\b"),
    ("DATE", r"\b[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})\b"),
    ("NUMBER", r"[0-9]{7,}"),
)
ANY_SPAN = "|".join(f"(?:{p})" for _, p in SPANS)
#: Fixed value: a date written month, day, year with one separator.
NUMERIC_DATE = r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b|\b[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}\b"
PLACEHOLDER = r"\[(?:COMPANY|ORG_\d+|LOC_\d+|UNIT_\d+)\]"


def _kind(span: Column) -> Column:
    out = None
    for kind, pattern in SPANS:
        found = span.rlike(f"^(?:{pattern})$")
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out


def redact_contacts(c: Column, only: tuple[str, ...] | None = None) -> Column:
    """The text with typed placeholders for its spans, replaced in one pass: text put in is never matched again. Null stays null."""
    if only is not None:
        out = c
        wanted = [(k, p) for k, p in SPANS if k in only]
        if len(wanted) == 1:
            return F.regexp_replace(out, wanted[0][1], f"[{wanted[0][0]}]")
    shown = lambda s: tx.once(_kind(s), lambda k: F.when(k.isin(*only), F.concat(F.lit("["), k, F.lit("]"))).otherwise(s) if only is not None else F.concat(F.lit("["), k, F.lit("]")))
    return tx.rewrite_spans(c, ANY_SPAN, shown)


def span_counts(c: Column) -> Column:
    """How many spans of each kind the text has, as a map without zeros."""
    kinds = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ANY_SPAN), F.lit(0)), _kind)
    return tx.once(kinds, lambda found: F.map_filter(F.create_map(*(x for kind, _ in SPANS for x in (F.lit(kind), F.size(F.filter(found, tx.equals(kind)))))), lambda _, n: n > 0))


def shift_numeric_dates(c: Column, days: Column, years: tuple[int, int] = (1990, 2035)) -> Column:
    """Moves dates written m/d/y or m-d-y by ``days``; years outside the gate and days that aren't on the calendar stay, two digits stay two digits. Null or zero days move nothing."""
    return F.when(F.coalesce(days, F.lit(0)) == 0, c).otherwise(tx.rewrite_spans(c, NUMERIC_DATE, lambda s: numeric_date(s, days, years)))


def _forms(p: Column) -> Column:
    """(alias, replacement) of a person (name, first, last, email, address): all forms in which a name may stand, the first one of an alias counts.

    Full names, "Last, First", surnames of four letters and more, given names of three and more, each as written, in capitals and (names with a
    surname) in lower case; and the address.
    """

    def forms(words: Column) -> Column:
        first, last = F.get(words, F.lit(0)), F.when(F.size(words) > 1, F.element_at(words, -1))
        form = lambda alias, out, low: F.struct(alias.alias("alias"), out.alias("replacement"), F.lit(low).alias("low"))
        listed = F.array(
            form(F.concat_ws(" ", first, last), F.concat_ws(" ", p["first"], p["last"]), True),
            form(F.concat(last, F.lit(", "), first), F.concat_ws(", ", p["last"], p["first"]), False),
            form(F.when(F.length(last) >= 4, last), p["last"], True),
            form(F.when(F.length(first) >= 3, first), p["first"], False),
            form(p["address"], p["email"], False),
        )
        case = lambda x, f: F.struct(f(x["alias"]).alias("alias"), f(x["replacement"]).alias("replacement"))
        return F.flatten(F.transform(F.filter(listed, lambda x: F.length(x["alias"]) > 1), lambda x: F.array_compact(F.array(case(x, lambda c: c), case(x, F.upper), F.when(x["low"], case(x, F.lower))))))

    return tx.once(F.split(identity.clean_name(p["name"]), " "), forms)


def rewrite_names(docs: DataFrame, people: DataFrame) -> DataFrame:
    """(doc, text, rewritten, n_replaced): ``docs(doc, text)`` with all forms of the names of their ``people(doc, name, first, last, email, address)`` replaced in one pass, longest first.

    The people of a message are gathered beside it, their number is bounded by the message; the forms are made there, so they are never shuffled.
    Replacing is one split of the text at an alternation of the forms.
    """
    person = F.struct("name", "first", "last", "email", "address")
    lists = people.filter("name is not null").groupBy("doc").agg(F.array_sort(F.collect_set(person)).alias("people"))
    formed = docs.select("doc", "text").join(lists, "doc", "left").withColumn("forms", F.flatten(F.transform("people", _forms))).drop("people")
    longest = F.array_sort(F.array_distinct(F.transform("forms", lambda f: f["alias"])), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.array_join(F.transform(longest, lambda a: F.concat(F.lit("\\Q"), a, F.lit("\\E"))), "|")
    pattern = F.when(F.size("forms") > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])")))
    found = formed.withColumn("pattern", pattern).withColumn("spans", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    out = F.array_join(F.zip_with(F.split("text", F.col("pattern")), "spans", lambda plain, x: F.concat(F.coalesce(plain, F.lit("")), F.coalesce(F.get(F.filter("forms", lambda f: f["alias"] == x), F.lit(0))["replacement"], F.lit("")))), "")
    none = F.col("pattern").isNull() | (F.coalesce(F.size("spans"), F.lit(0)) <= 0)
    return found.select("doc", "text", F.when(none, F.col("text")).otherwise(out).alias("rewritten"), F.when(none, 0).otherwise(F.size("spans")).alias("n_replaced"))


def leaks(text: Column, terms: Column) -> Column:
    """The terms, sorted, that stand in the text bounded by what is no letter or digit; case is ignored. The cheap substring test goes first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda t: F.contains(low, t) & F.rlike(low, F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])")))
    return F.array_sort(F.filter(F.array_distinct(F.transform(F.filter(terms, lambda t: t.isNotNull() & (t != "")), F.lower)), hit))


def force_redact(text: Column, terms: Column) -> Column:
    """The text with every remaining term replaced, longest first, case ignored."""
    ordered = F.array_sort(F.array_distinct(F.filter(terms, lambda t: t.isNotNull() & (t != ""))), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(ordered, text, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?i)(?<![a-z0-9])\Q"), x, F.lit(r"\E(?![a-z0-9])")), "[REDACTED]"))


def name_hits(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, name): full names of ``names(name)`` ("first last", lower case) in ``docs(doc, text)``.

    Texts are cut into pairs of neighbouring words and joined on them, so no text meets all names.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))
    once = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, i: F.concat_ws(" ", F.get(w, i), x))
    pairs = docs.select("doc", F.explode(F.array_distinct(F.get(F.transform(F.array(words), once), F.lit(0)))).alias("name"))
    return pairs.join(names.select("name").distinct(), "name").select("doc", "name")


#: Quoted-printable codes of characters that break words.
_CODES = {"20": " ", "09": " ", "3D": "=", "92": "'", "93": '"', "94": '"', "96": "-"}


def repair_quoted_printable(c: Column) -> Column:
    """Without quoted-printable codes and soft line ends, where there are at least two codes or a broken one ("= =")."""
    code = r"=[0-9A-F]{2}"
    table = F.create_map(*(F.lit(x) for pair in _CODES.items() for x in pair))
    shown = lambda s: tx.once(F.upper(F.right(s, F.lit(2))), lambda k: F.coalesce(F.try_element_at(table, k), s))
    joined = F.regexp_replace(F.regexp_replace(c, r"=[ \t]*=(?=[0-9A-Fa-f]{2})", "="), r"=\r?\n", "")
    blank = F.regexp_replace(joined, r"(?:=(?:20|09)\s*)+", " ")
    return F.when((F.regexp_count(c, F.lit(code)) >= 2) | F.contains(c, F.lit("= =")), tx.rewrite_spans(blank, "=[0-9A-Fa-f]{2}", shown)).otherwise(c)


def clean_artifacts(c: Column, internal_domain: str | None = None) -> Column:
    """Without encoded addresses in brackets, directory-style addresses, a system's name behind an address, and quoted-printable codes. Addresses in mailto marks stay as such unless they are internal."""
    s = repair_quoted_printable(c)
    if internal_domain is not None:
        s = F.regexp_replace(s, rf"(?i)\s*\[mailto:[^\]]*{re.escape(internal_domain)}[^\]]*\]", "")
    s = F.regexp_replace(s, r"(?i)\[?mailto:([^\]\s>]+)\]?", "$1")
    s = F.regexp_replace(s, r"IMCEA[A-Z]+-[^\s\]>]+", "")
    s = F.regexp_replace(s, r"([\w.+-]+@[\w-]+(?:\.[\w-]+)+)@[A-Za-z]+\b(?!\.)", "$1")
    return F.regexp_replace(s, r"(<[^<>\s]+@[^<>\s]+>)@[A-Za-z]+\b(?!\.)", "$1")
