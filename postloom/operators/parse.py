"""RFC-822 text into records, in the JVM; an exact mode uses the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postloom.functions import mail

_FIELDS = ("message_id", "date", "from_addr", "to_addrs", "cc_addrs", "bcc_addrs", "subject", "x_from", "x_to", "x_folder", "x_origin")
_SCHEMA = "file string, message_id string, date string, from_addr string, to_addrs array<string>, cc_addrs array<string>, bcc_addrs array<string>, subject string, x_from string, x_to string, x_folder string, x_origin string, raw_body string"


def header(head: Column, name: str) -> Column:
    """A header's value in a head whose folded lines are joined; empty where it is missing."""
    return F.btrim(F.regexp_extract(head, rf"(?dim)^{name}:([^\n]*)", 1), F.lit(" \t"))


def address_list(value: Column) -> Column:
    """Addresses of a list in lower case, without display names."""
    return F.transform(F.regexp_extract_all(F.lower(value), F.lit(r"([^\s<>,;\"()]+@[^\s<>,;\"()]+)"), F.lit(1)), F.btrim)


def iso_date(value: Column) -> Column:
    """An RFC-2822 date as ISO wall clock with offset; null if it can't be read or is no date of the calendar."""
    pattern = r"^(?:\w{3},?\s+)?(\d{1,2})\s+(\w{3})\s+(\d{4})\s+(\d{2}:\d{2}(?::\d{2})?)\s+([+-]\d{2})(\d{2})(?:\s*\(.*\))?\s*$"
    part = lambda k: F.regexp_extract(value, pattern, k)
    clock = F.when(F.length(part(4)) == 5, F.concat(part(4), F.lit(":00"))).otherwise(part(4))
    local = F.try_to_timestamp(F.concat_ws(" ", part(1), part(2), part(3), clock), F.lit("d MMM yyyy HH:mm:ss"))
    return F.when(value.rlike(pattern) & local.isNotNull(), F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), part(5), F.lit(":"), part(6)))


def parse_messages(raw: DataFrame) -> DataFrame:
    """One record for each row of ``raw(file, message)``; missing headers are empty, missing lists are empty lists, unreadable dates are null.

    Line ends are made one kind; the head ends at the first blank line. A null message gives empty fields.
    """
    unified = raw.select("file", F.regexp_replace(F.coalesce("message", F.lit("")), r"\r\n?", "\n").alias("m"))
    parts = unified.select("file", F.split("m", "\n\n", 2).alias("p")).select("file", F.regexp_replace(F.get("p", F.lit(0)), r"\n[ \t]+", " ").alias("head"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("raw_body"))
    head = F.col("head")
    return parts.select(
        "file",
        header(head, "Message-ID").alias("message_id"),
        iso_date(header(head, "Date")).alias("date"),
        F.coalesce(F.get(address_list(header(head, "From")), F.lit(0)), F.lit("")).alias("from_addr"),
        address_list(header(head, "To")).alias("to_addrs"),
        address_list(header(head, "Cc")).alias("cc_addrs"),
        address_list(header(head, "Bcc")).alias("bcc_addrs"),
        header(head, "Subject").alias("subject"),
        header(head, "X-From").alias("x_from"),
        header(head, "X-To").alias("x_to"),
        header(head, "X-Folder").alias("x_folder"),
        header(head, "X-Origin").alias("x_origin"),
        mail.split_trailer(F.col("raw_body")).alias("body"),
        mail.split_trailer(F.col("raw_body"), "trailer").alias("trailer"),
        "raw_body",
    )


def parse_exact(raw: DataFrame) -> DataFrame:
    """As ``parse_messages`` with the standard library's full address grammar and MIME rules, in Arrow batches. Multipart messages have an empty body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import message_from_string
        from email.utils import getaddresses, parsedate_to_datetime

        def one(file: str, text: str | None) -> tuple:
            m = message_from_string(text or "")
            get = lambda k: " ".join((m.get(k) or "").split())
            people = lambda k: [a.lower() for _, a in getaddresses([get(k)]) if a]
            try:
                date = parsedate_to_datetime(get("Date")).isoformat() if m.get("Date") else None
            except (TypeError, ValueError):
                date = None
            body = "" if m.is_multipart() else m.get_payload()
            return file, get("Message-ID"), date, (people("From") or [""])[0], people("To"), people("Cc"), people("Bcc"), get("Subject"), get("X-From"), get("X-To"), get("X-Folder"), get("X-Origin"), body.replace("\r\n", "\n").replace("\r", "\n")

        for df in batches:
            yield pd.DataFrame([one(f, t) for f, t in zip(df["file"], df["message"])], columns=["file", *_FIELDS, "raw_body"])

    parsed = raw.select("file", "message").mapInPandas(run, _SCHEMA)
    return parsed.withColumn("body", mail.split_trailer(F.col("raw_body"))).withColumn("trailer", mail.split_trailer(F.col("raw_body"), "trailer"))


def render(df: DataFrame, names: bool = False) -> DataFrame:
    """RFC-822-like text of parsed messages; lines of empty fields are left out. With ``names`` the sender's display name stands before the address."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    addresses = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    sender = F.when(F.coalesce("x_from", F.lit("")) != "", F.concat("x_from", F.lit(" <"), "from_addr", F.lit(">"))).otherwise(F.col("from_addr")) if names else F.col("from_addr")
    head = F.concat_ws("\n", line("From", sender), line("To", addresses("to_addrs")), line("Cc", addresses("cc_addrs")), line("Subject", F.col("subject")), line("Date", F.col("date")))
    rest = F.concat_ws("\n\n", F.nullif(F.col("body"), F.lit("")), F.nullif(F.col("trailer"), F.lit("")))
    return df.select("email_id", F.concat(head, F.lit("\n\n"), rest).alias("text"))


def tagged(c: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>; null without them."""
    pattern = rf"(?s)<{tag}>\n?(.*?)\n?</{tag}>"
    return F.when(c.rlike(pattern), F.btrim(F.regexp_extract(c, pattern, 1), F.lit("\n")))


def json_object(c: Column, schema: str) -> Column:
    """The text from the first brace to the last one as a record; fields that can't be read are null."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})
