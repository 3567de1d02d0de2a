"""Features of messages and summaries of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postloom.functions import mail, text

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike(pattern)


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern))


def _starts(c: Column, *prefixes: str) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.lit(False)
    for p in prefixes:
        found = found | low.startswith(p)
    return found


def featurize(emails: DataFrame, internal_domain: str, company_term: str) -> DataFrame:
    """The 24 feature columns of each message, next to ``email_id``.

    Null texts and lists count as empty. Only columns that a feature needs are read; everything stays in the JVM.
    """
    body, trailer, raw, subject = (F.coalesce(c, F.lit("")) for c in ("body", "trailer", "raw_body", "subject"))
    return emails.select(
        "email_id",
        "file",
        mail.folder_type(F.col("file")).alias("folder_type"),
        mail.owner(F.col("file")).alias("owner"),
        "date",
        F.greatest(F.size(F.coalesce("to_addrs", F.array().cast("array<string>"))), F.lit(0)).alias("n_to"),
        F.greatest(F.size(F.coalesce("cc_addrs", F.array().cast("array<string>"))), F.lit(0)).alias("n_cc"),
        text.word_count(subject).alias("subject_len"),
        _starts(subject, "re:").alias("is_re"),
        _starts(subject, "fw:", "fwd:").alias("is_fw"),
        (subject == "").alias("empty_subject"),
        text.word_count(body).alias("body_words"),
        text.word_count(trailer).alias("trailer_words"),
        (trailer != "").alias("has_trailer"),
        text.line_count(body).alias("n_lines"),
        _count(raw, mail.EMAIL).alias("n_emails_in_text"),
        _count(raw, mail.PHONE).alias("n_phones"),
        _count(raw, mail.MONEY).alias("n_money"),
        _count(raw, mail.URL).alias("n_urls"),
        _has(body, mail.ATTACHMENT).alias("mentions_attachment"),
        _has(F.left(body, F.lit(60)), mail.GREETING).alias("has_greeting"),
        _has(F.right(body, F.lit(200)), mail.SIGNOFF).alias("has_signoff"),
        F.contains(F.lower(raw), F.lit(company_term.lower())).alias("mentions_company"),
        (~F.endswith(F.coalesce("from_addr", F.lit("")), F.lit("@" + internal_domain))).alias("external_sender"),
        F.length(raw).alias("raw_len"),
    )


def _rate(c: Column | str) -> Column:
    return F.round(F.avg(F.col(c).cast("int") if isinstance(c, str) else c.cast("int")), 6)


def quantiles(c: str, points: tuple[float, ...] = QUANTILES) -> list[Column]:
    """Exact quantiles with linear interpolation, one column for each. Map-side they are counts of distinct values, so their size is that of the values' range."""
    return [F.round(F.percentile(c, F.lit(p)), 6).alias(f"{c}_q{round(100 * p):02d}") for p in points]


def summarize(features: DataFrame, by: str | None = "folder_type") -> DataFrame:
    """Counts, rates and quantiles of the features, of each group or (``by=None``) of all rows."""
    aggregates = [
        F.count("*").alias("n"),
        F.count_distinct("owner").alias("n_owners"),
        F.round(F.avg("body_words"), 6).alias("mean_words"),
        *quantiles("body_words"),
        _rate(F.col("body_words") == 0).alias("empty_body_rate"),
        *(_rate(c).alias(f"{c}_rate") for c in ("has_trailer", "is_re", "is_fw", "empty_subject", "mentions_attachment", "has_greeting", "has_signoff", "mentions_company", "external_sender")),
        *(_rate(F.col(c) > 0).alias(f"{c}_rate") for c in ("n_emails_in_text", "n_phones", "n_money", "n_urls")),
        _rate(F.col("n_to") + F.col("n_cc") <= 1).alias("one_recipient_rate"),
    ]
    return features.groupBy(by).agg(*aggregates) if by else features.agg(*aggregates)


def structure(df: DataFrame, key: str, body: str = "body", trailer: str = "trailer", to: Column | None = None, cc: Column | None = None) -> DataFrame:
    """13 structural features for comparing a message with its rewritten form. Null texts and lists count as empty; ``to`` and ``cc`` are the numbers of recipients."""
    b = text.strip(F.coalesce(body, F.lit("")))
    t = F.coalesce(trailer, F.lit(""))
    return df.select(
        key,
        text.word_count(b).alias("body_words"),
        F.size(F.filter(F.split(b, "\n"), lambda x: x.rlike(r"(?U)\S"))).alias("n_lines"),
        F.size(F.filter(F.split(b, r"(?U)\n\s*\n"), lambda x: x.rlike(r"(?U)\S"))).alias("n_paragraphs"),
        _has(F.left(b, F.lit(60)), mail.GREETING).alias("has_greeting"),
        _has(F.right(b, F.lit(250)), r"(?Uid)(thanks|thank you|regards|best|sincerely|cheers)[,!.]?\s*(\n|$)").alias("has_signoff"),
        t.rlike(r"(?U)\S").alias("has_trailer"),
        ((F.lower(b) == b) & (F.length(b) > 20)).alias("all_lower"),
        _has(b, r"https?://|www\.").alias("has_url"),
        _has(b, r"(?Ui)\battach").alias("mentions_attachment"),
        _starts(F.col("subject"), "re:").alias("is_re"),
        _starts(F.col("subject"), "fw:", "fwd:").alias("is_fw"),
        (F.greatest(F.size("to_addrs"), F.lit(0)) if to is None else to).alias("n_to"),
        (F.greatest(F.size("cc_addrs"), F.lit(0)) if cc is None else cc).alias("n_cc"),
    )


def form_features(df: DataFrame, key: str, body: str = "body", quoted: str = "quoted") -> DataFrame:
    """21 numbers on length, layout, character classes and wrapping, without words. Null texts count as empty."""
    t = text.strip(F.coalesce(body, F.lit("")))
    based = df.select(key, t.alias("t"), F.coalesce(quoted, F.lit("")).alias("q"))
    t = F.col("t")
    lines = F.split(t, "\n")
    full = F.filter(lines, lambda x: x.rlike(r"(?U)\S"))
    lengths = F.sort_array(F.transform(full, F.length))
    based = based.withColumns({"n_all": F.size(lines), "ll": F.when(F.size(lengths) == 0, F.array(F.lit(0))).otherwise(lengths), "n_ne": F.size(full), "trailing": F.size(F.filter(lines, lambda x: x.endswith(" "))), "long_lines": F.size(F.filter(full, lambda x: F.length(x) > 80)), "words": text.word_count(t), "len": F.length(t)})
    n = F.greatest("len", F.lit(1))
    at = (F.size("ll") - 1) * 0.9
    low, high = F.get("ll", F.floor(at).cast("int")), F.get("ll", F.ceil(at).cast("int"))
    r = lambda c: F.round(c.cast("double"), 6)
    count = lambda p: F.regexp_count("t", F.lit(p))
    flag = lambda c: c.cast("double")
    return based.select(
        key,
        r(F.log1p("words")).alias("log_words"),
        r(F.log1p("n_ne")).alias("log_lines"),
        r(F.aggregate("ll", F.lit(0), lambda a, x: a + x) / F.size("ll")).alias("mean_line"),
        r(low + (high - low) * (at - F.floor(at))).alias("p90_line"),
        r(F.array_max("ll")).alias("max_line"),
        r(count(r"\p{Lu}") / n).alias("upper_rate"),
        r(count(r"\p{Nd}") / n).alias("digit_rate"),
        r(count("[.,;:]") / n).alias("punct_rate"),
        r(count("!") / n * 100).alias("exclaim_rate"),
        r(count(r"\?") / n * 100).alias("question_rate"),
        r(count(r"[^\x00-\x7f]") / n * 100).alias("non_ascii_rate"),
        r(F.col("trailing") / F.greatest("n_all", F.lit(1))).alias("trailing_rate"),
        r(count("  ") / n * 100).alias("double_space_rate"),
        r((F.col("n_all") - F.col("n_ne")) / F.greatest("n_all", F.lit(1))).alias("blank_rate"),
        flag(F.col("q").rlike(r"(?U)\S")).alias("has_quoted"),
        r(F.when(F.col("words") > 0, (F.col("len") - count(r"(?U)\s")) / F.col("words")).otherwise(0)).alias("mean_word"),
        flag(_has(F.left("t", F.lit(40)), r"(?Ui)^\s*(hi|hello|dear|hey)\b")).alias("greeting"),
        flag((F.lower("t") == F.col("t")) & (F.col("len") > 20)).alias("all_lower"),
        flag(_has(F.right("t", F.lit(120)), r"(?Uidm)(thanks|regards|best|sincerely)[,!.]?\s*$")).alias("signoff"),
        r(F.col("long_lines") / F.greatest("n_ne", F.lit(1))).alias("wide_rate"),
        flag(_has(F.col("t"), r"https?://|www\.")).alias("has_url"),
    )


def frequencies(df: DataFrame, column: Column, name: str, top: int | None = None) -> DataFrame:
    """How often each value occurs; with ``top`` the most frequent ones, ties by value. Nulls are left out."""
    counts = df.select(column.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(name)).limit(top) if top else counts


def shares(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Each value's count and its share of all rows that have one."""
    counts = frequencies(df, column, name)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(name, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # total is one row


def binned(df: DataFrame, column: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins of [low, high); bin 0 lies below and the last one above."""
    return df.select(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins).cast("bigint")).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def recipients(emails: DataFrame) -> Column:
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce("to_addrs", empty), F.coalesce("cc_addrs", empty))


def traffic(emails: DataFrame, internal_domain: str) -> DataFrame:
    """Shares of messages that stay inside, come in, and go out, of all rows. Messages without recipients are none of them."""
    inside = lambda a: F.endswith(F.lower(a), F.lit("@" + internal_domain))
    to, sender = recipients(emails), inside(F.coalesce("from_addr", F.lit("")))
    some, all_in, any_out = F.size(to) > 0, F.forall(to, inside), F.exists(to, lambda a: ~inside(a))
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return emails.agg(F.count("*").alias("n"), rate(sender & some & all_in).alias("internal_only"), rate(~sender & F.exists(to, inside)).alias("external_in"), rate(sender & any_out).alias("internal_to_external"))


def thread_stats(emails: DataFrame) -> DataFrame:
    """Subjects without marks: how many, share of messages in subjects that have several, median and 95 % quantile of messages in those, the largest."""
    per = emails.select(mail.base_subject(F.col("subject")).alias("base")).filter("base <> ''").groupBy("base").agg(F.count("*").alias("n"))
    several = F.when(F.col("n") > 1, F.col("n"))
    return per.agg(
        F.count("*").alias("n_subjects"),
        F.round(F.sum(several) / F.sum("n"), 6).alias("in_threads"),
        F.round(F.percentile(several, F.lit(0.5)), 6).alias("median_size"),
        F.round(F.percentile(several, F.lit(0.95)), 6).alias("p95_size"),
        F.max("n").alias("largest"),
    )


def later_in_folder(emails: DataFrame, key: Column) -> DataFrame:
    """Per folder type: rows whose key stood in an earlier row by (file, email_id). Each key's first row is found by a pre-aggregated minimum, not by sorting its rows."""
    rows = emails.select("email_id", "file", mail.folder_type(F.col("file")).alias("folder_type"), key.alias("key")).filter("key is not null")
    first = rows.groupBy("key").agg(F.min(F.struct("file", "email_id")).alias("first"))
    return rows.join(first, "key").groupBy("folder_type").agg(F.count("*").alias("n"), F.count_if(F.struct("file", "email_id") > F.col("first")).alias("n_later"))


def busiest(df: DataFrame, column: Column, name: str) -> DataFrame:
    """The most frequent value; the smallest one on ties."""
    return frequencies(df, column, name, top=1)


