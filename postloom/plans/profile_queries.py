"""Corpus profiling over the e-mail tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postloom.functions import mail, text
from postloom.operators import profile
from postloom.plans import sql
from postloom.sources import read_table

INTERNAL = "kestra-grid.example"
COMPANY = "kestra"


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "parsed_emails")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.featurize(_emails(spark, sf_dir), INTERNAL, COMPANY)


_B, _T, _R, _S = "coalesce(body, '')", "coalesce(trailer, '')", "coalesce(raw_body, '')", "coalesce(subject, '')"
# Bounds beside Unicode letters can't be said in RE2, so words of ASCII are bounded by ASCII.
_FEATURES = f"""
SELECT email_id, file, {sql.folder_type()} AS folder_type, split_part(file, '/', 1) AS owner, date, CAST(len(to_addrs) AS INTEGER) AS n_to, CAST(len(cc_addrs) AS INTEGER) AS n_cc,
  CAST({sql.words(_S)} AS INTEGER) AS subject_len, starts_with(lower({_S}), 're:') AS is_re, starts_with(lower({_S}), 'fw:') OR starts_with(lower({_S}), 'fwd:') AS is_fw, {_S} = '' AS empty_subject,
  CAST({sql.words(_B)} AS INTEGER) AS body_words, CAST({sql.words(_T)} AS INTEGER) AS trailer_words, {_T} <> '' AS has_trailer, CAST(length({_B}) - length(replace({_B}, chr(10), '')) + 1 AS INTEGER) AS n_lines,
  CAST({sql.count(_R, mail.EMAIL)} AS INTEGER) AS n_emails_in_text, CAST({sql.count(_R, mail.PHONE)} AS INTEGER) AS n_phones, CAST({sql.count(_R, mail.MONEY)} AS INTEGER) AS n_money, CAST({sql.count(_R, mail.URL)} AS INTEGER) AS n_urls,
  {sql.has(_B, mail.ATTACHMENT)} AS mentions_attachment, {sql.has(f"left({_B}, 60)", mail.GREETING)} AS has_greeting, {sql.has(f"right({_B}, 200)", mail.SIGNOFF)} AS has_signoff,
  contains(lower({_R}), '{COMPANY}') AS mentions_company, NOT ends_with(coalesce(from_addr, ''), '@{INTERNAL}') AS external_sender, CAST(length({_R}) AS INTEGER) AS raw_len
FROM parsed_emails
"""


def _rate(c: str, name: str) -> str:
    return f"round(avg(CAST({c} AS INTEGER)), 6) AS {name}_rate"


_SUMMARY = ", ".join(
    [
        "count(*) AS n",
        "count(DISTINCT owner) AS n_owners",
        "round(avg(body_words), 6) AS mean_words",
        *(f"round(quantile_cont(body_words, {p}), 6) AS body_words_q{round(100 * p):02d}" for p in profile.QUANTILES),
        _rate("body_words = 0", "empty_body"),
        *(_rate(c, c) for c in ("has_trailer", "is_re", "is_fw", "empty_subject", "mentions_attachment", "has_greeting", "has_signoff", "mentions_company", "external_sender")),
        *(_rate(f"{c} > 0", c) for c in ("n_emails_in_text", "n_phones", "n_money", "n_urls")),
        _rate("n_to + n_cc <= 1", "one_recipient"),
    ]
)

_STRIPPED = sql.strip(_B)
_STRUCTURE = f"""
WITH t AS (SELECT email_id, {_STRIPPED} AS b, {_T} AS tr, lower({_S}) AS s, to_addrs, cc_addrs FROM parsed_emails)
SELECT email_id, CAST({sql.words("b")} AS INTEGER) AS body_words, CAST(len(list_filter(string_split(b, chr(10)), lambda x: {sql.has("x", r"(?U)\S")})) AS INTEGER) AS n_lines,
  CAST(len(list_filter(regexp_split_to_array(b, {sql.re2(r"(?U)\n\s*\n")}), lambda x: {sql.has("x", r"(?U)\S")})) AS INTEGER) AS n_paragraphs,
  {sql.has("left(b, 60)", mail.GREETING)} AS has_greeting, {sql.has("right(b, 250)", r"(?Ui)(thanks|thank you|regards|best|sincerely|cheers)[,!.]?\s*(\n|$)")} AS has_signoff,
  {sql.has("tr", r"(?U)\S")} AS has_trailer, lower(b) = b AND length(b) > 20 AS all_lower, regexp_matches(b, 'https?://|www\\.') AS has_url, {sql.has("b", r"(?Ui)\battach")} AS mentions_attachment,
  starts_with(s, 're:') AS is_re, starts_with(s, 'fw:') OR starts_with(s, 'fwd:') AS is_fw, CAST(coalesce(len(to_addrs), 0) AS INTEGER) AS n_to, CAST(coalesce(len(cc_addrs), 0) AS INTEGER) AS n_cc
FROM t
"""
_FORM = f"""
WITH t AS (SELECT syn_id, {sql.strip("coalesce(body, '')")} AS t, coalesce(quoted, '') AS q FROM synthetic_emails WHERE error IS NULL),
l AS (SELECT *, string_split(t, chr(10)) AS ls, list_filter(string_split(t, chr(10)), lambda x: {sql.has("x", r"(?U)\S")}) AS f, {sql.words("t")} AS w, length(t) AS n FROM t),
m AS (SELECT *, CASE WHEN len(f) = 0 THEN [0] ELSE list_sort(list_transform(f, lambda x: length(x))) END AS ll, greatest(n, 1) AS d FROM l),
p AS (SELECT *, (len(ll) - 1) * CAST(0.9 AS DOUBLE) AS place FROM m)
SELECT syn_id, round(ln(1 + w), 6) AS log_words, round(ln(1 + len(f)), 6) AS log_lines, round(list_sum(ll) / len(ll), 6) AS mean_line,
  round(ll[CAST(floor(place) AS INTEGER) + 1] + (ll[CAST(ceil(place) AS INTEGER) + 1] - ll[CAST(floor(place) AS INTEGER) + 1]) * (place - floor(place)), 6) AS p90_line, round(CAST(list_max(ll) AS DOUBLE), 6) AS max_line,
  {", ".join(f"round({sql.count('t', p)} / d{k}, 6) AS {c}" for c, p, k in (("upper_rate", r"\p{Lu}", ""), ("digit_rate", r"\p{Nd}", ""), ("punct_rate", "[.,;:]", ""), ("exclaim_rate", "!", " * 100"), ("question_rate", r"\?", " * 100"), ("non_ascii_rate", r"[^\x00-\x7f]", " * 100"), ("double_space_rate", "  ", " * 100")))},
  round(len(list_filter(ls, lambda x: ends_with(x, ' '))) / greatest(len(ls), 1), 6) AS trailing_rate, round((len(ls) - len(f)) / greatest(len(ls), 1), 6) AS blank_rate, CAST({sql.has("q", r"(?U)\S")} AS DOUBLE) AS has_quoted,
  round(CASE WHEN w > 0 THEN (n - {sql.count("t", r"(?U)\s")}) / w ELSE 0 END, 6) AS mean_word, CAST(regexp_matches(left(t, 40), '(?i)^\\s*(hi|hello|dear|hey)\\b') AS DOUBLE) AS greeting, CAST(lower(t) = t AND n > 20 AS DOUBLE) AS all_lower,
  CAST(regexp_matches(right(t, 120), '(?im)(thanks|regards|best|sincerely)[,!.]?\\s*$') AS DOUBLE) AS signoff, round(len(list_filter(f, lambda x: length(x) > 80)) / greatest(len(f), 1), 6) AS wide_rate, CAST(regexp_matches(t, 'https?://|www\\.') AS DOUBLE) AS has_url
FROM p
"""


def _wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir).select("email_id", mail.wall_clock(F.col("date")).alias("at"), F.try_to_timestamp("date").alias("instant")).filter("at is not null")


_SQL_WALL = "(SELECT email_id, CAST(left(date, 19) AS TIMESTAMP) AS ts FROM parsed_emails WHERE date IS NOT NULL)"
_RECIPIENTS = "(SELECT unnest(list_concat(to_addrs, cc_addrs)) AS a FROM parsed_emails)"


def _recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir).select(F.explode(profile.recipients(_emails(spark, sf_dir))).alias("a"))


def _share(spark: SparkSession, sf_dir: str, what, name: str) -> DataFrame:
    return profile.shares(_wall(spark, sf_dir), what, name)


def _sql_share(expression: str, name: str) -> str:
    return f"WITH c AS (SELECT {expression} AS {name}, count(*) AS n FROM {_SQL_WALL} GROUP BY 1) SELECT {name}, n, round(n / sum(n) OVER (), 6) AS share FROM c"


_TO_N = f"least(CAST(len(to_addrs) AS INTEGER), 15)"
_INSIDE = f"ends_with(lower(a), '@{INTERNAL}')"

QUERIES = {
    "email_features": _features,
    "feature_summary": lambda s, d: profile.summarize(_features(s, d)),
    "feature_totals": lambda s, d: profile.summarize(_features(s, d), by=None),
    "email_structure": lambda s, d: profile.structure(_emails(s, d), "email_id"),
    "form_features": lambda s, d: profile.form_features(read_table(s, d, "synthetic_emails").filter("error is null"), "syn_id"),
    "top_senders": lambda s, d: profile.frequencies(_emails(s, d), F.nullif(F.col("from_addr"), F.lit("")), "sender", 15),
    "top_recipients": lambda s, d: profile.frequencies(_recipients(s, d), F.col("a"), "recipient", 15),
    "sender_domains": lambda s, d: profile.frequencies(_emails(s, d), mail.domain(F.col("from_addr")), "domain"),
    "recipient_domains": lambda s, d: profile.frequencies(_recipients(s, d), mail.domain(F.col("a")), "domain"),
    "folder_counts": lambda s, d: profile.frequencies(_emails(s, d), mail.folder_type(F.col("file")), "folder_type"),
    "cardinalities": lambda s, d: _emails(s, d).agg(F.count_distinct("from_addr").alias("senders"), F.count_distinct(mail.domain(F.col("from_addr"))).alias("sender_domains"), F.count_distinct("message_id").alias("message_ids"), F.count_distinct(mail.owner(F.col("file"))).alias("owners")),
    "hour_share": lambda s, d: _share(s, d, F.hour("at"), "hour"),
    "weekday_share": lambda s, d: _share(s, d, F.weekday("at"), "weekday"),
    "month_counts": lambda s, d: profile.frequencies(_wall(s, d), F.date_format("at", "yyyy-MM"), "month").filter(F.col("month").between("2016-01", "2022-08")),
    "busiest_month": lambda s, d: profile.busiest(_wall(s, d), F.date_format("at", "yyyy-MM"), "month"),
    "year_counts": lambda s, d: profile.frequencies(_wall(s, d), F.year("instant"), "year").filter("year between 2015 and 2023"),
    "date_range": lambda s, d: _wall(s, d).agg(F.min(F.date_format("at", "yyyy-MM")).alias("first_month"), F.max(F.date_format("at", "yyyy-MM")).alias("last_month"), F.count("*").alias("n")),
    "recipient_hist": lambda s, d: profile.frequencies(_emails(s, d), F.least(F.size("to_addrs"), F.lit(15)), "n_to"),
    "words_hist": lambda s, d: profile.binned(_emails(s, d).withColumn("w", text.word_count(F.coalesce("body", F.lit("")))), F.log10(F.col("w") + 1), 0.0, 4.0, 50),
    "traffic_split": lambda s, d: profile.traffic(_emails(s, d), INTERNAL),
    "thread_stats": lambda s, d: profile.thread_stats(_emails(s, d)),
    "folder_dups_by_id": lambda s, d: profile.later_in_folder(_emails(s, d), F.nullif(F.col("message_id"), F.lit(""))),
    "folder_dups_by_body": lambda s, d: profile.later_in_folder(_emails(s, d), F.md5(text.collapse(F.coalesce("body", F.lit(""))))),
}


def _sql_later(key: str) -> str:
    return f"WITH r AS (SELECT {sql.folder_type()} AS folder_type, row_number() OVER (PARTITION BY {key} ORDER BY file, email_id) AS k FROM parsed_emails WHERE {key} IS NOT NULL) SELECT folder_type, count(*) AS n, count(*) FILTER (k > 1) AS n_later FROM r GROUP BY 1"


SQL = {
    "email_features": _FEATURES,
    "feature_summary": f"WITH f AS ({_FEATURES}) SELECT folder_type, {_SUMMARY} FROM f GROUP BY 1",
    "feature_totals": f"WITH f AS ({_FEATURES}) SELECT {_SUMMARY} FROM f",
    "email_structure": _STRUCTURE,
    "form_features": _FORM,
    "top_senders": "SELECT from_addr AS sender, count(*) AS n FROM parsed_emails WHERE from_addr <> '' GROUP BY 1 ORDER BY n DESC, sender LIMIT 15",
    "top_recipients": f"SELECT a AS recipient, count(*) AS n FROM {_RECIPIENTS} GROUP BY 1 ORDER BY n DESC, recipient LIMIT 15",
    "sender_domains": "SELECT regexp_extract(from_addr, '@([^@]*)$', 1) AS domain, count(*) AS n FROM parsed_emails WHERE from_addr IS NOT NULL GROUP BY 1",
    "recipient_domains": f"SELECT regexp_extract(a, '@([^@]*)$', 1) AS domain, count(*) AS n FROM {_RECIPIENTS} GROUP BY 1",
    "folder_counts": f"SELECT {sql.folder_type()} AS folder_type, count(*) AS n FROM parsed_emails GROUP BY 1",
    "cardinalities": "SELECT count(DISTINCT from_addr) AS senders, count(DISTINCT regexp_extract(from_addr, '@([^@]*)$', 1)) AS sender_domains, count(DISTINCT message_id) AS message_ids, count(DISTINCT split_part(file, '/', 1)) AS owners FROM parsed_emails",
    "hour_share": _sql_share("CAST(hour(ts) AS INTEGER)", "hour"),
    "weekday_share": _sql_share("CAST(isodow(ts) - 1 AS INTEGER)", "weekday"),
    "month_counts": f"SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM {_SQL_WALL} GROUP BY 1 HAVING month BETWEEN '2016-01' AND '2022-08'",
    "busiest_month": f"SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM {_SQL_WALL} GROUP BY 1 ORDER BY n DESC, month LIMIT 1",
    "year_counts": "SELECT CAST(year(CAST(left(date, 19) AS TIMESTAMP) - CAST(substr(date, 20, 1) || substr(date, 21, 2) AS INTEGER) * INTERVAL 1 HOUR - CAST(substr(date, 20, 1) || substr(date, 24, 2) AS INTEGER) * INTERVAL 1 MINUTE) AS INTEGER) AS year, count(*) AS n FROM parsed_emails WHERE date IS NOT NULL GROUP BY 1 HAVING year BETWEEN 2015 AND 2023",
    "date_range": f"SELECT min(strftime(ts, '%Y-%m')) AS first_month, max(strftime(ts, '%Y-%m')) AS last_month, count(*) AS n FROM {_SQL_WALL}",
    "recipient_hist": f"SELECT {_TO_N} AS n_to, count(*) AS n FROM parsed_emails GROUP BY 1",
    "words_hist": f"SELECT CASE WHEN v < 0 THEN 0 WHEN v >= 4 THEN 51 ELSE CAST(floor(v / 4 * 50) AS BIGINT) + 1 END AS bin, count(*) AS n FROM (SELECT log10({sql.words(_B)} + 1) AS v FROM parsed_emails) GROUP BY 1",
    "traffic_split": f"WITH t AS (SELECT list_concat(to_addrs, cc_addrs) AS r, ends_with(lower(coalesce(from_addr, '')), '@{INTERNAL}') AS s FROM parsed_emails), u AS (SELECT s, len(r) > 0 AS any_to, len(list_filter(r, lambda a: {_INSIDE})) AS i, len(r) AS k FROM t) SELECT count(*) AS n, round(count(*) FILTER (s AND any_to AND i = k) / count(*), 6) AS internal_only, round(count(*) FILTER (NOT s AND i > 0) / count(*), 6) AS external_in, round(count(*) FILTER (s AND i < k) / count(*), 6) AS internal_to_external FROM u",
    "thread_stats": f"WITH p AS (SELECT {sql.base_subject()} AS base, count(*) AS n FROM parsed_emails GROUP BY 1 HAVING base <> '') SELECT count(*) AS n_subjects, round(sum(n) FILTER (n > 1) / sum(n), 6) AS in_threads, round(quantile_cont(n, 0.5) FILTER (n > 1), 6) AS median_size, round(quantile_cont(n, 0.95) FILTER (n > 1), 6) AS p95_size, max(n) AS largest FROM p",
    "folder_dups_by_id": _sql_later("nullif(message_id, '')"),
    "folder_dups_by_body": _sql_later(f"md5(regexp_replace({_B}, {sql.re2(r'(?U)\s+')}, ' ', 'g'))"),
}
