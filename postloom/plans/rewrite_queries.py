"""Surrogates, redaction, style and rewriting queries, with SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postloom.functions import mail
from postloom.operators import generate, harvest, identity, judge, redact, rewrite, scrub, style
from postloom.plans import rewrite_sql
from postloom.plans.evaluate_queries import _SQL_SOURCES, _emails, _names, _sources, _synthetic
from postloom.plans.lineage import cut
from postloom.plans.profile_queries import COMPANY, INTERNAL
from postloom.sources import read_table

TERMS = ("kestra", "shift starts", "credit wants", "escrow", "risk report")


def _owners(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d).select(mail.owner(F.col("file")).alias("owner")).filter("owner <> ''").distinct()


def _profile_assign(s: SparkSession, d: str) -> DataFrame:
    return identity.assign_profiles(_owners(s, d), read_table(s, d, "profiles")).select("owner", "profile_id", "name", "domain", "locale")


def _senders(s: SparkSession, d: str) -> DataFrame:
    """Senders with a display name, with the profile of their mailbox."""
    named = _emails(s, d).filter("x_from <> ''").select(mail.owner(F.col("file")).alias("owner"), identity.canonical_name(identity.clean_name(F.col("x_from"))).alias("identity"))
    return named.join(_profile_assign(s, d).select("owner", "profile_id", "domain", "locale"), "owner")


def _personas(s: SparkSession, d: str) -> DataFrame:
    return identity.personas(_senders(s, d))


def _pseudonymised(s: SparkSession, d: str) -> DataFrame:
    """Bodies with the sender's and recipients' names replaced by surrogates of the mailbox's profile."""
    emails = identity.assign_profiles(_emails(s, d).withColumn("owner", mail.owner(F.col("file"))).filter("owner <> ''"), read_table(s, d, "profiles").select("profile_id", "domain", "locale", "profile_set"))
    addresses = F.array_distinct(F.array_union(F.array("from_addr"), F.coalesce("to_addrs", F.array().cast("array<string>"))))
    people = emails.select(F.col("email_id").alias("doc"), "profile_id", "domain", "locale", F.explode(addresses).alias("address")).filter("address <> ''").withColumn("name", identity.name_from_address(F.col("address"))).withColumn("identity", identity.canonical_name(F.col("name")))
    known = people.join(identity.personas(people), ["profile_id", "identity"]).select("doc", "name", "first", "last", "email", "address")
    return redact.rewrite_names(emails.select(F.col("email_id").alias("doc"), F.col("body").alias("text")), known).select(F.col("doc").alias("email_id"), "rewritten", "n_replaced")


def _first_of(address: Column) -> Column:
    return F.lower(F.substring_index(identity.name_from_address(address), " ", 1))


def _consistency(s: SparkSession, d: str) -> DataFrame:
    e = _emails(s, d).withColumn("sender_first", _first_of(F.col("from_addr"))).withColumn("to_first", F.transform(F.coalesce("to_addrs", F.array().cast("array<string>")), _first_of))
    return style.sign_greet(e, F.col("body"), F.col("sender_first"), F.col("to_first")).select("email_id", "sign_ok", "greet_ok")


def _people_left(s: SparkSession, d: str) -> DataFrame:
    """Full names of the corpus's people in derived texts."""
    return redact.name_hits(_synthetic(s, d).select(F.col("syn_id").alias("doc"), F.col("body").alias("text")), _names(s, d)).select(F.col("doc").alias("syn_id"), "name")


def _leak_scan(s: SparkSession, d: str) -> DataFrame:
    found = redact.leaks(F.col("text"), F.array(*(F.lit(t) for t in TERMS)))
    return read_table(s, d, "documents").select("doc_id", F.explode(found).alias("term"))


def _forced(s: SparkSession, d: str) -> DataFrame:
    """Derived bodies with their source's people redacted by force."""
    source = _sources(s, d).select("file", F.array(F.lower(identity.clean_name(F.col("x_from"))), F.lit(COMPANY)).alias("terms"))
    return _synthetic(s, d).join(source, "file").select("syn_id", redact.force_redact(F.col("body"), F.col("terms")).alias("body"))


def _restyled(s: SparkSession, d: str) -> DataFrame:
    source = _sources(s, d).select("file", F.col("body").alias("reference"))
    styled = _synthetic(s, d).join(source, "file").withColumn("body", style.restore(F.col("body"), F.col("reference")))
    return styled.select("syn_id", "body", style.rebuild(F.col("raw"), F.col("body"), F.col("quoted")).alias("raw"), style.signer_missing(F.col("reference"), F.col("body"), F.substring_index(F.col("headers")["From"], "@", 1)).alias("signer_missing"))


def _rewrap(s: SparkSession, d: str) -> DataFrame:
    based = _emails(s, d).select("email_id", "body", style.wrap_width(F.col("body")).alias("width"))
    return style.rewrap(based, "body", "width").select("email_id", "width", (F.col("laid_out") == F.col("body")).alias("same"))


SCRUB_TERMS = scrub.Terms(("kestra grid", COMPANY), INTERNAL, ("foxglove energy", "birchline logistics", "junovale logistics"), ("bramreach", "tallowport", "elmfield"), ("RTX", "OPSC"))


def offline_writer(prompts: list[str]) -> list[tuple[str, float]]:
    """Deterministic stand-in for a service: what stands in the last tags of the prompt, with a word for each placeholder."""
    return [(re.sub(r"\[(?:COMPANY|ORG_\d+|LOC_\d+|UNIT_\d+)\]", "Acorn", p[p.rfind("<subject>") :] if "<subject>" in p else p), 0.0001) for p in prompts]


def _scrub(s: SparkSession, d: str) -> DataFrame:
    return scrub.scrub(_emails(s, d), read_table(s, d, "profiles"), SCRUB_TERMS)


def _scrub_checks(s: SparkSession, d: str) -> DataFrame:
    """Per scrubbed message: profile, shift, how many hard terms are left, and whether an address of the source's header is."""
    x = _scrub(s, d)
    text = F.concat_ws("\n", "subject", "body", "trailer")
    source = _emails(s, d).select("email_id", F.concat(F.array("from_addr"), F.coalesce("to_addrs", F.array().cast("array<string>"))).alias("addresses"))
    return x.join(source, "email_id").select("email_id", "profile_id", "shift_days", F.size(redact.leaks(text, F.col("hard_terms"))).alias("n_left"), (F.size(redact.leaks(text, F.col("addresses"))) > 0).alias("address_left"))


def _generated(s: SparkSession, d: str, mode: str) -> DataFrame:
    g = generate.generate(_scrub(s, d), mode, offline_writer, s.createDataFrame([], rewrite.CACHE), company_terms=SCRUB_TERMS.company)
    domains = read_table(s, d, "profiles").select(F.col("profile_id").alias("company"), "domain")
    return g.join(domains, "company").select("email_id", "company", F.col("headers")["Message-ID"].alias("new_id"), F.col("headers")["Date"].alias("date_header"), F.size("meta.leaks_after").alias("n_leaks"), F.col("raw").rlike(scrub.PLACEHOLDER).alias("placeholder_left"), F.regexp_like(F.col("headers")["From"], F.concat(F.lit("@"), F.col("domain"), F.lit(">?$"))).alias("from_profile"), F.contains(F.lower("raw"), F.lit(COMPANY)).alias("source_left"))


def _direct(s: SparkSession, d: str) -> DataFrame:
    """The baseline without scrubbing: what its answers leak."""
    g = generate.generate(_scrub(s, d), "direct", offline_writer, s.createDataFrame([], rewrite.CACHE))
    return g.agg(F.count("*").alias("n"), F.count_if(F.size("meta.leaks_after") > 0).alias("n_leaking"), F.count_if(F.col("quoted") != "").alias("n_quoted"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return _emails(s, d).select(F.col("email_id").alias("doc"), F.concat_ws("\n\n", "body", "trailer").alias("text"))


def _given(s: SparkSession, d: str) -> DataFrame:
    return harvest.given_names(_emails(s, d).select(F.explode(F.array_union(F.array("from_addr"), F.coalesce("to_addrs", F.array().cast("array<string>")))).alias("address")).distinct())


def _harvested(s: SparkSession, d: str) -> DataFrame:
    """How many names each way of finding them gives."""
    docs, given = _docs(s, d), _given(s, d)
    frequencies = cut(harvest.word_frequencies(docs))
    ways = {"pairs": harvest.address_pairs(docs).select("doc", "name"), "headers": harvest.header_line_names(docs), "capitals": harvest.capitalised_names(docs, given, frequencies), "lower_case": harvest.lowercase_names(docs, given, frequencies)}
    found = None
    for way, names in ways.items():
        own = names.withColumn("way", F.lit(way))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("way").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"), F.count_distinct("doc").alias("n_docs"))


def _replies(s: SparkSession, d: str) -> DataFrame:
    source = _sources(s, d).select("file", F.col("body").alias("source"))
    pairs = _synthetic(s, d).join(source, "file").select(F.col("syn_id").alias("idx"), "source", F.col("body").alias("derived"))
    return judge.judge(pairs, s.createDataFrame([], "prompt_key string, text string, cost double, model string"), judge.offline_judge)


def _judged_labels(s: SparkSession, d: str) -> DataFrame:
    replies, found = _replies(s, d), None
    for label in ("category", "intent", "action_required", "sensitive"):
        own = judge.label_agreement(replies, label)
        found = own if found is None else found.unionByName(own)
    return found


_PHONE = r"(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}"
QUERIES = {
    "profile_assign": _profile_assign,
    "persona_dim": _personas,
    "date_shift": lambda s, d: identity.shift_dates(_emails(s, d).select("email_id", "file", "date"), mail.owner(F.col("file"))).select("email_id", "shift_days", F.date_format("shifted", "yyyy-MM-dd'T'HH:mm:ss").alias("shifted")),
    "new_message_ids": lambda s, d: _emails(s, d).select("email_id", identity.message_id(F.col("message_id"), F.lit("new.example")).alias("new_id")),
    "pseudonymised": _pseudonymised,
    "redact_emails": lambda s, d: read_table(s, d, "documents").select("doc_id", redact.redact_contacts(F.col("text"), ("EMAIL",)).alias("text")),
    "redact_contacts": lambda s, d: _emails(s, d).select("email_id", redact.redact_contacts(F.col("body")).alias("body"), F.to_json(redact.span_counts(F.col("body"))).alias("counts")),
    "shift_text_dates": lambda s, d: _emails(s, d).select("email_id", redact.shift_numeric_dates(F.col("body"), F.lit(371)).alias("body")),
    "contact_flags": lambda s, d: read_table(s, d, "documents").select("doc_id", F.contains("text", F.lit("@")).alias("has_at"), F.col("text").rlike(r"https?://").alias("has_url"), F.col("text").rlike(_PHONE).alias("has_phone"), F.col("text").rlike(r"(\$|EUR |GBP )[0-9]").alias("has_money"), F.col("text").rlike(r"[0-9]{7,}").alias("has_long_number"), F.col("text").rlike(r"[0-9]{1,2}/[0-9]{1,2}").alias("has_date")),
    "leak_scan": _leak_scan,
    "people_left": _people_left,
    "force_redact": _forced,
    "wrap_profile": lambda s, d: _emails(s, d).select("email_id", style.wrap_width(F.col("body")).alias("wrap_width"), style.fingerprint(F.col("body")).alias("f")).select("email_id", "wrap_width", "f.n_words", "f.wrapped", F.col("f.wrap_width").alias("p90_width")),
    "restyle": _restyled,
    "rewrap": _rewrap,
    "consistency": _consistency,
    "consistency_rates": lambda s, d: _consistency(s, d).agg(F.count("*").alias("n"), F.round(F.avg(F.col("sign_ok").cast("int")), 6).alias("sign_rate"), F.round(F.avg(F.col("greet_ok").cast("int")), 6).alias("greet_rate")),
    "scrub_checks": _scrub_checks,
    "rule_mode": lambda s, d: _generated(s, d, "rule"),
    "hybrid_mode": lambda s, d: _generated(s, d, "hybrid"),
    "direct_mode": _direct,
    "harvested_names": _harvested,
    "recipient_names": lambda s, d: _emails(s, d).select("email_id", F.posexplode(harvest.paired_names(F.col("x_to"), F.coalesce("to_addrs", F.array().cast("array<string>")))).alias("pos", "name")),
    "display_names": lambda s, d: _emails(s, d).select(F.coalesce("x_from", F.lit("")).alias("x_from"), identity.clean_name(F.col("x_from")).alias("name"), identity.canonical_name(identity.clean_name(F.col("x_from"))).alias("identity")).distinct(),
    "cleaned": lambda s, d: read_table(s, d, "documents").select("doc_id", redact.clean_artifacts(F.col("text")).alias("text")),
    "given_names": lambda s, d: _given(s, d),
    "word_frequencies": lambda s, d: harvest.word_frequencies(_docs(s, d).select("text")),
    "trimmed": lambda s, d: _emails(s, d).select("email_id", F.length(harvest.trim_words(F.col("raw_body"), 120)).alias("trimmed_len")),
    "judged_realism": lambda s, d: judge.realism(_replies(s, d)),
    "judged_artifacts": lambda s, d: judge.top_artifacts(_replies(s, d)),
    "judged_labels": _judged_labels,
}

_SQL_MOD, _SQL_DAYS = rewrite_sql.MOD, rewrite_sql.DAYS
_SQL_FIRST = lambda a: f"lower(CASE WHEN len(list_filter(regexp_split_to_array(split_part({a}, '@', 1), '[._-]'), lambda p: p <> '')) >= 2 AND regexp_matches(list_filter(regexp_split_to_array(split_part({a}, '@', 1), '[._-]'), lambda p: p <> '')[1], '^\\p{{L}}{{2,}}$') AND regexp_matches(list_filter(regexp_split_to_array(split_part({a}, '@', 1), '[._-]'), lambda p: p <> '')[2], '^\\p{{L}}{{2,}}$') THEN list_filter(regexp_split_to_array(split_part({a}, '@', 1), '[._-]'), lambda p: p <> '')[1] ELSE split_part({a}, '@', 1) END)"
_SQL_CONSISTENCY = f"""
WITH t AS (SELECT email_id, regexp_replace(regexp_replace(coalesce(body, ''), '^[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ''), '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+$', '') AS b, {_SQL_FIRST("from_addr")} AS f, list_transform(to_addrs, lambda a: {_SQL_FIRST("a")}) AS r FROM parsed_emails),
u AS (SELECT *, lower(array_to_string(string_split(b, chr(10))[-3:], ' ')) AS last, lower(regexp_extract(b, '(?i)^\\s*(?:hi|hello|dear|hey)\\s+([A-Za-z]+)', 1)) AS g FROM t)
SELECT email_id, CASE WHEN regexp_matches(lower(right(b, 200)), '(regards|thanks|thank you|best|sincerely)') AND f <> '' THEN contains(last, f) END AS sign_ok, CASE WHEN g <> '' AND len(r) > 0 THEN list_contains(r, g) END AS greet_ok FROM u
"""

SQL = {
    "given_names": "WITH a AS (SELECT DISTINCT unnest(list_append(to_addrs, from_addr)) AS a FROM parsed_emails), l AS (SELECT list_filter(regexp_split_to_array(split_part(a, '@', 1), '[._-]'), lambda p: p <> '') AS p FROM a), n AS (SELECT DISTINCT lower(p[1]) AS f, lower(p[2]) AS s FROM l WHERE len(p) = 2 AND regexp_matches(p[1], '^\\p{L}{2,}$') AND regexp_matches(p[2], '^\\p{L}{2,}$')) SELECT f AS first, count(*) AS n_last FROM n GROUP BY 1 HAVING count(*) >= 3",
    "word_frequencies": rewrite_sql.FREQUENCIES,
    "persona_dim": rewrite_sql.PERSONAS,
    "redact_contacts": rewrite_sql.REDACTED,
    "shift_text_dates": rewrite_sql.MOVED,
    "force_redact": rewrite_sql.FORCED,
    "restyle": rewrite_sql.RESTYLED,
    "trimmed": rewrite_sql.TRIMMED,
    "recipient_names": rewrite_sql.RECIPIENTS,
    "display_names": rewrite_sql.DISPLAY_NAMES,
    "judged_realism": rewrite_sql.REALISM,
    "judged_artifacts": rewrite_sql.ARTIFACTS,
    "judged_labels": rewrite_sql.AGREEMENT,
    "scrub_checks": rewrite_sql.SCRUBBED,
    "rule_mode": rewrite_sql.GENERATED,
    "cleaned": rewrite_sql.CLEANED,
    "hybrid_mode": rewrite_sql.GENERATED,
    "profile_assign": f"WITH p AS (SELECT *, row_number() OVER (ORDER BY profile_id) - 1 AS k, count(*) OVER () AS n FROM profiles WHERE profile_set = 'current'), o AS (SELECT DISTINCT split_part(file, '/', 1) AS owner FROM parsed_emails WHERE file <> ''), c AS (SELECT count(*) AS n FROM p), h AS (SELECT owner, {_SQL_MOD(f'''sha256(owner || '|{identity.SALT}')''', 'n')} AS k FROM o, c WHERE owner <> '') SELECT owner, profile_id, name, domain, locale FROM h JOIN p USING (k)",
    "date_shift": f"WITH t AS (SELECT email_id, split_part(file, '/', 1) AS owner, CAST(left(date, 19) AS TIMESTAMP) AS ts FROM parsed_emails), d AS (SELECT *, {_SQL_DAYS} AS shift_days FROM t) SELECT email_id, shift_days, strftime(ts + shift_days * INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') AS shifted FROM d",
    "redact_emails": "SELECT doc_id, regexp_replace(text, '[A-Za-z0-9_.+''-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+', '[EMAIL]', 'g') AS text FROM documents",
    "contact_flags": "SELECT doc_id, contains(text, '@') AS has_at, regexp_matches(text, 'https?://') AS has_url, regexp_matches(text, '(?:\\([0-9]{3}\\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}') AS has_phone, regexp_matches(text, '(\\$|EUR |GBP )[0-9]') AS has_money, regexp_matches(text, '[0-9]{7,}') AS has_long_number, regexp_matches(text, '[0-9]{1,2}/[0-9]{1,2}') AS has_date FROM documents",
    "leak_scan": " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" for t in TERMS),
    "people_left": "WITH n AS (SELECT DISTINCT lower(x_from) AS name FROM parsed_emails WHERE regexp_matches(x_from, '^\\p{L}+ \\p{L}+$')), w AS (SELECT syn_id, regexp_extract_all(lower(coalesce(body, '')), '\\p{L}+') AS w FROM synthetic_emails WHERE error IS NULL), p AS (SELECT DISTINCT syn_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name FROM w) SELECT syn_id, name FROM p JOIN n USING (name)",
    "consistency": _SQL_CONSISTENCY,
    "consistency_rates": f"WITH c AS ({_SQL_CONSISTENCY}) SELECT count(*) AS n, round(avg(CAST(sign_ok AS INTEGER)), 6) AS sign_rate, round(avg(CAST(greet_ok AS INTEGER)), 6) AS greet_rate FROM c",
    "new_message_ids": f"WITH t AS (SELECT email_id, md5(message_id || '|new.example|{identity.SALT}') AS h FROM parsed_emails) SELECT email_id, '<' || left(h, 16) || '.' || lpad(CAST(CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100000 AS VARCHAR), 5, '0') || '@new.example>' AS new_id FROM t",
    "wrap_profile": """
WITH t AS (SELECT email_id, list_filter(string_split(coalesce(body, ''), chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls, len(regexp_extract_all(coalesce(body, ''), '""" + r"[^\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+" + """')) AS n_words FROM parsed_emails),
u AS (SELECT *, list_sort(list_transform(ls, lambda x: length(x))) AS l, list_filter(ls, lambda x: NOT regexp_matches(x, '^\\s*(>|http|www)')) AS k FROM t),
v AS (SELECT *, list_sort(list_filter(list_transform(k, lambda x: length(x)), lambda n: n >= 50)) AS g, coalesce(l[CAST(floor((len(l) - 1) * 0.9) AS INTEGER) + 1], 0) AS p90, (l[CAST(floor((len(l) - 1) / 2) AS INTEGER) + 1] + l[CAST(ceil((len(l) - 1) / 2) AS INTEGER) + 1]) / 2 AS med FROM u)
SELECT email_id, CAST(CASE WHEN len(k) >= 3 AND len(g) >= 2 AND list_max(g) <= 90 THEN greatest(60, least(80, g[CAST(floor((len(g) - 1) * 0.9) AS INTEGER) + 1])) END AS INTEGER) AS wrap_width, CAST(n_words AS INTEGER) AS n_words, coalesce(len(l) >= 4 AND p90 <= 82 AND med >= 40, false) AS wrapped, CAST(p90 AS INTEGER) AS p90_width FROM v
""",
}
