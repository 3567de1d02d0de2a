"""Parsing, sampling, de-duplication and evaluation queries, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postloom.functions import mail
from postloom.operators import dedup, evaluate, identity, parse, profile, rewrite, sample
from postloom.plans import sql
from postloom.plans.profile_queries import COMPANY, INTERNAL, SQL as PROFILE_SQL
from postloom.sources import read_table

_BLANK = sql.re2(r"(?U)\s+")
_KEY = f"md5(lower({sql.strip(f'regexp_replace({chr(99)}oalesce(body, {chr(39)}{chr(39)}), {_BLANK}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}))"


def _emails(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "parsed_emails")


def _synthetic(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "synthetic_emails").filter("error is null")


def _features(s: SparkSession, d: str) -> DataFrame:
    return profile.featurize(_emails(s, d), INTERNAL, COMPANY)


def _sources(s: SparkSession, d: str) -> DataFrame:
    """Each file's first row; files may be loaded twice."""
    return dedup.first_wins(_emails(s, d), F.col("file"), ["email_id"])


_SQL_SOURCES = "(SELECT * FROM parsed_emails QUALIFY row_number() OVER (PARTITION BY file ORDER BY email_id) = 1)"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Structure of each derived message beside that of its source."""
    derived = _synthetic(s, d)
    side = lambda df, key, p, *more: profile.structure(df, key, *more).select(key, *(F.col(c).alias(f"{p}_{c}") for c in ("body_words", "n_lines", "n_paragraphs", *evaluate.FLAGS)))
    source = side(_sources(s, d).select("file", "subject", "body", "trailer", "to_addrs", "cc_addrs"), "file", "o")
    return derived.select("syn_id", "run_name", "file").join(side(derived, "syn_id", "s", "body", "quoted", _n_in(F.col("headers")["To"]), _n_in(F.col("headers")["Cc"])), "syn_id").join(source, "file")


def _n_in(c: Column) -> Column:
    """How many addresses a header lists."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit("@"))


def _sql_structure(body: str, tail: str, prefix: str) -> str:
    b = sql.strip(f"coalesce({body}, '')")
    return f"""CAST({sql.words(b)} AS INTEGER) AS {prefix}_body_words, {sql.has(f"left({b}, 60)", mail.GREETING)} AS {prefix}_has_greeting,
      {sql.has(f"right({b}, 250)", r"(?Ui)(thanks|thank you|regards|best|sincerely|cheers)[,!.]?\s*(\n|$)")} AS {prefix}_has_signoff, {sql.has(f"coalesce({tail}, '')", r"(?U)\S")} AS {prefix}_has_trailer,
      lower({b}) = {b} AND length({b}) > 20 AS {prefix}_all_lower, regexp_matches({b}, 'https?://|www\\.') AS {prefix}_has_url, {sql.has(b, r"(?Ui)\battach")} AS {prefix}_mentions_attachment"""


_SQL_PAIRS = f"(SELECT s.run_name, {_sql_structure('s.body', 's.quoted', 's')}, {_sql_structure('p.body', 'p.trailer', 'o')} FROM synthetic_emails s JOIN {_SQL_SOURCES} p USING (file) WHERE s.error IS NULL)"
_FIDELITY = f"""
WITH p AS (SELECT *, (s_body_words + 1) / (o_body_words + 1) AS ratio FROM {_SQL_PAIRS}),
one AS (SELECT run_name, count(*) AS n, {", ".join(f"round(quantile_cont(ratio, {q / 100}), 6) AS ratio_q{q}" for q in (25, 50, 75))},
  {", ".join(f"round(avg(CAST(o_{f} = s_{f} AS INTEGER)), 6) AS {f}_agree, round(avg(CAST(o_{f} AS INTEGER)), 6) AS {f}_source_rate, round(avg(CAST(s_{f} AS INTEGER)), 6) AS {f}_derived_rate" for f in evaluate.FLAGS)} FROM p GROUP BY 1),
ranked AS (SELECT run_name, rank() OVER (PARTITION BY run_name ORDER BY o_body_words) + (count(*) OVER (PARTITION BY run_name, o_body_words) - 1) / 2 AS ra, rank() OVER (PARTITION BY run_name ORDER BY s_body_words) + (count(*) OVER (PARTITION BY run_name, s_body_words) - 1) / 2 AS rb FROM p),
rho AS (SELECT run_name, round(corr(ra, rb), 6) AS spearman FROM ranked GROUP BY 1),
long AS (SELECT run_name, o_body_words AS v, 1 AS a, 0 AS b FROM p UNION ALL SELECT run_name, s_body_words, 0, 1 FROM p),
counts AS (SELECT run_name, v, sum(a) AS a, sum(b) AS b FROM long GROUP BY 1, 2),
gaps AS (SELECT run_name, sum(a) OVER w AS ta, abs(sum(a) OVER c / sum(a) OVER w - sum(b) OVER c / sum(b) OVER w) AS gap FROM counts WINDOW w AS (PARTITION BY run_name), c AS (PARTITION BY run_name ORDER BY v)),
dist AS (SELECT run_name, max(gap) AS d, max(ta) AS k FROM gaps GROUP BY 1),
dist2 AS (SELECT run_name, round(d, 6) AS ks, sqrt(k / 2) * d AS z FROM dist)
SELECT one.*, spearman, ks, round(CASE WHEN z < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * i * i * z * z))))) END, 6) AS ks_p
FROM one JOIN rho USING (run_name) JOIN dist2 USING (run_name)
"""

_YES = lambda c: F.when(F.lower(F.btrim(c)).startswith("y"), True).when(F.lower(F.btrim(c)).startswith("n"), False)
_SQL_YES = lambda c: f"CASE WHEN lower(trim({c})) LIKE 'y%' THEN true WHEN lower(trim({c})) LIKE 'n%' THEN false END"
_LABELS = ("original_identifier_left_yn", "intent_preserved_yn", "sender_signature_consistent_yn")


def _reviews(s: SparkSession, d: str) -> DataFrame:
    """Distinct reviews with labels of one spelling; a stray repeat of a row counts once."""
    return read_table(s, d, "review_sheet").select("syn_id", "reviewer", "realism_1to5", "format_realistic_1to5", *(_YES(F.col(c)).alias(c) for c in _LABELS)).distinct()


_SQL_REVIEWS = f"(SELECT DISTINCT syn_id, reviewer, realism_1to5, format_realistic_1to5, {', '.join(f'{_SQL_YES(c)} AS {c}' for c in _LABELS)} FROM review_sheet)"


def _two_reviewers(s: SparkSession, d: str) -> DataFrame:
    """One row for each message and two of its reviewers."""
    label = F.col("intent_preserved_yn")
    per = _reviews(s, d).groupBy("syn_id").agg(F.array_sort(F.collect_set(F.when(label.isNotNull(), F.struct("reviewer", label.alias("l"))))).alias("r"))  # a message has a handful of reviews
    return per.filter(F.size("r") >= 2).select("syn_id", F.get("r", F.lit(0))["l"].alias("a"), F.get("r", F.lit(1))["l"].alias("b"))


_VEC = lambda s, d: read_table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), "label")
_SQL_UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings)"
_SQL_NEAREST = f"""SELECT q.vec_id AS query, v.vec_id AS id, round(list_dot_product(q.u, v.u), 6) AS cosine, v.label = q.label AS hit, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.u, v.u), 6) DESC, v.vec_id) AS INTEGER) AS rank
FROM {_SQL_UNIT} q JOIN {_SQL_UNIT} v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id QUALIFY rank <= 5"""


def _nearest(s: SparkSession, d: str) -> DataFrame:
    v = _VEC(s, d)
    labels = v.select("id", "label")
    found = evaluate.nearest(v, v.filter("id % 50 = 0"), 5)
    return found.join(labels, "id").join(labels.select(F.col("id").alias("query"), F.col("label").alias("wanted")), "query").select("query", "id", "cosine", (F.col("label") == F.col("wanted")).alias("hit"), "rank")


def _names(s: SparkSession, d: str) -> DataFrame:
    """Full names of two words of the corpus's senders, in lower case."""
    words = F.split(F.lower(identity.clean_name(F.col("x_from"))), " ")
    return _emails(s, d).filter("x_from <> ''").select(F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1)).alias("name"), F.size(words).alias("n")).filter("n = 2").select("name").distinct()


def _privacy(s: SparkSession, d: str) -> DataFrame:
    """Per derived message: what of its source's people and addresses is left, copying, markers, the corpus's people, placeholders."""
    empty = F.array().cast("array<string>")
    named = F.when(F.col("x_from").rlike(r"^\p{L}+ \p{L}+$"), F.array(F.lower("x_from"))).otherwise(empty)
    terms = F.concat(named, F.array(F.coalesce("from_addr", F.lit(""))), F.coalesce("to_addrs", empty))
    source = _sources(s, d).select("file", F.concat_ws(" ", "body", "trailer").alias("source"), terms.alias("terms"))
    own = F.concat_ws(" ", *(F.col("headers")[k] for k in ("From", "To", "Cc")))
    pairs = _synthetic(s, d).select("syn_id", "run_name", "file", "raw", F.concat_ws(" ", "body", "quoted").alias("derived"), own.alias("own")).join(source, "file").drop("file")
    rows = evaluate.privacy(pairs, "syn_id", _names(s, d), evaluate.markers(COMPANY, INTERNAL))
    return rows.select("syn_id", "run_name", F.size("leaks").alias("n_leaks"), "copy8", F.array_join("markers", ",").alias("markers"), F.col("n_names").cast("long").alias("n_names"), "any_leak", "placeholder_left")


def _sql_grams(x: str) -> str:
    t = f"regexp_extract_all(lower({x}), '[a-z0-9'']+')"
    return f"list_distinct(list_transform(range(1, len({t}) - 6), lambda i: array_to_string({t}[i:i + 7], ' ')))"


_SQL_MARKERS = ", ".join(f"CASE WHEN regexp_matches(coalesce(raw, ''), {sql.re2(p)}) THEN '{k}' END" for k, p in evaluate.markers(COMPANY, INTERNAL).items())
_PRIVACY = f"""
WITH j AS (SELECT s.syn_id, s.run_name, s.raw, concat_ws(' ', s.body, s.quoted) AS d, concat_ws(' ', p.body, p.trailer) AS o, lower(concat_ws(' ', s.headers['From'], s.headers['To'], s.headers['Cc'])) AS own,
  list_distinct(list_transform(list_filter(list_concat(CASE WHEN regexp_matches(p.x_from, '^\\p{{L}}+ \\p{{L}}+$') THEN [p.x_from] ELSE [] END, [coalesce(p.from_addr, '')], p.to_addrs), lambda t: t <> ''), lambda t: lower(t))) AS terms FROM synthetic_emails s JOIN {_SQL_SOURCES} p USING (file) WHERE s.error IS NULL),
n AS (SELECT DISTINCT lower(x_from) AS name FROM parsed_emails WHERE regexp_matches(x_from, '^\\p{{L}}+ \\p{{L}}+$')),
w AS (SELECT syn_id, own, regexp_extract_all(lower(raw), '\\p{{L}}+') AS w FROM j),
h AS (SELECT DISTINCT syn_id, own, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name FROM w),
k AS (SELECT syn_id, count(*) AS n_names FROM h JOIN n USING (name) WHERE len(list_filter(string_split(name, ' '), lambda t: NOT list_contains(regexp_extract_all(own, '[a-z0-9'']+'), t))) > 0 GROUP BY 1),
g AS (SELECT *, {_sql_grams("d")} AS gd, {_sql_grams("o")} AS g_o, CAST(len(list_filter(terms, lambda t: regexp_matches(lower(raw), '(^|[^a-z0-9])' || regexp_escape(t) || '($|[^a-z0-9])'))) AS INTEGER) AS n_leaks, array_to_string(list_filter([{_SQL_MARKERS}], lambda x: x IS NOT NULL), ',') AS markers FROM j)
SELECT syn_id, run_name, n_leaks, round(len(list_intersect(gd, g_o)) / greatest(len(gd), 1), 6) AS copy8, markers, coalesce(n_names, 0) AS n_names, n_leaks > 0 OR markers <> '' OR coalesce(n_names, 0) > 0 AS any_leak, regexp_matches(raw, '\\[(?:COMPANY|ORG_[0-9]+|LOC_[0-9]+|UNIT_[0-9]+)\\]') AS placeholder_left FROM g LEFT JOIN k USING (syn_id)
"""


def _run_report(s: SparkSession, d: str) -> DataFrame:
    p = _privacy(s, d)
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return p.groupBy("run_name").agg(
        F.count("*").alias("n"), rate(F.col("n_leaks") > 0).alias("leak_rate"), rate(F.col("markers") != "").alias("marker_rate"), rate(F.col("n_names") > 0).alias("name_rate"), rate(F.col("any_leak")).alias("any_leak_rate"), rate(F.col("placeholder_left")).alias("placeholder_rate"),
        F.round(F.avg("copy8"), 6).alias("mean_copy8"), rate(F.col("copy8") > 0.10).alias("copied_rate"), F.round(F.percentile("copy8", F.lit(0.95)), 6).alias("p95_copy8"),
    )


_RUN_REPORT = f"WITH p AS ({_PRIVACY}) SELECT run_name, count(*) AS n, round(avg(CAST(n_leaks > 0 AS INTEGER)), 6) AS leak_rate, round(avg(CAST(markers <> '' AS INTEGER)), 6) AS marker_rate, round(avg(CAST(n_names > 0 AS INTEGER)), 6) AS name_rate, round(avg(CAST(any_leak AS INTEGER)), 6) AS any_leak_rate, round(avg(CAST(placeholder_left AS INTEGER)), 6) AS placeholder_rate, round(avg(copy8), 6) AS mean_copy8, round(avg(CAST(copy8 > 0.10 AS INTEGER)), 6) AS copied_rate, round(quantile_cont(copy8, 0.95), 6) AS p95_copy8 FROM p GROUP BY 1"
_AGREED = ("has_greeting_agree", "has_signoff_agree", "has_trailer_agree", "mentions_attachment_agree")


def _arm_report(s: SparkSession, d: str) -> DataFrame:
    """One row for each arm: privacy, structure, cost and realism, and beside them those of its styled run, if there is one."""
    reviews = _reviews(s, d).join(_synthetic(s, d).select("syn_id", "run_name"), "syn_id").groupBy("run_name").agg(F.round(F.avg("realism_1to5"), 6).alias("realism"))
    rows = _run_report(s, d).select("run_name", "n", "any_leak_rate", "mean_copy8").join(evaluate.fidelity(_pairs(s, d), "run_name").select("run_name", F.round(evaluate.macro_mean(*_AGREED), 6).alias("structure"), "spearman"), "run_name", "left").join(reviews, "run_name", "left").join(_attempts(s, d).select("run_name", "mean_attempts"), "run_name", "left")
    styled = rows.filter(F.endswith("run_name", F.lit("_styled"))).select(F.regexp_replace("run_name", "_styled$", "").alias("run_name"), *(F.col(c).alias(f"styled_{c}") for c in ("any_leak_rate", "mean_copy8", "structure")))
    return rows.filter(~F.endswith("run_name", F.lit("_styled"))).join(styled, "run_name", "left")


def _survivors(s: SparkSession, d: str) -> DataFrame:
    """People that a source names in its history and a derived message still has."""
    source = _sources(s, d).select("file", evaluate.source_names(F.concat_ws("\n", "body", "trailer")).alias("names")).filter(F.size("names") > 0)
    kept = _synthetic(s, d).select("syn_id", "file", F.concat_ws("\n", "body", "quoted").alias("text")).join(source, "file")
    return kept.select("syn_id", F.size("names").alias("n_names"), F.array_join(evaluate.survivors(F.col("names"), F.col("text"), F.array().cast("array<string>")), ",").alias("left"))


def _sql_named() -> str:
    t = "concat_ws(chr(10), body, trailer)"
    return "list_concat(" + ", ".join(f"list_transform(list_zip(regexp_extract_all({t}, {sql.re2(p)}, {a}), regexp_extract_all({t}, {sql.re2(p)}, {b})), lambda x: lower(x[1]) || '|' || lower(x[2]))" for p, a, b in evaluate._NAMED) + ")"


_SURVIVORS = f"""
WITH o AS (SELECT file, list_distinct(list_filter({_sql_named()}, lambda n: length(split_part(n, '|', 1)) >= 3 AND length(split_part(n, '|', 2)) >= 3)) AS names FROM {_SQL_SOURCES}),
j AS (SELECT syn_id, names, regexp_replace(lower(concat_ws(chr(10), s.body, s.quoted)), {sql.re2(r"(?U)\s+")}, ' ', 'g') AS t FROM synthetic_emails s JOIN o USING (file) WHERE error IS NULL AND len(names) > 0)
SELECT syn_id, CAST(len(names) AS INTEGER) AS n_names, array_to_string(list_sort(list_transform(list_filter(names, lambda n: regexp_matches(t, '(^|[^\\p{{L}}])' || regexp_escape(split_part(n, '|', 1)) || '(?: \\p{{L}}\\.?)? ' || regexp_escape(split_part(n, '|', 2)) || '($|[^\\p{{L}}])')), lambda n: replace(n, '|', ' '))), ',') AS left FROM j
"""


def _pair_cosine(s: SparkSession, d: str) -> DataFrame:
    """Vectors of even ids paired with the next one, by the label of the even one."""
    v = _VEC(s, d)
    even, odd = v.filter("id % 2 = 0").select((F.col("id") + 1).alias("other"), F.col("vector").alias("a"), "label"), v.select(F.col("id").alias("other"), F.col("vector").alias("b"))
    return evaluate.pair_similarity(even.join(odd, "other").select("label", "a", "b"), "label")


def letter_vectors(texts: list[str]) -> list[list[float]]:
    """Stand-in for a model that embeds: counts of the letters a to z."""
    return [[float(t.lower().count(chr(97 + k))) for k in range(26)] for t in texts]


def _embedded(s: SparkSession, d: str) -> DataFrame:
    """Vectors of the documents by the stand-in; a second time all come from the cache."""
    texts = read_table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    _, new = evaluate.embed(texts, s.createDataFrame([], "text_key string, vector array<double>"), letter_vectors)
    again, none = evaluate.embed(texts, new, letter_vectors)
    return again.crossJoin(F.broadcast(none.agg(F.count("*").alias("n_new")))).select(F.col("id").alias("doc_id"), "text_key", F.round(F.coalesce(F.get("vector", F.lit(4)), F.lit(0.0)), 6).alias("e"), "n_new")  # one row


_EMBEDDED = f"""
WITH c AS (SELECT doc_id, text, list_transform(range(26), lambda k: CAST(length(lower(text)) - length(replace(lower(text), chr(97 + CAST(k AS INTEGER)), '')) AS DOUBLE)) AS v FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha1(text) AS text_key, round(CASE WHEN list_sum(v) > 0 THEN v[5] / sqrt(list_sum(list_transform(v, lambda x: x * x))) ELSE 0 END, 6) AS e, 0 AS n_new FROM c
"""


def _attempts(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "synthetic_emails").groupBy("run_name").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.round(F.avg("meta.attempts"), 6).alias("mean_attempts"), F.round(F.avg(F.col("meta.trailer_truncated").cast("int")), 6).alias("truncated_rate"))


def _best_attempt(s: SparkSession, d: str) -> DataFrame:
    """Of all derived messages of a source, the one with fewest problems; ties by attempts, then id."""
    problems = F.size("meta.leaks_after") + F.col("raw").rlike(r"\[(?:COMPANY|ORG_\d+|LOC_\d+|UNIT_\d+)\]").cast("int") + (F.col("body") == "").cast("int")
    return _synthetic(s, d).select("file", F.struct(problems.alias("p"), F.col("meta.attempts").alias("a"), "syn_id").alias("x")).groupBy("file").agg(F.min("x").alias("x"), F.count("*").alias("n_attempts")).select("file", "n_attempts", F.col("x.syn_id").alias("syn_id"), F.col("x.p").alias("n_problems"))


def _cache_misses(s: SparkSession, d: str) -> DataFrame:
    """Messages whose prompt, their body, has no answer yet; the answers are those of the runs, keyed by the model and what was sent."""
    key = lambda c: rewrite.prompt_key(F.lit("writer"), F.coalesce(c, F.lit("")))
    answered = _synthetic(s, d).select("file").distinct().join(_sources(s, d).select("file", key(F.col("body")).alias("prompt_key")), "file")
    return _emails(s, d).select("email_id", key(F.col("body")).alias("prompt_key")).join(answered.select("prompt_key"), "prompt_key", "left_anti").select("email_id")


def _form_auc(s: SparkSession, d: str) -> DataFrame:
    """How well form alone tells derived messages from sources, for all runs together."""
    source = profile.form_features(_emails(s, d).withColumn("key", F.concat(F.lit("p"), F.col("email_id").cast("string"))), "key", "body", "trailer").withColumn("derived", F.lit(0))
    derived = profile.form_features(_synthetic(s, d).withColumn("key", F.concat(F.lit("s"), F.col("syn_id").cast("string"))), "key").withColumn("derived", F.lit(1))
    return evaluate.form_auc(source.unionByName(derived), "derived", "key").select(F.round("auc", 6).alias("auc"), F.round("spread", 6).alias("spread"), "n")


_ELIGIBLE = f"(SELECT * FROM ({PROFILE_SQL['email_features']}) WHERE body_words BETWEEN 8 AND 700 AND n_to > 0 AND date IS NOT NULL)"
_FIRST = f"SELECT email_id FROM parsed_emails QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY email_id) = 1"
_ORDER = "md5('{seed}|' || CAST({key} AS VARCHAR))"


def _dataset(s: SparkSession, d: str) -> DataFrame:
    """Eligible messages first, then one for each body: a rejected copy doesn't shadow an accepted one."""
    kept = sample.eligible(_features(s, d)).select("email_id")
    return dedup.first_wins(_emails(s, d).join(kept, "email_id"), dedup.body_key(F.col("body")), ["email_id"]).select("email_id", "file")


QUERIES = {
    "body_dedup": lambda s, d: dedup.first_wins(_emails(s, d).select("email_id", "body"), dedup.body_key(F.col("body")), ["email_id"]).select("email_id"),
    "dup_stats": lambda s, d: dedup.dup_stats(_emails(s, d), "message_id", "body"),
    "eligible_emails": lambda s, d: sample.eligible(_features(s, d)).select("email_id", "body_words"),
    "dataset_sources": _dataset,
    "hash_sample": lambda s, d: sample.hash_sample(_emails(s, d), F.col("email_id"), 0.1, 7).select("email_id"),
    "stratified_sample": lambda s, d: sample.stratified(sample.eligible(_features(s, d)).select("email_id", "folder_type", "has_trailer"), ["folder_type", "has_trailer"], F.col("email_id"), 20, 13),
    "stratum_sizes": lambda s, d: read_table(s, d, "eval_set").groupBy("grp", "has_trailer").agg(F.count("*").alias("n")),
    "review_sample": lambda s, d: sample.first_n(_synthetic(s, d), F.col("syn_id"), 30, 5).join(_sources(s, d).select("file", F.col("body").alias("source_body")), "file", "left").select("syn_id", "file", F.left("source_body", F.lit(900)).alias("source_excerpt"), F.left("raw", F.lit(1400)).alias("derived_excerpt")),
    "parse_messages": lambda s, d: parse.parse_messages(read_table(s, d, "raw_messages")).select("file", "message_id", "date", "from_addr", F.array_join("to_addrs", ",").alias("to_addrs"), F.array_join("cc_addrs", ",").alias("cc_addrs"), "subject", "x_from", "x_folder", F.length("raw_body").alias("raw_len"), F.length("body").alias("body_len")),
    "parse_exact": lambda s, d: parse.parse_exact(read_table(s, d, "raw_messages")).select("file", "message_id", "date", "from_addr", "subject", F.length("raw_body").alias("raw_len")),
    "split_trailer": lambda s, d: _emails(s, d).select("email_id", F.length(mail.split_trailer(F.regexp_replace("raw_body", "\r\n", "\n"))).alias("body_len"), F.length(mail.split_trailer(F.regexp_replace("raw_body", "\r\n", "\n"), "trailer")).alias("trailer_len")),
    "render_emails": lambda s, d: parse.render(_emails(s, d)),
    "copy_privacy": _privacy,
    "run_report": _run_report,
    "arm_report": _arm_report,
    "survivors": _survivors,
    "pair_cosine": _pair_cosine,
    "embedding_cache": _embedded,
    "run_attempts": _attempts,
    "best_attempt": _best_attempt,
    "cache_misses": _cache_misses,
    "distinct_1": lambda s, d: evaluate.distinct_n(_synthetic(s, d), "run_name", F.col("body"), 1),
    "distinct_2": lambda s, d: evaluate.distinct_n(_synthetic(s, d), "run_name", F.col("body"), 2),
    "run_fidelity": lambda s, d: evaluate.fidelity(_pairs(s, d), "run_name"),
    "review_summary": lambda s, d: _reviews(s, d).agg(F.count("*").alias("n"), F.round(F.avg("realism_1to5"), 6).alias("realism"), F.round(F.avg("format_realistic_1to5"), 6).alias("format_realism"), *(F.round(F.avg(F.col(c).cast("int")), 6).alias(c.removesuffix("_yn")) for c in _LABELS)),
    "label_agreement": lambda s, d: evaluate.agreement(_reviews(s, d), "intent_preserved_yn", "sender_signature_consistent_yn"),
    "reviewer_agreement": lambda s, d: evaluate.agreement(_two_reviewers(s, d), "a", "b"),
    "nearest_5": _nearest,
    "top1_top5": lambda s, d: _nearest(s, d).groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("hit").cast("int"))).alias("t1"), F.max(F.col("hit").cast("int")).alias("t5")).agg(F.count("*").alias("n"), F.round(F.avg("t1"), 6).alias("top1"), F.round(F.avg("t5"), 6).alias("top5")),
    "within_similarity": lambda s, d: evaluate.mean_similarity(_VEC(s, d), "label"),
    "company_counts": lambda s, d: profile.frequencies(_synthetic(s, d), F.col("company"), "company"),
    "form_auc": _form_auc,
}

def _scoped(mark: str) -> str:
    flags = "i" if "i" in mark[: mark.index(")")] else ""
    return f"(?{flags}:{sql.re2('(?U)' + mark[mark.index(')') + 1 :].replace('.*', '[^\\n]*').replace('.{', '[^\\n]{'))[1:-1]})" if flags else sql.re2("(?U)" + mark[mark.index(")") + 1 :].replace(".*", "[^\\n]*").replace(".{", "[^\\n]{"))[1:-1]


_SQL_MARKS = "'(?m)" + "|".join(_scoped(m) for m in mail.TRAILER_MARKS) + "'"
_SQL_BEFORE = "'(?ms)\\A(.*?)(?:" + "|".join(_scoped(m) for m in mail.TRAILER_MARKS) + ")'"
_SQL_HEAD = "split_part(m, chr(10) || chr(10), 1)"


def _sql_header(name: str) -> str:
    # RE2 has no look-ahead: folded lines are unfolded first.
    return f"trim(regexp_extract(h, '(?im)^{name}:[ \\t]*(.*)', 1), E' \\t')"


_SQL_LIST = "array_to_string(regexp_extract_all(lower({}), '[^\\s<>,;\"()]+@[^\\s<>,;\"()]+'), ',')"

SQL = {
    "body_dedup": _FIRST,
    "dup_stats": f"WITH k AS (SELECT md5(regexp_replace(coalesce(body, ''), {_BLANK}, ' ', 'g')) AS k, count(*) AS n FROM parsed_emails GROUP BY 1) SELECT (SELECT count(*) FROM parsed_emails) AS n_rows, (SELECT count(DISTINCT message_id) FROM parsed_emails) AS n_ids, count(*) AS n_bodies, round(1 - count(*) / sum(n), 6) AS duplicate_share, max(n) AS most_copies FROM k",
    "eligible_emails": f"SELECT email_id, body_words FROM {_ELIGIBLE}",
    "dataset_sources": f"SELECT p.email_id, p.file FROM parsed_emails p JOIN {_ELIGIBLE} e USING (email_id) QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY p.email_id) = 1",
    "hash_sample": f"SELECT email_id FROM parsed_emails WHERE CAST('0x' || left({_ORDER.format(seed=7, key='email_id')}, 8) AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT)",
    "stratified_sample": f"SELECT email_id, folder_type, has_trailer FROM {_ELIGIBLE} QUALIFY row_number() OVER (PARTITION BY folder_type, has_trailer ORDER BY {_ORDER.format(seed=13, key='email_id')}) <= 20",
    "stratum_sizes": "SELECT grp, has_trailer, count(*) AS n FROM eval_set GROUP BY 1, 2",
    "review_sample": f"WITH x AS (SELECT * FROM synthetic_emails WHERE error IS NULL ORDER BY {_ORDER.format(seed=5, key='syn_id')} LIMIT 30) SELECT syn_id, x.file, left(p.body, 900) AS source_excerpt, left(raw, 1400) AS derived_excerpt FROM x LEFT JOIN {_SQL_SOURCES} p ON p.file = x.file",
    "render_emails": "SELECT email_id, concat_ws(chr(10), 'From: ' || nullif(from_addr, ''), 'To: ' || nullif(array_to_string(to_addrs, ', '), ''), 'Cc: ' || nullif(array_to_string(cc_addrs, ', '), ''), 'Subject: ' || nullif(subject, ''), 'Date: ' || nullif(date, '')) || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), nullif(body, ''), nullif(trailer, '')) AS text FROM parsed_emails",
    "reviewer_agreement": f"WITH r AS (SELECT syn_id, list_sort(list_distinct(list({{'r': reviewer, 'l': intent_preserved_yn}}) FILTER (intent_preserved_yn IS NOT NULL))) AS r FROM {_SQL_REVIEWS} GROUP BY 1), p AS (SELECT r[1].l AS a, r[2].l AS b FROM r WHERE len(r) >= 2), t AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po, avg(CAST(a AS INTEGER)) * avg(CAST(b AS INTEGER)) + avg(CAST(NOT a AS INTEGER)) * avg(CAST(NOT b AS INTEGER)) AS pe FROM p) SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END, 6) AS kappa FROM t",
    "split_trailer": f"""
WITH t AS (SELECT email_id, replace(raw_body, chr(13) || chr(10), chr(10)) AS r FROM parsed_emails),
u AS (SELECT *, regexp_matches(r, {_SQL_MARKS}) AS hit, regexp_extract(r, {_SQL_BEFORE}, 1) AS pre FROM t)
SELECT email_id, CAST(length(regexp_replace(CASE WHEN hit THEN pre ELSE r END, {sql.re2(r"(?U)\s+$")}, '')) AS INTEGER) AS body_len, CAST(CASE WHEN hit THEN length(trim(substr(r, length(pre) + 1), chr(10))) ELSE 0 END AS INTEGER) AS trailer_len FROM u
""",
    "copy_privacy": _PRIVACY,
    "run_report": _RUN_REPORT,
    "arm_report": f"""
WITH r AS (SELECT rr.run_name, rr.n, any_leak_rate, mean_copy8, round((has_greeting_agree + has_signoff_agree + has_trailer_agree + mentions_attachment_agree) / 4, 6) AS structure, spearman, realism, mean_attempts FROM ({_RUN_REPORT}) rr LEFT JOIN ({_FIDELITY}) f USING (run_name)
  LEFT JOIN (SELECT run_name, round(avg(realism_1to5), 6) AS realism FROM {_SQL_REVIEWS} v JOIN synthetic_emails s USING (syn_id) WHERE error IS NULL GROUP BY 1) v USING (run_name) LEFT JOIN (SELECT run_name, round(avg(meta.attempts), 6) AS mean_attempts FROM synthetic_emails GROUP BY 1) a USING (run_name))
SELECT r.*, t.any_leak_rate AS styled_any_leak_rate, t.mean_copy8 AS styled_mean_copy8, t.structure AS styled_structure FROM r LEFT JOIN r t ON t.run_name = r.run_name || '_styled' WHERE NOT ends_with(r.run_name, '_styled')
""",
    "survivors": _SURVIVORS,
    "pair_cosine": f"WITH p AS (SELECT a.label, a.u AS a, b.u AS b FROM {_SQL_UNIT} a JOIN {_SQL_UNIT} b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1), q AS (SELECT label, count(*) AS n, avg(list_dot_product(a, b)) AS c FROM p GROUP BY 1), x AS (SELECT p.label, avg(list_dot_product(p.a, r.b)) AS c FROM p JOIN p r ON r.label = p.label GROUP BY 1) SELECT label, n, round(q.c, 6) AS pair_cosine, round(x.c, 6) AS random_cosine FROM q JOIN x USING (label)",
    "embedding_cache": _EMBEDDED,
    "run_attempts": "SELECT run_name, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS n_errors, round(avg(meta.attempts), 6) AS mean_attempts, round(avg(CAST(meta.trailer_truncated AS INTEGER)), 6) AS truncated_rate FROM synthetic_emails GROUP BY 1",
    "best_attempt": "WITH x AS (SELECT file, syn_id, meta.attempts AS a, CAST(len(meta.leaks_after) + CAST(regexp_matches(raw, '\\[(?:COMPANY|ORG_[0-9]+|LOC_[0-9]+|UNIT_[0-9]+)\\]') AS INTEGER) + CAST(body = '' AS INTEGER) AS INTEGER) AS n_problems FROM synthetic_emails WHERE error IS NULL) SELECT file, count(*) OVER (PARTITION BY file) AS n_attempts, syn_id, n_problems FROM x QUALIFY row_number() OVER (PARTITION BY file ORDER BY n_problems, a, syn_id) = 1",
    "cache_misses": f"SELECT email_id FROM parsed_emails WHERE coalesce(body, '') NOT IN (SELECT coalesce(body, '') FROM {_SQL_SOURCES} WHERE file IN (SELECT file FROM synthetic_emails WHERE error IS NULL))",
    **{f"distinct_{n}": f"WITH w AS (SELECT run_name, regexp_extract_all(lower(body), '[a-z0-9'']+') AS w FROM synthetic_emails WHERE error IS NULL), g AS (SELECT run_name, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM w) SELECT run_name, count(DISTINCT g) AS n_distinct, count(*) AS n_all, round(count(DISTINCT g) / count(*), 6) AS ratio FROM g GROUP BY 1" for n in (1, 2)},
    "run_fidelity": _FIDELITY,
    "review_summary": f"SELECT count(*) AS n, round(avg(realism_1to5), 6) AS realism, round(avg(format_realistic_1to5), 6) AS format_realism, {', '.join(f'round(avg(CAST({c} AS INTEGER)), 6) AS {c.removesuffix(chr(95) + chr(121) + chr(110))}' for c in _LABELS)} FROM {_SQL_REVIEWS}",
    "label_agreement": f"WITH r AS (SELECT intent_preserved_yn AS a, sender_signature_consistent_yn AS b FROM {_SQL_REVIEWS} WHERE a IS NOT NULL AND b IS NOT NULL), t AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po, avg(CAST(a AS INTEGER)) * avg(CAST(b AS INTEGER)) + avg(CAST(NOT a AS INTEGER)) * avg(CAST(NOT b AS INTEGER)) AS pe FROM r) SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END, 6) AS kappa FROM t",
    "nearest_5": _SQL_NEAREST,
    "top1_top5": f"WITH n AS ({_SQL_NEAREST}), q AS (SELECT query, max(CASE WHEN rank = 1 THEN CAST(hit AS INTEGER) END) AS t1, max(CAST(hit AS INTEGER)) AS t5 FROM n GROUP BY 1) SELECT count(*) AS n, round(avg(t1), 6) AS top1, round(avg(t5), 6) AS top5 FROM q",
    "within_similarity": f"SELECT a.label, (SELECT count(*) FROM embeddings e WHERE e.label = a.label) AS n, round(avg(list_dot_product(a.u, b.u)), 6) AS mean_cosine FROM {_SQL_UNIT} a JOIN {_SQL_UNIT} b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1",
    "company_counts": "SELECT company, count(*) AS n FROM synthetic_emails WHERE error IS NULL AND company IS NOT NULL GROUP BY 1",
    "parse_messages": f"""
WITH u AS (SELECT file, regexp_replace(coalesce(message, ''), '\\r\\n?', chr(10), 'g') AS m FROM raw_messages),
p AS (SELECT file, regexp_replace({_SQL_HEAD}, '\\n[ \\t]+', ' ', 'g') AS h, CASE WHEN contains(m, chr(10) || chr(10)) THEN substr(m, strpos(m, chr(10) || chr(10)) + 2) ELSE '' END AS r FROM u),
q AS (SELECT *, {_sql_header("Date")} AS dt FROM p),
v AS (SELECT *, regexp_matches(dt, '^(?:\\w{{3}},?\\s+)?\\d{{1,2}}\\s+\\w{{3}}\\s+\\d{{4}}\\s+\\d{{2}}:\\d{{2}}(?::\\d{{2}})?\\s+[+-]\\d{{4}}') AS ok, regexp_replace(dt, '^\\w{{3}},?\\s+', '') AS d0 FROM q),
w AS (SELECT *, CASE WHEN ok THEN coalesce(try_strptime(regexp_extract(d0, '^(.*?)\\s+[+-]\\d{{4}}', 1), '%d %b %Y %H:%M:%S'), try_strptime(regexp_extract(d0, '^(.*?)\\s+[+-]\\d{{4}}', 1), '%d %b %Y %H:%M')) END AS ts FROM v)
SELECT w.file, {_sql_header("Message-ID")} AS message_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || regexp_extract(d0, '([+-]\\d{{2}})\\d{{2}}', 1) || ':' || regexp_extract(d0, '[+-]\\d{{2}}(\\d{{2}})', 1) AS date,
  coalesce(regexp_extract_all(lower({_sql_header("From")}), '[^\\s<>,;\"()]+@[^\\s<>,;\"()]+')[1], '') AS from_addr, {_SQL_LIST.format(_sql_header("To"))} AS to_addrs, {_SQL_LIST.format(_sql_header("Cc"))} AS cc_addrs,
  {_sql_header("Subject")} AS subject, {_sql_header("X-From")} AS x_from, {_sql_header("X-Folder")} AS x_folder, CAST(length(r) AS INTEGER) AS raw_len, CAST(length(e.body) AS INTEGER) AS body_len
FROM w LEFT JOIN (SELECT file, any_value(body) AS body FROM parsed_emails GROUP BY 1) e USING (file)
""",
}
SQL["parse_exact"] = f"SELECT file, message_id, date, from_addr, regexp_replace(subject, '\\s+', ' ', 'g') AS subject, raw_len FROM ({SQL['parse_messages']})"
