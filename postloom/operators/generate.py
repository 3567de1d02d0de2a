"""Derived messages from scrubbed ones: by rules alone, by a rewriter with checks and repair, or by a rewriter without any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postloom.functions import text as tx
from postloom.operators import identity, redact, rewrite, style, surrogates
from postloom.operators.parse import tagged
from postloom.operators.scrub import PLACEHOLDER
from postloom.plans.lineage import cut

MODES = ("rule", "hybrid", "direct")
_ASK = (
    "Write this business message anew for the firm {firm} ({industry}, {city}, {country}). Keep every person's name, number, date and address as it stands, keep the intent and the length of about {words} words, "
    "and put something that fits in place of each of these marks: {marks}. Don't break lines inside paragraphs. Answer with <subject>, <body> and <quoted>.{hint}\n"
    "<subject>{subject}</subject>\n<body>\n{body}\n</body>\n<quoted>\n{quoted}\n</quoted>"
)
_ASK_DIRECT = "Write a message like this one for the firm {firm} ({industry}, {country}), without naming anybody or anything of it. Answer with <subject> and <body>.\nFrom: {sender}\nSubject: {subject}\n\n{body}\n\n{quoted}"


def _filled(template: str, **values: Column) -> Column:
    """The template with its marks in braces replaced by columns."""
    parts, rest = [], template
    while rest:
        before, mark, after = rest.partition("{")
        parts.append(F.lit(before))
        if not mark:
            break
        name, _, rest = after.partition("}")
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def fill(c: Column, profile: Column, short: Column, units: Column) -> Column:
    """Placeholders with what a profile has for them: its short name, an invented firm or town, one of its units."""

    def value(tag: Column) -> Column:
        n = F.size(F.coalesce(units, F.array().cast("array<string>")))
        unit = F.when(n > 0, F.get(units, F.pmod(F.crc32(tag.cast("binary")), F.greatest(n, F.lit(1)).cast("long")).cast("int"))).otherwise(short)
        return F.when(tag == "[COMPANY]", short).when(tag.startswith("[ORG"), surrogates.org_name(profile, tag)).when(tag.startswith("[LOC"), surrogates.city_name(profile, tag)).otherwise(unit)

    return tx.rewrite_spans(c, PLACEHOLDER, value)


def force(c: Column, terms: Column, profile: Column, short: Column, city: Column, domain: Column, locale: Column, company_terms: tuple[str, ...] = ()) -> Column:
    """The text with every one of ``terms`` that is left replaced, longest first, case ignored: firms by the profile's, addresses, numbers and names by stand-ins of their kind."""
    longest = F.array_sort(terms, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))

    def stand_in(t: Column) -> Column:
        person = lambda pool, k: surrogates.pick(pool, F.sha2(F.concat_ws("|", profile, t), 256), k)
        first, last = person(identity.FIRST["u"], 0), person(identity.LAST, 1)
        firm = F.exists(F.array(*map(F.lit, company_terms)).cast("array<string>"), lambda x: t.startswith(x))
        return (
            F.when(firm, short)
            .when(F.contains(t, F.lit("@")), F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), domain))
            .when(t.rlike("^[0-9]+$"), surrogates.phone(profile, locale, t))
            .when(t.rlike(r"^\p{L}+ \p{L}+$"), F.concat_ws(" ", first, last))
            .when(t.rlike(r"^\p{L}+$"), last)
            .when(t.rlike(r"^[\w-]+(\.[\w-]+)+$"), surrogates.fake_domain(profile, t))
            .otherwise(surrogates.org_name(profile, t))
        )

    return F.aggregate(longest, c, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"(?i)(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])")), stand_in(t)))


def _people(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda p: F.format_string("%s <%s>", p["full"], p["email"])), ", ")


def assemble(df: DataFrame) -> DataFrame:
    """Adds ``headers`` and ``raw``, the RFC-822 text, from ``out_subject``, ``out_body``, ``out_quoted`` and the columns of ``scrub``; typography and layout are those of the source."""
    body, quoted = (style.restore(style.tidy(F.coalesce(F.col(c), F.lit(""))), F.col(s)) for c, s in (("out_body", "source_body"), ("out_quoted", "source_trailer")))
    laid = df.withColumns({"out_subject": style.ascii_typography(F.btrim(F.coalesce("out_subject", F.lit("")))), "out_body": body, "out_quoted": quoted})
    sender = F.when(F.col("sender").isNotNull(), F.format_string("%s <%s>", F.col("sender.full"), F.col("sender.email"))).otherwise(F.concat(F.lit("unknown@"), F.col("to_domain")))
    pairs = (
        ("Message-ID", identity.message_id(F.col("message_id"), F.col("to_domain"))),
        ("Date", identity.new_date(F.try_to_timestamp(F.left("date", F.lit(19))), F.col("shift_days"), F.col("to_tz"))),
        ("From", sender), ("To", _people(F.col("to_people"))), ("Cc", _people(F.col("cc_people"))), ("Subject", F.col("out_subject")),
    )
    listed = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(v, F.lit("")).alias("v")) for k, v in pairs)), lambda x: (x["v"] != "") | (x["k"] == "Subject"))
    head = F.array_join(F.transform("_listed", lambda x: F.concat_ws(": ", x["k"], x["v"])), "\n")
    charset = F.when(F.concat("_head", "out_body", "out_quoted").rlike(r"[^\x00-\x7F]"), "utf-8").otherwise("us-ascii")
    made = laid.withColumn("_listed", listed).withColumn("_head", head).withColumn("headers", F.map_from_entries("_listed"))
    full = F.concat("_head", F.lit("\nMime-Version: 1.0\nContent-Type: text/plain; charset="), charset, F.lit("\n\n"), "out_body", F.when(F.col("out_quoted").rlike(r"\S"), F.concat(F.lit("\n\n"), "out_quoted")).otherwise(""))
    return made.withColumn("raw", full).drop("_listed", "_head")


def _attempts(docs: DataFrame, cache: DataFrame, rewriter: rewrite.Rewriter | None, model: str, rounds: int, budget: float | None, cache_path: str | None) -> tuple[DataFrame, DataFrame]:
    """(chosen, new): per message the attempt with fewest problems, the earliest on ties. Only messages with problems are asked again, with these named."""
    docs = cut(docs)
    todo, done, fresh = docs.withColumn("hint", F.lit("")), None, None
    for k in range(1, rounds + 1):
        asked = todo.select(F.col("email_id").alias("id"), _filled(_ASK, firm=F.col("to_name"), industry=F.col("to_industry"), city=F.col("to_city"), country=F.col("to_country"), words=F.greatest(tx.word_count(F.col("source_body")), F.lit(1)), marks=F.array_join("placeholders", ", "), hint=F.col("hint"), subject=F.col("subject"), body=F.col("flat_body"), quoted=F.col("flat_trailer")).alias("prompt"))
        answers, new = rewrite.answer(asked, cache, rewriter, model, budget, cache_path=cache_path)
        cache = cache.select("prompt_key", "text", "cost", "model").unionByName(new)
        fresh = new if fresh is None else fresh.unionByName(new)
        parts = todo.join(answers.select(F.col("id").alias("email_id"), F.col("text").alias("answer")), "email_id").withColumns({"out_subject": tagged(F.col("answer"), "subject"), "out_body": tagged(F.col("answer"), "body"), "out_quoted": F.coalesce(tagged(F.col("answer"), "quoted"), F.lit(""))})
        whole = F.concat_ws("\n", "out_subject", "out_body", "out_quoted")
        checks = F.array_union(
            F.when(F.col("out_subject").isNull() | F.col("out_body").isNull(), F.array(F.lit("format"))).otherwise(F.array().cast("array<string>")),
            F.array_union(rewrite.problems(F.col("body"), F.col("out_body"), F.array().cast("array<string>"), F.col("sender.first"), F.col("keep_names"), (F.col("trailer"), F.concat_ws("\n", "out_subject", "out_quoted"))), F.array_compact(F.array(F.when(whole.rlike(PLACEHOLDER), "placeholder"), F.when(F.size(redact.leaks(whole, F.col("hard_terms"))) > 0, "leak"), F.when(F.col("trailer").rlike(r"\S") & ~F.col("out_quoted").rlike(r"\S"), "quoted")))),
        )
        checked = cut(parts.select("email_id", F.lit(k).alias("attempt"), F.coalesce("out_subject", "subject").alias("out_subject"), F.coalesce("out_body", F.lit("")).alias("out_body"), "out_quoted", F.array_sort(F.array_distinct(checks)).alias("problems")))
        done = checked if done is None else done.unionByName(checked)
        left = checked.filter(F.size("problems") > 0).select("email_id", F.concat(F.lit(" Your last answer had these faults: "), F.array_join("problems", ", "), F.lit(f" (attempt {k}).")).alias("hint"))
        if k == rounds or not left.limit(1).count():
            break
        todo = docs.join(left, "email_id")
    chosen = rewrite.best(done.withColumnRenamed("email_id", "id")).withColumnRenamed("id", "email_id")
    return docs.join(chosen, "email_id"), fresh


def generate(scrubbed: DataFrame, mode: str = "rule", rewriter: rewrite.Rewriter | None = None, cache: DataFrame | None = None, model: str = "stub", rounds: int = 3, budget: float | None = None, company_terms: tuple[str, ...] = (), cache_path: str | None = None) -> DataFrame:
    """One derived message (email_id, file, subject, body, quoted, raw, headers, company, meta) for each row of ``scrub``.

    ``rule`` fills the placeholders; ``hybrid`` has the scrubbed text rewritten, unwrapped, in up to ``rounds`` attempts of which the one with
    fewest problems is kept, and lays it out like the source; both end with every hard term that is left replaced by force. ``direct`` is a
    baseline: it sends the source itself, keeps no history, and repairs nothing. ``meta`` tells mode, model, attempts, leaks, whether something was forced, counts and sizes.

    Empty bodies stay empty in ``rule``; a rewriter's answer without tags leaves the scrubbed subject and an empty body. Rows with the same id must be equal.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    spark = scrubbed.sparkSession
    cache = rewrite.read_cache(spark, cache_path) if cache is None else cache
    none = F.array().cast("array<string>")
    if mode == "rule":
        filled = lambda c: fill(F.col(c), F.col("profile_id"), F.col("to_short"), F.col("to_sub_units"))
        made = scrubbed.withColumns({"out_subject": filled("subject"), "out_body": filled("body"), "out_quoted": filled("trailer"), "attempt": F.lit(0), "problems": none})
    elif mode == "direct":
        asked = scrubbed.select(F.col("email_id").alias("id"), _filled(_ASK_DIRECT, firm=F.col("to_name"), industry=F.col("to_industry"), country=F.col("to_country"), sender=F.col("sender.full"), subject=F.col("source_subject"), body=F.col("source_body"), quoted=F.col("source_trailer")).alias("prompt"))
        answers, _ = rewrite.answer(asked, cache, rewriter, model, budget, cache_path=cache_path)
        made = scrubbed.join(answers.select(F.col("id").alias("email_id"), F.col("text").alias("answer")), "email_id").withColumns({"out_subject": F.coalesce(tagged(F.col("answer"), "subject"), F.col("source_subject")), "out_body": F.coalesce(tagged(F.col("answer"), "body"), F.col("answer")), "out_quoted": F.lit(""), "attempt": F.lit(1), "problems": none})
    else:
        widths = scrubbed.withColumns({"body_width": style.wrap_width(F.col("source_body")), "trailer_width": style.wrap_width(F.col("source_trailer"))})
        flat = widths.withColumns({"flat_body": style.unwrap(F.col("body"), F.col("body_width")), "flat_trailer": style.unwrap(F.col("trailer"), F.col("trailer_width"))})
        chosen, _ = _attempts(flat, cache, rewriter, model, rounds, budget, cache_path)
        made = chosen.withColumns({"out_body": style.wrap(F.col("out_body"), F.col("body_width")), "out_quoted": style.wrap(F.col("out_quoted"), F.col("trailer_width"))})
    whole = F.concat_ws("\n", "out_subject", "out_body", "out_quoted")
    made = made.withColumn("left", redact.leaks(whole, F.col("hard_terms")))
    if mode != "direct":
        fixed = lambda c: F.when(F.size("left") > 0, force(F.col(c), F.col("left"), F.col("profile_id"), F.col("to_short"), F.col("to_city"), F.col("to_domain"), F.col("to_locale"), company_terms)).otherwise(F.col(c))
        made = made.withColumn("forced", F.size("left") > 0).withColumns({c: fixed(c) for c in ("out_subject", "out_body", "out_quoted")}).withColumn("left", redact.leaks(whole, F.col("hard_terms")))
    else:
        made = made.withColumn("forced", F.lit(False))
    made = made.withColumn("soft_left", redact.leaks(whole, F.col("soft_terms")))
    meta = F.struct(
        F.lit(mode).alias("mode"), (F.lit(None).cast("string") if mode == "rule" else F.lit(model)).alias("model"), F.col("attempt").alias("attempts"), F.col("left").alias("leaks_after"), F.col("soft_left").alias("soft_leaks_after"), F.col("forced").alias("forced_redaction"),
        F.col("problems"), F.col("counts").alias("scrub_counts"), "shift_days", tx.word_count(F.col("source_body")).alias("orig_words"), (F.length("trailer") < F.length("source_trailer") / 2).alias("trailer_truncated"), F.col("keep_names").alias("synthetic_people"),
    )
    return assemble(made).select("email_id", "file", F.col("out_subject").alias("subject"), F.col("out_body").alias("body"), F.col("out_quoted").alias("quoted"), "raw", "headers", F.col("profile_id").alias("company"), meta.alias("meta"))
