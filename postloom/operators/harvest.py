"""Finding people's names in text by headers, capitals, and word frequencies."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, functions as F

from postloom.operators.identity import name_from_address

#: Names of months and days, in English: never parts of people's names.
CALENDAR = tuple(sorted({x.lower() for x in (*calendar.month_name, *calendar.day_name) if x}))
#: Logarithm of the number in a billion words from which a word in lower case is a common one.
COMMON = 3.3
#: An address in angle brackets, and what stands before it on its line, from a delimiter on.
_ADDRESSED = r"(?<![^<>\n,;:\"@])([^<>\n,;:\"@]++)\"?[ \t]*<[ \t]*([^<>@\s]+@[^<>@\s]+)[ \t]*>"


def word_frequencies(texts: DataFrame) -> DataFrame:
    """(word, n, zipf, n_small) of ``texts(text)``: words in lower case, counts, the logarithm of their number in a billion words, and how often they stand in lower case. Counted over all rows with map-side partial sums."""
    words = texts.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n")).groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.lower("w") == F.col("w"), F.col("n")).otherwise(0)).alias("n_small"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("word", "n", F.round(F.log10(F.col("n") / F.col("total") * 1e9), 4).alias("zipf"), "n_small")  # total is one row


def given_names(addresses: DataFrame, least: int = 3) -> DataFrame:
    """(first, n_last): first parts of ``addresses(address)`` that spell names, which go with at least ``least`` last parts."""
    name = F.lower(name_from_address(F.col("address")))
    parts = addresses.select(F.split(name, " ").alias("p")).filter(F.size("p") == 2)
    return parts.groupBy(F.get("p", F.lit(0)).alias("first")).agg(F.count_distinct(F.get("p", F.lit(1))).alias("n_last")).filter(F.col("n_last") >= least)


def address_pairs(docs: DataFrame) -> DataFrame:
    """(doc, name, address): names of up to four capitalised words written before their address in angle brackets in ``docs(doc, text)``."""
    text = F.coalesce("text", F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(_ADDRESSED), F.lit(1)).alias("before"), F.regexp_extract_all(text, F.lit(_ADDRESSED), F.lit(2)).alias("address"))
    # Of what stands before, the capitalised words at its end.
    rows = docs.filter(F.contains(text, F.lit("<"))).select("doc", F.explode(found).alias("x")).select("doc", F.regexp_extract("x.before", r"((?:\p{Lu}[\p{L}.'-]*[ \t]+){0,3}\p{Lu}[\p{L}.'-]*)[ \t]*$", 1).alias("name"), F.lower("x.address").alias("address"))
    return rows.filter(F.length("name") >= 3).distinct()


def header_line_names(docs: DataFrame) -> DataFrame:
    """(doc, name): names in From, To, Cc and Sent-by lines inside texts, in the forms "First Last" and "Last, First".

    Lists are cut at semicolons, and at commas where the names carry routes; what follows a slash, a bracket or an @ is left out. A list goes on in lines that hold routes.
    """
    text = F.coalesce("text", F.lit(""))
    heads = F.regexp_extract_all(text, F.lit(r"(?im)^[ \t>|]*(?:From|To|Cc|Bcc|Sent by|Forwarded by)[ \t]*:?[ \t]*([^\n]+(?:\n(?![ \t>|]*[A-Za-z-]+[ \t]*:)[^\n]*/[^\n]*)*)"), F.lit(1))
    forwarded = F.regexp_extract_all(text, F.lit(r"(?i)-{3,}[ \t]*Forwarded by ([^\n]+?) on [0-9]"), F.lit(1))
    lists = F.transform(F.concat(heads, forwarded), lambda x: F.regexp_replace(x, r"\s+", " "))
    parts = F.flatten(F.transform(lists, lambda x: F.split(x, F.when(x.rlike(r"/[^,;]*,"), F.lit("[;,]")).otherwise(F.lit(";")))))
    bare = lambda x: F.btrim(F.regexp_replace(x, r"[/@\[(<].*$", ""), F.lit(" \t\"'"))
    rows = docs.select("doc", F.explode(F.transform(parts, bare)).alias("name"))
    word = r"\p{Lu}[\p{L}'.-]*"
    named = F.col("name").rlike(rf"^(?:{word} ){{1,3}}\p{{Lu}}[\p{{L}}'-]+$") | F.col("name").rlike(rf"^\p{{Lu}}[\p{{L}}'-]+, {word}(?: \p{{Lu}}\.?)?$")
    return rows.filter(named).distinct()


def _bigrams(docs: DataFrame, pattern: str) -> DataFrame:
    """Overlapping pairs of neighbouring words, single line ends taken as blanks: the second word is only looked at, so it can begin the next pair."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]*(?<!\n)\n(?!\n)[ \t>|]*", " "), r"[ \t]{2,}", " ")
    based = docs.select("doc", flat.alias("t"))
    pairs = F.arrays_zip(F.regexp_extract_all("t", F.lit(pattern), F.lit(1)).alias("first"), F.regexp_extract_all("t", F.lit(pattern), F.lit(2)).alias("last"))
    return based.select("doc", F.explode(pairs).alias("x")).select("doc", "x.first", "x.last")


def capitalised_names(docs: DataFrame, given: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(doc, name): "First Last" in capitals where the first word is a known given name and the last one no ordinary word.

    A word is ordinary if the corpus has it in lower case more often than otherwise (see ``word_frequencies``); names of months and days are too.
    """
    pairs = _bigrams(docs, r"(?<![\p{L}\p{N}_])(\p{Lu}\p{Ll}{2,})(?: \p{Lu}\.)? (?=(\p{Lu}\p{Ll}{2,})(?![\p{L}\p{N}_]))")
    kept = pairs.withColumn("key", F.lower("first")).withColumn("low", F.lower("last")).filter(~F.col("key").isin(*CALENDAR) & ~F.col("low").isin(*CALENDAR))
    known = kept.join(given.select(F.col("first").alias("key")).distinct(), "key", "left_semi")
    ordinary = frequencies.filter(F.col("n_small") * 2 > F.col("n")).select(F.col("word").alias("low"))
    return known.join(ordinary, "low", "left_anti").select("doc", F.concat_ws(" ", "first", "last").alias("name")).distinct()


def lowercase_names(docs: DataFrame, given: DataFrame, frequencies: DataFrame, most_given: float = 5.2, most_last: float = COMMON) -> DataFrame:
    """(doc, name): pairs of lower-case words where the first is a given name that isn't a common word and the second is rare."""
    pairs = _bigrams(docs, r"(?<![\p{L}\p{N}_'])(\p{Ll}{3,}) (?=(\p{Ll}{3,})(?![\p{L}\p{N}_]))").filter(~F.col("first").isin(*CALENDAR) & ~F.col("last").isin(*CALENDAR) & (F.length("first") >= 4))
    known = pairs.join(given.select("first").distinct(), "first", "left_semi")
    z = lambda c, name: frequencies.select(F.col("word").alias(c), F.col("zipf").alias(name))
    rated = known.join(z("first", "zf"), "first", "left").join(z("last", "zl"), "last", "left")
    return rated.filter((F.coalesce("zf", F.lit(0.0)) <= most_given) & (F.coalesce("zl", F.lit(0.0)) < most_last)).select("doc", F.initcap(F.concat_ws(" ", "first", "last")).alias("name")).distinct()


def paired_names(display: Column, addresses: Column) -> Column:
    """Names of the addresses: the display names if there are as many and none is empty, else what the addresses spell."""
    parts = F.transform(F.split(F.coalesce(display, F.lit("")), ";"), lambda x: F.btrim(x, F.lit(" \t\"'")))
    fits = (F.size(parts) == F.size(addresses)) & F.forall(parts, lambda x: x != "")
    return F.when(fits, parts).otherwise(F.transform(addresses, name_from_address))


def trim_words(c: Column, most: int) -> Column:
    """Whole lines from the start while they have at most ``most`` words together."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, line: Column) -> Column:
        words = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""))
        fits = a["on"] & (a["n"] + words <= most)
        return F.struct((a["n"] + F.when(fits, words).otherwise(0)).alias("n"), fits.alias("on"), F.when(fits, F.concat(a["out"], F.array(line))).otherwise(a["out"]).alias("out"))

    return F.array_join(F.aggregate(F.split(F.coalesce(c, F.lit("")), "\n"), empty, add)["out"], "\n")
