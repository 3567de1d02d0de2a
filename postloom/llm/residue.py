"""Template residue, filler text, error pages and script notices (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Words in delimiters that are markup or a remark of the writer, not a slot to fill.
_NO_SLOT = r"(?i:html|head|title|body|meta|link|style|script|noscript|div|span|font|table|thead|tbody|tr|td|th|p|br|hr|h[1-6]|a|b|i|u|s|em|strong|small|big|center|pre|code|tt|ul|ol|li|dl|dt|dd|img|form|input|blockquote|sub|sup|g|bg|vbg|grin|smile|wink|sigh|snip|laugh|chuckle|lol|omitted|quote|unquote|end|begin|start|stop)"
#: An identifier, or up to four words as they stand in a slot; one that is written with underscores.
_NAMED = r"\p{L}[\p{L}\p{N}]*(?:[ _.-][\p{L}\p{N}]+){0,3}"
_JOINED = r"\p{L}[\p{L}\p{N}]*(?:_[\p{L}\p{N}]+)+"
#: Forms of unfilled placeholders, words between a delimiter and its counterpart. Each becomes the word "slotmark".
SLOTS = (
    r"\{\{[^{}\n]{1,40}\}\}",
    r"[$#]\{[^{}\n]{1,40}\}",
    r"\{%[^%{}\n]{1,40}%\}",
    r"\{[\p{L}\p{N}_. -]{1,30}\}",
    r"<<[^<>\n]{1,40}>>",
    r"<%[^%<>\n]{1,40}%>",
    r"<\p{L}+(?:[_ ]\p{L}+)+>",
    rf"<(?!{_NO_SLOT}>)\p{{L}}[\p{{L}}\p{{N}}_]*>",
    rf"(?<twice>[@%#$^&|:])\k<twice>{{1,3}} ?{_NAMED} ?\k<twice>{{2,4}}",
    rf"(?<emphatic>[*=~+!_-])\k<emphatic>{{1,3}}{_JOINED}\k<emphatic>{{2,4}}",
    r"(?<![\p{L}\p{N}@%#$])(?<once>[@%#$])\p{Lu}{2,}(?:_[\p{Lu}\p{N}]+)*\k<once>(?![\p{L}\p{N}@%#$])",
    r"\*\|[^|*\n]{1,40}\|\*",
    r"%\([\p{L}_]+\)s",
    r"(?<![\p{L}\p{N}%])%s(?![\p{L}\p{N}])",
    r"__\p{Lu}[\p{Lu}_]*__",
    rf"\[\[ ?{_NAMED} ?\]\]",
    r"\(\(\p{L}[\p{L}\p{N}_]*\)\)",
    rf"«{_JOINED}»",
    rf"\[{_JOINED}\]",
    r"\[\p{Lu}{2,}(?:_\p{Lu}+)*(?:_[0-9]+)?\]",
    r"\[(?i:your|insert|enter|add|tbd|to be|recipient|sender|customer|client|first|last|company)\b[^\]\n]{0,40}\]",
    r"\[(?i:(?:full |first |last |your |user )?name|date|company|address|job title|title|subject|phone|e-?mail|amount|city|signature|position|department)\]",
    r"(?<![\p{L}\p{N}|])\|\p{Lu}{3,}(?:_\p{Lu}+)*\|(?![\p{L}\p{N}|])",
    r"\b[Xx]{3,}(?:-[Xx]{3,})+\b",
)

#: Labelled exemplars of residue, by kind.
EXEMPLARS = {
    "placeholder": ("slotmark",),
    "filler": (
        "Lorem ipsum dolor sit amet",
        "consectetur adipiscing elit sed do eiusmod tempor",
        "dolor sit amet magna aliqua",
        "ut enim ad minim veniam quis nostrud",
        "duis aute irure dolor in reprehenderit",
        "excepteur sint occaecat cupidatat non proident",
        "sed ut perspiciatis unde omnis iste natus",
        "at vero eos et accusamus et iusto odio",
        "pellentesque habitant morbi tristique senectus et netus",
        "vestibulum ante ipsum primis in faucibus",
        "curabitur pretium tincidunt lacus nulla gravida orci",
        "the quick brown fox jumps over the lazy dog",
        "this is placeholder text please replace it",
        "this is sample text to be replaced",
        "sample text to be replaced by the real message",
        "replace this text with your own",
        "body text goes here",
        "your text goes here",
        "insert text here",
        "TODO write e-mail body",
        "TODO write this section",
        "blah blah blah blah",
        "more words to follow here",
        "asdf asdf qwer asdf",
        "test test 123 test",
        "xxx xxxxx xx xxxx xxxxxx",
    ),
    "error page": (
        "404 not found",
        "the requested URL was not found on this server",
        "403 forbidden",
        "500 internal server error",
        "internal server error the administrator has been informed",
        "502 bad gateway",
        "503 service temporarily unavailable",
        "504 gateway timeout",
        "service temporarily unavailable try again in 30 seconds",
        "access denied you do not have permission",
        "you do not have permission to view this resource",
        "your session has expired please sign in again",
        "sign in again to read this message",
        "the page you are looking for might have been removed",
        "might have been removed or had its name changed",
        "html head title request blocked title head body",
        "error code 429 message rate limit reached",
        "traceback most recent call last line 12 in",
        "timeouterror no answer after 30 ms",
        "too many requests please try again later",
        "the page you were looking for doesn't exist",
        "the page you were looking for does not exist",
        "sorry the page you requested could not be found",
        "we are currently undergoing scheduled maintenance please check back soon",
        "this site is down for maintenance please check back later",
        "fatal error uncaught exception thrown in on line 0",
        "warning undefined variable in on line 0",
        "an unexpected error has occurred please contact the administrator",
        "bad request your browser sent a request that this server could not understand",
        "this page isn't working right now",
        "database error unable to connect to the database server",
        "this site can't be reached",
    ),
    "script notice": (
        "please enable javascript to view this page",
        "javascript is disabled",
        "checking your browser before access",
        "you need cookies and javascript enabled to continue",
        "this application requires scripts to be turned on in your browser",
        "your browser does not support scripting some content can not be shown",
        "noscript your browser does not support",
        "please turn on javascript and reload the page",
        "we've detected that javascript is disabled in this browser",
        "please verify you are a human to continue",
        "your browser is out of date update it to view this site",
        "you need to enable javascript to run this app",
    ),
}

_WORD = r"([\p{L}\p{N}']+)"


def _words(c: Column) -> Column:
    """Words in lower case; placeholders, numbers and runs of x are one word each."""
    marked = F.regexp_replace(c, "|".join(SLOTS), " slotmark ")
    return F.transform(F.regexp_extract_all(F.lower(marked), F.lit(_WORD), F.lit(1)), lambda w: F.when(w.rlike("^[0-9]+$"), "0").when(w.rlike("^x{2,}$"), "xx").otherwise(w))


def _terms(words: Column) -> Column:
    """(words, pairs of neighbouring words)."""
    return F.struct(words.alias("words"), F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda x, i: F.concat_ws(" ", F.get(words, i), x)).alias("pairs"))


def find_residue(records: DataFrame, id_col: str, fields: tuple[str, ...], exemplars: dict[str, tuple[str, ...]] = EXEMPLARS, window: int = 32, least: float = 0.8) -> DataFrame:
    """(id, field, kind, exemplar, containment): for each field with residue its best exemplar.

    The exemplars' terms (words and pairs of neighbouring words) form an inverted index. Terms of a field that stand in the index retrieve exemplars for
    each window of ``window`` words, laid every half window; the containment is the share of the exemplar's TF-IDF weight that the window
    holds, with document frequencies counted over all fields of all records. Exemplars have at most half a window of words, so each lies
    whole in some window. A field counts from a containment of ``least``.

    An exemplar of several words has at least as much weight in pairs as in all of its words but the lightest, as a pair is as rare as either word;
    so without a pair its containment is 2/3 at most, and above that only windows with a pair are looked at.

    Placeholders are decided by the patterns of ``SLOTS`` alone: each becomes one word, the whole exemplar of its kind.

    Null and empty fields have no residue. Repeated ids are taken together. Only terms of the index leave their task.
    """
    spark = records.sparkSession
    listed = [(k, i, e) for i, (k, e) in enumerate((k, e) for k, es in exemplars.items() for e in es)]
    split = spark.createDataFrame(listed, "kind string, exemplar int, text string").select("kind", "exemplar", _words(F.col("text")).alias("words")).select("kind", "exemplar", F.array_distinct("words").alias("words"), F.array_distinct(_terms(F.col("words"))["pairs"]).alias("pairs")).collect()  # small
    index = spark.createDataFrame([(r["kind"], r["exemplar"], t) for r in split for t in (*r["words"], *r["pairs"])], "kind string, exemplar int, term string")
    literal = lambda terms: F.array(*map(F.lit, sorted(terms))).cast("array<string>")
    words, pairs = literal({t for r in split for t in r["words"]}), literal({t for r in split for t in r["pairs"]})
    telling = literal({t for r in split for t in (r["pairs"] or r["words"] if least > 2 / 3 else (*r["words"], *r["pairs"]))})  # each window must hold one
    half = window // 2
    ids = F.col(id_col).cast("long")
    long = records.select(ids.alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("f")).select("id", "f.field", "f.text").filter("id is not null and text is not null and text <> ''")

    def held(terms: Column) -> Column:
        # (window, terms) of the windows that hold a telling term.
        laid = F.transform(F.sequence(F.lit(-1), F.floor(F.size(terms["words"]) / half).cast("int")), lambda k: F.struct(k.alias("window"), *(F.slice(terms[x], F.greatest(k * half, F.lit(0)) + 1, F.when(k < 0, half).otherwise(window)).alias(x) for x in ("words", "pairs"))))
        return F.transform(F.filter(laid, lambda w: F.arrays_overlap(w["pairs"], telling) | F.arrays_overlap(w["words"], telling)), lambda w: F.struct(w["window"].alias("window"), indexed(w).alias("terms")))

    indexed = lambda terms: F.concat(F.array_intersect(terms["words"], words), F.array_intersect(terms["pairs"], pairs))
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    # explode_outer, as the filter inferred for explode would do all the work twice. One shuffle of whole windows serves all steps up to the scores.
    rows = lambda f: long.select("id", "field", F.explode_outer(once(_words(F.col("text")), lambda w: once(_terms(w), f))).alias("x")).filter("x is not null")
    windows = rows(held).select("id", "field", "x.window", "x.terms").repartition("id", "field", "window").select("id", "field", "window", F.explode("terms").alias("term")).distinct()
    n = long.agg(F.count("*").alias("n"))
    frequency = rows(indexed).select("id", "field", F.col("x").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    weights = index.join(frequency, "term", "left").join(F.broadcast(n)).select("kind", "exemplar", "term", F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)).alias("w"))  # n is one row
    whole = weights.groupBy("exemplar").agg((F.sum("w") + 1e-9).alias("whole"))
    scored = windows.join(F.broadcast(weights), "term").groupBy("id", "field", "window", "kind", "exemplar").agg((F.sum("w") + 1e-9).alias("held")).join(F.broadcast(whole), "exemplar").withColumn("containment", F.col("held") / F.col("whole"))
    best = scored.filter(F.col("containment") >= least).groupBy("id", "field").agg(F.max_by(F.struct("kind", "exemplar"), F.struct("containment", F.negative("exemplar"))).alias("best"), F.max("containment").alias("containment"))
    return best.select("id", "field", "best.kind", "best.exemplar", F.round("containment", 6).alias("containment"))


def exclude_residue(records: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """The records without residue in any of the fields."""
    return records.join(find_residue(records, id_col, fields).select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
