"""Conversations rebuilt from message rows (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postloom.llm.components import connected_components
from postloom.llm.dedup import collapse_copies
from postloom.plans.lineage import cut

#: Marks before the subject of replies and of forwarded messages, by language.
REPLY_MARKS = ("re", "aw", "antw", "antwort", "sv", "vs", "ref", "odp", "rif", "rép", "rep", "res", "ynt", "vá", "bls", "回复", "答复", "返信")
FORWARD_MARKS = ("fw", "fwd", "wg", "tr", "vb", "vl", "rv", "enc", "doorst", "pd", "i", "ilt", "továbbítás", "转发", "転送")

_COUNT = r"(?:\s*[\[(^]?\d{1,3}[\])]?)?"
_MARK = rf"(?:{'|'.join(REPLY_MARKS + FORWARD_MARKS)}){_COUNT}\s*[:：]"
_MARKS = rf"(?iu)^\s*(?:{_MARK}\s*)+"
_FORWARD = rf"(?iu)^\s*(?:(?:{'|'.join(REPLY_MARKS)}){_COUNT}\s*[:：]\s*)*(?:{'|'.join(FORWARD_MARKS)}){_COUNT}\s*[:：]"


def bare_subject(c: Column) -> Column:
    """The subject without marks, case and white space; null counts as empty."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), _MARKS, "")), r"(?U)\s+", "")


def subject_kind(c: Column) -> Column:
    """'opener', 'reply' or 'forward'."""
    s = F.coalesce(c, F.lit(""))
    return F.when(s.rlike(_FORWARD), "forward").when(s.rlike(_MARKS), "reply").otherwise("opener")


def _address(c: Column) -> Column:
    return F.lower(F.trim(c))


def _spread(df: DataFrame, *order: str) -> DataFrame:
    """Rows range-partitioned by ``order``, with the number of their range in ``part``: a group of any size spreads over several ranges."""
    return cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def number_turns(messages: DataFrame) -> DataFrame:
    """Adds ``turn_no``, counted from 1 within ``conv`` by (instant, id).

    Rows are numbered within each range; the ranges' counts, one row for each conversation in a range, give the offsets.
    """
    ranged = _spread(messages, "conv", "instant", "id")
    local = ranged.withColumn("local", F.row_number().over(Window.partitionBy("conv", "part").orderBy("instant", "id")))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("conv", "part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).filter("offset > 0").select("conv", "part", "offset")
    return local.join(offsets, ["conv", "part"], "left").withColumn("turn_no", (F.col("local") + F.coalesce("offset", F.lit(0))).cast("int")).drop("local", "offset", "part")


def find_links(messages: DataFrame) -> DataFrame:
    """(reply, opener): the opener that each reply belongs to.

    An opener is earlier, has the same bare subject, and its sender and recipients include all of the reply's; the latest one counts, on equal
    instants the larger id. For a reply without date any date will do. ``messages(id, kind, key, people, sender, instant)``.

    Both sides are first reduced to their distinct sets of people; a set of repliers meets the sets of openers that hold the rarest of its
    people, so a sender or recipient of very many messages brings no product of messages. The replies of a set, and the openers of all sets
    around it, are then walked together in order of time, range by range, with the last opener carried into the next range. So no pair of an
    opener and a reply is built, and a subject with any number of rows spreads over several tasks.
    """
    openers = messages.filter("kind = 'opener'").select("id", "key", F.col("people").alias("circle"), "instant")
    replies = messages.filter("kind = 'reply'").select("id", "key", F.col("people").alias("asked"), "instant")
    by_person = openers.select("key", "circle").distinct().select("key", "circle", F.explode("circle").alias("person"))
    counts = by_person.groupBy("key", "person").agg(F.count("*").alias("n"))
    members = replies.select("key", "asked").distinct().select("key", "asked", F.explode("asked").alias("person")).join(counts, ["key", "person"], "left")
    rarest = members.groupBy("key", "asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "person")).alias("r")).filter("r.n > 0")
    met = rarest.select("key", "asked", F.col("r.person").alias("person")).join(by_person, ["key", "person"]).filter(F.size(F.array_except("asked", "circle")) == 0).select("key", "asked", "circle")
    known = cut(openers.join(met, ["key", "circle"]).select("key", "asked", F.struct(F.col("instant").alias("at"), "id").alias("opener")))
    # In one order of time: openers before replies of the same instant only if they are earlier.
    events = replies.select("key", "asked", F.col("instant").alias("at"), F.lit(0).alias("is_opener"), "id", F.lit(None).cast("struct<at:timestamp,id:bigint>").alias("opener")).unionByName(known.select("key", "asked", F.col("opener.at").alias("at"), F.lit(1).alias("is_opener"), F.col("opener.id").alias("id"), "opener"))
    events = _spread(events.filter("at is not null").withColumn("asked_hash", F.xxhash64("key", "asked")), "asked_hash", "at", "is_opener", "id")
    group = ["asked_hash", "key", "asked"]
    walk = Window.partitionBy("part", *group).orderBy("at", "is_opener", "id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("part", *group).agg(F.max("opener").alias("own")).withColumn("carried", F.last("own", ignorenulls=True).over(before)).drop("own")
    dated = events.withColumn("last", F.last("opener", ignorenulls=True).over(walk)).filter("is_opener = 0").join(carried, ["part", *group], "left").select("id", F.coalesce("last", "carried").alias("last")).filter("last is not null")
    undated = replies.filter("instant is null").join(known.groupBy("key", "asked").agg(F.max("opener").alias("last")), ["key", "asked"]).select("id", "last")
    return dated.unionByName(undated).select(F.col("id").alias("reply"), F.col("last.id").alias("opener"))


def quote_links(emails: DataFrame, least: int = 60) -> DataFrame:
    """(reply, opener): messages whose history quotes a line of at least ``least`` characters that an earlier one has in its body; of several the earliest, then the smallest id.

    Lines are compared by digest, without quote marks and white space around them; each line's first message is found by a pre-aggregated
    minimum, so a line in any number of messages brings one link for each. Undated messages quote and are quoted by nobody.
    """
    def lines(c: str) -> Column:
        own = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r>|")))
        return F.array_distinct(F.transform(F.filter(own, lambda x: F.length(x) >= least), lambda x: F.sha2(x, 256)))

    dated = emails.select(F.col("email_id").cast("long").alias("id"), F.try_to_timestamp("date").alias("at"), "body", "trailer").filter("id is not null and at is not null")
    first = dated.select("id", "at", F.explode(lines("body")).alias("h")).groupBy("h").agg(F.min(F.struct("at", "id")).alias("first"))
    quoted = dated.select("id", "at", F.explode(lines("trailer")).alias("h")).join(first, "h").filter("first.at < at")
    return quoted.groupBy("id").agg(F.min("first").alias("first")).select(F.col("id").alias("reply"), F.col("first.id").alias("opener"))


def rebuild_conversations(emails: DataFrame, copies: DataFrame | None = None, quotes: DataFrame | None = None) -> DataFrame:
    """(conv, turn_no, id, role, sender, instant) of the whole conversations.

    Copies (see ``collapse_copies``; found here if not given) count once, as their smallest id. Each reply is linked to its opener, and by
    ``quotes(reply, opener)``, such as those of ``quote_links``, to whom else it answers; the conversations are the connected components of
    these links, each named after its earliest opener. A conversation is kept if every message has a date and a text that is not
    blank, at least two people write in it, and every reply has among its recipients someone else who wrote earlier in it. ``conv`` is the
    opener's id; turns count from 1 in order of instant, then id. The role is 'opener' for the writer of the first turn, else 'responder'.

    Null or unreadable dates make a message undated; null lists count as empty; a message without sender is no part of a conversation.
    """
    if copies is None:
        copies, _ = collapse_copies(emails)
    once = emails.join(copies.select(F.col("id").alias("email_id")), "email_id", "left_anti")
    recipients = F.filter(F.transform(F.coalesce("to_addrs", F.array().cast("array<string>")), _address), lambda x: x.isNotNull() & (x != ""))
    messages = cut(
        once.filter("email_id is not null and from_addr is not null").select(
            F.col("email_id").cast("long").alias("id"),
            subject_kind(F.col("subject")).alias("kind"),
            bare_subject(F.col("subject")).alias("key"),
            _address(F.col("from_addr")).alias("sender"),
            recipients.alias("recipients"),
            F.array_sort(F.array_distinct(F.array_union(recipients, F.array(_address(F.col("from_addr")))))).alias("people"),
            F.try_to_timestamp(F.col("date")).alias("instant"),
            F.coalesce(F.col("raw_body").rlike(r"(?U)\S"), F.lit(False)).alias("has_text"),
        ).filter("kind <> 'forward'")
    )
    links = cut(find_links(messages))
    edges = links
    if quotes is not None:
        here = messages.select("id")
        edges = links.unionByName(quotes.select("reply", "opener").join(here.withColumnRenamed("id", "reply"), "reply", "left_semi").join(here.withColumnRenamed("id", "opener"), "opener", "left_semi")).distinct()
    components = connected_components(edges.select(F.col("reply").alias("u"), F.col("opener").alias("v")))
    starts = edges.select(F.col("opener").alias("id")).distinct()
    openers = components.join(starts, "id")
    if quotes is None:  # one opener for each
        openers = openers.select("component", F.col("id").alias("conv"))
    else:
        openers = openers.join(messages.select("id", "instant", (F.col("kind") != "opener").alias("late")), "id").groupBy("component").agg(F.min_by("id", F.struct("late", "instant", "id")).alias("conv"))
    members = cut(components.join(openers, "component").select("id", "conv").join(messages.drop("key", "people"), "id"))
    first = members.groupBy("conv", "sender").agg(F.min(F.struct("instant", "id")).alias("first"))
    broken = members.groupBy("conv").agg(F.bool_and(F.col("instant").isNotNull() & F.col("has_text")).alias("whole"), F.count_distinct("sender").alias("writers")).filter("not whole or writers < 2").select("conv")
    asked = members.filter("id <> conv").select("conv", "id", "sender", "instant", F.explode_outer(F.array_distinct("recipients")).alias("to"))
    writers = first.select("conv", F.col("sender").alias("to"), "first")
    answered = asked.join(writers, ["conv", "to"], "left").groupBy("conv", "id").agg(F.bool_or(F.coalesce((F.col("to") != F.col("sender")) & (F.col("first") < F.struct("instant", "id")), F.lit(False))).alias("ok"))
    stray = answered.filter("not ok").select("conv")
    kept = members.join(broken.unionByName(stray).distinct(), "conv", "left_anti").select("conv", "id", "sender", "instant")
    opener = messages.select(F.col("id").alias("conv"), F.col("sender").alias("opened_by"))
    turns = number_turns(kept)
    return turns.join(opener, "conv").select("conv", "turn_no", "id", F.when(F.col("sender") == F.col("opened_by"), "opener").otherwise("responder").alias("role"), "sender", "instant")
