import random

from postloom.llm.conversations import bare_subject, find_links, quote_links, rebuild_conversations, subject_kind
from pyspark.sql import functions as F

SCHEMA = "email_id long, message_id string, subject string, from_addr string, to_addrs array<string>, date string, raw_body string, body string, id int, conv string"


def make(spark, rows):
    full = [(i, f"m{i}", s, f, t, d, b, b, 1, "clash") for i, s, f, t, d, b in rows]
    return spark.createDataFrame(full, SCHEMA)


def day(k, zone="+00:00"):
    return f"2020-01-{k:02d}T10:00:00{zone}"


def turns(df):
    return sorted((r["conv"], r["turn_no"], r["id"], r["role"]) for r in rebuild_conversations(df).collect())


def test_marks(spark):
    subjects = ["Plan", "RE : plan", "Re[2]: PLAN", "AW: Re: p lan", "Fwd: plan", "SV:plan", "Reference: x", None, ""]
    got = spark.createDataFrame([(s,) for s in subjects], "s string").select(subject_kind(F.col("s")), bare_subject(F.col("s"))).collect()
    assert [r[0] for r in got] == ["opener", "reply", "reply", "reply", "forward", "reply", "opener", "opener", "opener"]
    assert [r[1] for r in got][:6] == ["plan"] * 6 and got[7][1] == got[8][1] == ""


def test_conversations(spark):
    rows = [
        (1, "Plan", "a", ["b", "c"], day(1), "x"), (2, "Re: plan", "b", ["a"], day(2, "+09:00"), "x"), (3, "RE: Plan", "a", ["b"], day(3), "x"),
        (10, "Solo", "a", ["b"], day(1), "x"),  # no answer
        (20, "Blank", "a", ["b"], day(1), "x"), (21, "re: blank", "b", ["a"], day(2), " \n"),
        (30, "Undated", "a", ["b"], day(1), "x"), (31, "re: undated", "b", ["a"], None, "x"),
        (40, "Stray", "a", ["b", "c"], day(1), "x"), (41, "re: stray", "b", ["c"], day(2), "x"),  # answers someone silent
        (50, "Twice", "a", ["b"], day(1), "x"), (51, "Twice", "a", ["b"], day(5), "x"), (52, "re: twice", "b", ["a"], day(6), "x"),
        (60, "Plan", "d", ["e"], day(1), "x"), (61, "re: plan", "e", ["d"], day(2), "x"), (62, "fw: plan", "e", ["d"], day(3), "x"),
        (70, "Own", "a", ["b"], day(1), "x"), (71, "re: own", "a", ["b"], day(2), "x"),  # one writer
        (80, None, "a", None, None, None), (81, "re:", None, [None], "bad", None),
    ]
    want = [(1, 1, 1, "opener"), (1, 2, 2, "responder"), (1, 3, 3, "opener"), (51, 1, 51, "opener"), (51, 2, 52, "responder"), (60, 1, 60, "opener"), (60, 2, 61, "responder")]
    assert turns(make(spark, rows)) == want
    assert turns(make(spark, [])) == []


def test_hot_subject_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1, 700):
        s, f = rng.choice(("hot", "hot", "hot", f"s{rng.randrange(20)}")), rng.choice("abc")
        to = rng.sample("abc", rng.choice((1, 2, 2)))
        rows.append((i, rng.choice(("", "Re: ", "Re: ")) + s, f, to, day(rng.randrange(1, 28)), "x"))
    openers, conv = [r for r in rows if not r[1].startswith("Re")], {}
    for r in rows:
        if r[1].startswith("Re"):
            fit = [o for o in openers if o[1] == r[1][4:] and {r[2], *r[3]} <= {o[2], *o[3]} and o[4] < r[4]]
            if fit:
                conv.setdefault(max(fit, key=lambda o: (o[4], o[0]))[0], []).append(r)
    by_id, want = {r[0]: r for r in rows}, []
    for c, replies in conv.items():
        members, seen, ok = sorted([by_id[c], *replies], key=lambda r: (r[4], r[0])), set(), True
        for m in members:
            ok = ok and (m[0] == c or any(a != m[2] and a in seen for a in m[3]))
            seen.add(m[2])
        if ok and len(seen) > 1:
            want += [(c, k, m[0]) for k, m in enumerate(members, 1)]
    assert [t[:3] for t in turns(make(spark, rows).repartition(6))] == sorted(want)


def test_hot_subject_brings_no_product(spark):
    """Openers and self-replies of one sender under one subject: rows, not pairs, and the latest opener for each."""
    n = 1500
    rows = spark.range(2 * n).selectExpr("id", "if(id % 2 = 0, 'opener', 'reply') as kind", "'' as key", "array('a@x', concat('b', id, '@x')) as circle", "timestamp_seconds(id) as instant").selectExpr("id", "kind", "key", "if(kind = 'opener', circle, array('a@x')) as people", "'a@x' as sender", "instant")
    import time

    began = time.time()
    got = {r["reply"]: r["opener"] for r in find_links(rows).collect()}
    assert got == {k: k - 1 for k in range(1, 2 * n, 2)} and time.time() - began < 60


def test_quotes_join_what_subjects_part(spark):
    line = "this line of the first message is long enough to be told apart from any other"
    rows = [
        (1, "<1>", "Plan", "a@x", ["b@x"], "2020-01-01T10:00:00+00:00", line, line, ""),
        (2, "<2>", "Re: Plan", "b@x", ["a@x"], "2020-01-01T11:00:00+00:00", "Fine by me.", "Fine by me.", ""),
        (3, "<3>", "Re: other", "a@x", ["b@x"], "2020-01-01T12:00:00+00:00", "Then we go.", "Then we go.", "> " + line),
        (4, "<4>", "Re: other", "a@x", ["b@x"], None, "undated", "undated", "> " + line),
    ]
    df = spark.createDataFrame(rows, "email_id long, message_id string, subject string, from_addr string, to_addrs array<string>, date string, raw_body string, body string, trailer string")
    quotes = quote_links(df)
    assert [tuple(r) for r in quotes.collect()] == [(3, 1)]
    turns = lambda **more: [(r["conv"], r["turn_no"], r["id"]) for r in rebuild_conversations(df, **more).orderBy("conv", "turn_no").collect()]
    assert turns() == [(1, 1, 1), (1, 2, 2)] and turns(quotes=quotes) == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
