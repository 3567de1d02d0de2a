import random

from pathlib import Path

import pytest
from postloom.llm.mixing import TOKENIZERS, _flight, count_tokens, mix_sources
from postloom.llm.truncation import find_truncated, truncation_rates

here = pytest.mark.skipif(not Path(TOKENIZERS).exists(), reason="no tokenizer files here")


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    units = [[i, rng.randrange(1, 400), 0.37] for i in range(500)]
    tokens, n = sum(u[1] for u in units), len(units)
    rest = _flight(units, random.Random(2), 2)
    assert len(rest) <= 2 and sum(0 < u[2] < 1 for u in units) <= 2
    assert abs(sum(u[1] * u[2] for u in units) - 0.37 * tokens) < 1e-3 and abs(sum(u[2] for u in units) - 0.37 * n) < 1e-6
    one = [[1, 5, 0.5]]
    assert _flight(one, random.Random(3), 0) == [] and one[0][2] in (0, 1)


def test_flight_keeps_expectations():
    hits = 0
    for seed in range(400):
        units = [[i, 3 + i, 0.3] for i in range(10)]
        r = random.Random(seed)
        for constraints in (2, 1, 0):
            _flight([u for u in units if 0 < u[2] < 1], r, constraints)
        hits += units[4][2]
    assert 80 < hits < 160


@here
def test_shares(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(("big", "big", "big", "mid")), "word " * rng.randrange(1, 60)) for i in range(600)] + [(i, "small", "a few words here") for i in range(600, 630)] + [(700, None, "x y"), (701, "big", None), (702, "big", ""), (None, "big", "z")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, tokens int").repartition(5)
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.4, 3), ("m", "small", 0.1, 4), ("n", "none", 1.0, 2), ("o", "mid", None, None)], "mix_name string, source string, target_share double, max_repeats int")
    selection, report = mix_sources(df, targets)
    got = {(r["mix"], r["source"]): r for r in report.collect()}
    assert {k for k, r in got.items() if r["short"]} == {("m", "small"), ("n", "none")}
    for k in (("m", "big"), ("m", "mid")):
        assert abs(got[k]["tokens_used"] - got[k]["wanted"]) < 200
    assert got["m", "small"]["most_repeats"] == 4 and got["m", "small"]["records_used"] == 120
    again = mix_sources(df, targets)[0]
    assert sorted(map(tuple, selection.select("mix", "id", "copies").collect())) == sorted(map(tuple, again.select("mix", "id", "copies").collect()))
    assert mix_sources(df.limit(0), targets)[1].count() == 5 and mix_sources(df, targets.limit(0))[1].count() == 0
    assert {r["id"]: r["tokens"] for r in count_tokens(df).collect()}[701] == 0


def test_truncated(spark):
    rng = random.Random(7)
    sentences = ["the crew found {} faulty seals on the line in May.", "we moved {} lots of diesel to the north last week.", "please keep the report out of the plan until June.", "nobody in billing has seen the {} notes that they sent."]
    docs = []
    for i in range(3000):
        text = " ".join(rng.choice(sentences).format(rng.randrange(99)) for _ in range(4))
        if i % 100 == 0:
            text = text[: rng.randrange(40, len(text) - 30)].rstrip(" .") + rng.choice(("", "", " [...]"))
        elif i % 7 == 0:
            text += "\n\nBest,\nIda Field"
        docs.append((i, rng.choice("ab"), text))
    docs += [(9001, "a", None), (9002, "a", ""), (9003, None, "one"), (None, "a", "x"), (9004, "a", "w" * 200_000)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, source string, text string, id string").repartition(3)
    found = find_truncated(df)
    got = {r["id"] for r in found.collect() if r["truncated"]}
    want = {i for i in range(0, 3000, 100)}
    assert len(got & want) >= 28 and len(got - want) <= 2 and found.count() == 3004
    assert {r["source"] for r in truncation_rates(found).collect()} == {"a", "b", None}
    assert find_truncated(df.limit(0)).count() == 0


def test_level_and_long_words(spark):
    """The trigram decides where it is frequent; long words and long blanks at the end count whole."""
    whole = "we sent the plan to the desk and the desk sent it on. The end of the page is near"
    long = "x" * 300
    rows = [(k, "a", f"{whole} {long}y and more of it. Yours Ida") for k in range(300)]
    rows += [(1000, "a", f"{whole} {'x' * 299}"), (1001, "a", whole + " [... cut]" + " " * 500 + "\n"), (1002, "a", "we sent the plan to the" + "\n" * 300), (1003, "b", None), (1003, "b", " ")]
    got = {r["id"]: (r["truncated"], r["level"]) for r in find_truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[1000] == (True, 3) and got[1002] == (True, 3) and got[1001][0] and not got[1003][0] and not got[5][0]


@here
def test_draws_do_not_depend_on_how_rows_lie(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "repeat('word ', int(id % 17) + 1) as text")
    targets = spark.createDataFrame([("m", "a", 0.1, 2), ("m", "b", 0.4, 1)], "mix_name string, source string, target_share double, max_repeats int")
    draws = [sorted(map(tuple, mix_sources(x, targets, bucket_rows=300)[0].select("mix", "id", "copies").collect())) for x in (df.repartition(1), df.repartition(9).orderBy("doc_id", ascending=False), df.repartition(3, "source"))]
    assert draws[0] == draws[1] == draws[2]
    report = {r["source"]: r for r in mix_sources(df, targets, bucket_rows=300)[1].collect()}
    assert all(abs(r["tokens_used"] - r["wanted"]) < 60 for r in report.values())
    other = mix_sources(df, targets, seed=8, bucket_rows=300)[0]
    assert sorted(map(tuple, other.select("mix", "id", "copies").collect())) != draws[0]
