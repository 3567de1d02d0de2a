from postloom.operators import harvest, judge
from pyspark.sql import functions as F


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, text string")


def names(df):
    return {(r["doc"], r["name"]) for r in df.select("doc", "name").collect()}


def test_pairs_and_headers(spark):
    df = docs(spark, 'On Monday, Ida Field <ida@x.example> wrote to "Mila K. Moor" <m@x.example>.', "> From: Field, Ida\nTo: Otto Birk/OPS/FIRM@FIRM; Mila Moor [mailto:m@x]\ncc: \nSubject: A B", None, "")
    assert {(r["name"], r["address"]) for r in harvest.address_pairs(df).collect()} == {("Ida Field", "ida@x.example"), ("Mila K. Moor", "m@x.example")}
    assert names(harvest.header_line_names(df)) == {(1, "Field, Ida"), (1, "Otto Birk"), (1, "Mila Moor")}


def test_capitals_and_lower_case(spark):
    given = spark.createDataFrame([("ida",), ("mila",)], "first string")
    df = docs(spark, "With Ida Field Mila Moor, not Ida Street or May Field. The street is a street.", "Ask Ida\nField now", "my colleague, mila moor, is out", None)
    frequencies = harvest.word_frequencies(df)
    assert names(harvest.capitalised_names(df, given, frequencies)) == {(0, "Ida Field"), (0, "Mila Moor"), (1, "Ida Field")}
    common = spark.createDataFrame([("moor", 1, 1.0), ("mila", 1, 2.0), ("is", 9, 7.0)], "word string, n long, zipf double")
    assert names(harvest.lowercase_names(df, given, common)) == {(2, "Mila Moor")}
    assert harvest.capitalised_names(df.limit(0), given, frequencies).count() == 0


def test_display_names_and_trimming(spark):
    df = spark.createDataFrame([("Ida Field; Mila Moor", ["a.b@x", "cc.dd@x"]), ("Ida Field", ["aa.bb@x", "cc.dd@x"]), (None, [])], "d string, a array<string>")
    assert [r[0] for r in df.select(harvest.paired_names(F.col("d"), F.col("a"))).collect()] == [["Ida Field", "Mila Moor"], ["Aa Bb", "Cc Dd"], []]
    assert [r["t"] for r in docs(spark, "a b\nc d e\nf", "a", None, "").select(harvest.trim_words(F.col("text"), 5).alias("t")).collect()] == ["a b\nc d e", "a", "", ""]


def test_judging(spark):
    pairs = spark.createDataFrame([(i, f"text {i}?", f"other {i}") for i in range(30)] + [(90, None, "")], "idx long, source string, derived string")
    cache = spark.createDataFrame([], "prompt_key string, text string, cost double, model string")
    replies = judge.judge(pairs, cache, judge.offline_judge).cache()
    assert replies.count() == 31 * 5
    r = judge.realism(replies).first()
    assert 1 <= r["realism_source"] <= 5 and r["n_pairs"] == 31 and judge.top_artifacts(replies).count() == 5
    assert judge.label_agreement(replies, "action_required").first()["n"] == 31
    broken = judge.judge(pairs.limit(1), cache, lambda asked: [("no answer", 0.0) for _ in asked])
    assert all(r["reply"] is None or r["reply"]["realism"] is None for r in broken.collect())
