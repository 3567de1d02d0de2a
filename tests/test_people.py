import re

from postloom.operators import identity, redact, rewrite
from pyspark.sql import functions as F


def offline_rewriter(prompts):
    return [(p.split("\n", 1)[1].replace("Hi ", "Hello "), 0.0001) if "\n" in p else (p, 0.0001) for p in prompts]


def test_names(spark):
    names = ["Field, Ida", "Ida Field <x@y>", "IDA FIELD", "ida.field@x.example", None, "Ida  K. Field"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(identity.clean_name(F.col("n"))).collect()]
    assert got == ["Ida Field", "Ida Field", "Ida Field", "ida field", "", "Ida K Field"]
    addresses = ["ida.field@x.example", "ifield@x.example", "a.b@x.example", None]
    assert [r[0] for r in spark.createDataFrame([(a,) for a in addresses], "a string").select(identity.name_from_address(F.col("a"))).collect()] == ["Ida Field", "ifield", "a.b", ""]


def people(spark, n=60):
    return spark.createDataFrame([("p1", "one.example", "en_US", f"name{i} last{i}") for i in range(n)] + [("p2", "two.example", "de_DE", f"name{i} last{i}") for i in range(n)], "profile_id string, domain string, locale string, identity string")


def test_surrogates_are_stable_unique_and_differ_by_profile(spark):
    a = {(r["profile_id"], r["identity"]): r for r in identity.personas(people(spark)).collect()}
    b = {(r["profile_id"], r["identity"]): r for r in identity.personas(people(spark).repartition(7).orderBy(F.rand(3))).collect()}
    assert a == b and len({r["email"] for r in a.values()}) == len(a)
    assert any(a["p1", f"name{i} last{i}"]["first"] != a["p2", f"name{i} last{i}"]["first"] for i in range(9))
    assert re.fullmatch(r"\+49 30 2312 5\d{3}", a["p2", "name0 last0"]["phone"])
    assert identity.personas(people(spark, 0)).count() == 0


def test_nicknames_are_one_person(spark):
    got = spark.createDataFrame([("Bill Moore",), ("William  Moore",)], "n string").select(identity.canonical_name(F.col("n"))).distinct().collect()
    assert len(got) == 1


def test_shift_keeps_weekday_and_clock(spark):
    df = spark.createDataFrame([(i, f"o{i % 3}/inbox/{i}", f"20{10 + i % 12}-0{1 + i % 9}-1{i % 10}T0{i % 10}:15:00+01:00") for i in range(40)] + [(99, "x/y", None), (98, "x/y", "bad")], "email_id int, file string, date string")
    rows = identity.shift_dates(df, F.split("file", "/")[0]).select("email_id", "shift_days", F.weekday("shifted") == F.weekday(F.try_to_timestamp(F.left("date", F.lit(19)))), F.date_format("shifted", "HH:mm"), F.substring("date", 12, 5), F.year("shifted")).collect()
    assert all(r[1] % 7 == 0 and r[2] and r[3] == r[4] and 2023 <= r[5] <= 2026 for r in rows if r[0] < 90)
    assert all(r[1] is None for r in rows if r[0] > 90)


def test_contacts_in_one_pass(spark):
    text = "Mail a.b@x.example or see https://x.example/1, SSN 123-45-6789, call (555) 010-1234, on 1/2/2001, no 12345678."
    got = spark.createDataFrame([(text,), (None,), ("",), ("plain text stays",)], "t string").select(redact.redact_contacts(F.col("t")), redact.span_counts(F.col("t"))).collect()
    assert got[0][0] == "Mail [EMAIL] or see [URL] SSN [SSN], call [PHONE], on [DATE], no [NUMBER]."
    assert got[0][1] == {k: 1 for k, _ in redact.SPANS} and got[1][0] is None and got[2][0] == "" and got[3][0] == "plain text stays"


def test_dates_in_text_move(spark):
    df = spark.createDataFrame([("on 6/12/2001 and 2-30-2001, 6/12/01, 6/12/1950", 8400), ("none", None), (None, 7)], "t string, days int")
    got = [r["m"] for r in df.select(redact.shift_numeric_dates(F.col("t"), F.col("days")).alias("m")).collect()]
    assert got == ["on 6/11/2024 and 2-30-2001, 6/11/24, 6/12/1950", "none", None]


def test_aliases_replace_all_forms_and_never_their_own_output(spark):
    known = spark.createDataFrame([(1, "Ida Field", "Field", "Ida", "field.ida@new.example", "ida.field@old.example"), (1, "Mila Ida", "Cora", "Vance", "c@new.example", "m@old.example")], "doc int, name string, first string, last string, email string, address string")
    docs = spark.createDataFrame([(1, "Ida Field, IDA FIELD, Field, Ida and ida field wrote (ida.field@old.example)."), (2, "Ida Field"), (3, None)], "doc int, text string")
    got = {r["doc"]: r for r in redact.rewrite_names(docs, known).collect()}
    assert got[1]["rewritten"].startswith("Field Ida, FIELD IDA, Ida, Field and field ida wrote (field.ida@new.example)")
    assert got[2]["rewritten"] == "Ida Field" and got[3]["rewritten"] is None


def test_leaks_and_force(spark):
    df = spark.createDataFrame([("The Fields met Ida Field.", ["ida field", "field", "x.y", None, ""]), (None, ["a"]), ("x.y and xay", ["x.y"])], "t string, terms array<string>")
    assert [r[0] for r in df.select(redact.leaks(F.col("t"), F.col("terms"))).collect()] == [["field", "ida field"], [], ["x.y"]]
    assert df.select(redact.force_redact(F.col("t"), F.col("terms"))).first()[0] == "The Fields met [REDACTED]."


def test_artifacts(spark):
    texts = ["a@b.example@SYS", "[mailto:a@b.example]", "x=20y=20z", "one =20 only"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redact.clean_artifacts(F.col("t"))).collect()] == ["a@b.example", "a@b.example", "x y z", "one =20 only"]


def test_rewriting_loop(spark):
    docs = spark.createDataFrame([(1, "Hi there", [], ""), (2, "secret plan", ["secret"], ""), (3, "", [], "")], "id int, text string, terms array<string>, signer string")
    cache = spark.createDataFrame([], "prompt_key string, text string, cost double, model string")
    got = {r["id"]: r for r in rewrite.rewrite(docs, cache, offline_rewriter).collect()}
    assert got[1]["text"] == "Hello there" and got[1]["attempt"] == 1 and not got[1]["forced"]
    assert got[2]["text"] == "[REDACTED] plan" and got[2]["forced"] and got[3]["problems"] == ["format"]
    for f, error in ((lambda: rewrite.rewrite(docs, cache, None), rewrite.CacheMiss), (lambda: rewrite.rewrite(docs, cache, offline_rewriter, budget=0.0), rewrite.BudgetExceeded)):
        try:
            f()
            raise AssertionError
        except error:
            pass
    answers, new = rewrite.answer(docs.select("id", F.col("text").alias("prompt")), cache, offline_rewriter, "m")
    again, none = rewrite.answer(docs.select("id", F.col("text").alias("prompt")), new, None, "m")
    assert again.count() == answers.count() == 3 and none.count() == 0
