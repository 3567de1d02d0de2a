import datetime
import re

import pytest
from postloom.operators import evaluate, generate, identity, redact, rewrite, scrub, surrogates
from pyspark.sql import functions as F

TERMS = scrub.Terms(("norvik energy", "norvik"), "norvik.example", ("alder bank",), ("harwick",), ("QZX",))
SCHEMA = "email_id long, file string, message_id string, date string, from_addr string, to_addrs array<string>, cc_addrs array<string>, bcc_addrs array<string>, subject string, x_from string, x_to string, x_origin string, body string, trailer string"
BODY = (
    "Dear Anders,\n\nWilliam Gruber spoke with Otto  \nBirk of Alder Bank in Harwick, TX 77002 about QZX and Norvik Energy. Call me on (555) 301-9048 or 6/12/2001, not Jun 14th or 3 July 2001.\n"
    "See http://www.norvik.example/x, account 123456789, SSN 123-45-6789, Room 12B; mail ida.moor@other.com or bill.gruber@norvik.example. Also ask rita wynne.\n\nRegards,\nBill Gruber"
)
TRAILER = "---------------------- Forwarded by Jeff Dasson/NA/Norvik on 09/04/2000 09:00 AM ---------------------------\n\nTo: Susan J Marr/NA/Norvik@NORVIK, Alan Comley/PDX/ECT@ECT, Linda  Guild/HOU/ECT@ECT, Jeff \nDasson/NA/Norvik@Norvik\nSubject: plan\n\nText."


def rows(spark):
    return spark.createDataFrame(
        [
            (1, "gruber-w/sent/1.", "<a>", "2001-06-07T07:48:00-07:00", "william.gruber@norvik.example", ["anders.fast@norvik.example"], ["mark.hade@norvik.example"], [], "RE: plan", "William Gruber", "", "GRUBER-W", BODY, TRAILER),
            (2, "gruber-w/sent/2.", "<b>", None, "anders.fast@norvik.example", [], None, None, None, None, None, None, None, ""),
            (3, "", "<c>", "bad", "", ["william.gruber@norvik.example"], [], [], "fw:  x", "", "", "", "plain words " * 3000, ""),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame(
        [("p1", "Pine Works", "PIN", "pine.example", "gas", "en_GB", "Land", "Pineton", "America/New_York", ["audit", "risk"], "current"), ("p2", "Oak Group", "OAK", "oak.example", "oil", "de_DE", "Land", "Oakton", None, None, "current")],
        "profile_id string, name string, short string, domain string, industry string, locale string, country string, city string, tz string, sub_units array<string>, profile_set string",
    )


@pytest.fixture(scope="module")
def scrubbed(spark, profiles):
    return scrub.scrub(rows(spark), profiles, TERMS, given=spark.createDataFrame([("Otto",)], "first string")).persist()


def test_nothing_that_tells_the_source_is_left(scrubbed):
    r = scrubbed.filter("email_id = 1").first()
    text = "\n".join([r["subject"], r["body"], r["trailer"]]).lower()
    for gone in ("gruber", "anders", "birk", "norvik", "harwick", "9048", "alder bank", "qzx", "77002", "123456789", "123-45", "ida.moor", "dasson", "comley", "guild", "marr", "/hou/", "@ect", "room 12b"):
        assert gone not in text, gone
    assert r["sender"]["full"] in r["body"] and r["body"].count(r["sender"]["full"]) == 2  # short and formal name are one person
    assert set(r["placeholders"]) == {"[COMPANY]", "[ORG_1]", "[LOC_1]", "[UNIT_1]"} == set(re.findall(r"\[[A-Z]+(?:_\d)?\]", r["body"])) and r["subject"].startswith("Re: ")
    assert r["counts"]["company"] >= 1 and r["counts"]["person"] >= 8 and r["sender"]["full"] in r["keep_names"]
    assert "gruber" in r["hard_terms"] and "other.com" in r["hard_terms"] and "5553019048" in r["hard_terms"] and "bill" in r["soft_terms"]


def test_dates_move_with_the_message(scrubbed):
    r = scrubbed.filter("email_id = 1").first()
    move = datetime.timedelta(r["shift_days"])
    n, w, d = (datetime.date(2001, *x) + move for x in ((6, 12), (6, 14), (7, 3)))
    assert move.days % 7 == 0 and f"{n.month}/{n.day}/{n.year}" in r["body"] and f"{w:%b} {w.day}" in r["body"] and f"{d.day} {d:%B} {d.year}" in r["body"]


def test_empty_odd_and_long_messages(spark, profiles, scrubbed):
    empty, long = (scrubbed.filter(f"email_id = {k}").first() for k in (2, 3))
    assert (empty["subject"], empty["body"], empty["shift_days"]) == ("", "", 0) and long["body"] == "plain words " * 3000 and long["subject"] == "Fw: x"
    assert scrub.scrub(rows(spark).limit(0), profiles, TERMS).count() == 0
    more = scrub.scrub(rows(spark).withColumn("people", F.lit(1)).drop("people"), profiles, TERMS, body_words=5).filter("email_id = 3").first()
    assert more["body"] == ""  # one line of too many words


def test_same_person_same_stand_in(spark, profiles, scrubbed):
    again = scrub.scrub(rows(spark).repartition(3), profiles, TERMS, given=spark.createDataFrame([("otto",)], "first string"))
    key = lambda r: (r["email_id"], r["subject"], r["body"], r["trailer"])
    assert sorted(map(key, again.collect())) == sorted(map(key, scrubbed.collect()))
    a, b = (scrubbed.filter(f"email_id = {k}").first() for k in (1, 2))
    assert a["to_people"][0] == b["sender"]


def test_detector_and_entity_filters(spark, profiles):
    def detector(texts):
        found = F.array(*(F.struct(F.lit(x).alias("label"), F.lit(e).alias("entity")) for x, e in (("ORG", "Plain words"), ("LOC", "Oslo"), ("PERSON", "Zeno Quill's"), ("ORG", "x@y"), ("ORG", "low"), ("LOC", "A1b"))))
        return texts.select("doc", F.explode(found).alias("x")).select("doc", "x.label", "x.entity")

    df = rows(spark).filter("email_id = 3").withColumn("body", F.lit("Plain words from Oslo, Oslo and Zeno Quill."))
    r = scrub.scrub(df, profiles, TERMS, detector=detector).first()
    assert r["body"].startswith("[ORG_1] from [LOC_1], [LOC_1] and ") and "Quill" not in r["body"]


def test_date_forms(spark):
    from postloom.operators.dates import worded_date

    df = spark.createDataFrame([("June 30, 2001", True), ("Jun 1st", True), ("31 Dec 2001", False), ("22nd May", False), ("Feb 30", True)], "t string, m boolean")
    got = [df.filter(F.col("t") == t).select(worded_date(F.col("t"), F.lit(2), F.lit(2001), (1990, 2035), m)).first()[0] for t, m in df.collect()]
    assert got == ["July 2, 2001", "Jun 3rd", "2 Jan 2002", "24th May", "Feb 30"]


def test_surrogate_forms(spark):
    df = spark.createDataFrame([("p", "en_GB", "12-34567", "www.Host.org/path?x", "Jö.Berg@gmail.com")], "p string, l string, n string, u string, a string")
    r = df.select(surrogates.number(F.col("p"), F.col("n")), surrogates.url(F.col("p"), F.col("u")), surrogates.email(F.col("p"), F.lit("own.example"), F.lit("in.example"), F.col("a")), surrogates.phone(F.col("p"), F.col("l"), F.lit("5551234")), surrogates.street_address(F.col("p"), F.col("n")), surrogates.city_name(F.col("p"), F.col("n")), surrogates.org_name(F.col("p"), F.col("n")), surrogates.office(F.col("p"), F.col("n"))).first()
    forms = (r"[1-9]\d-\d{5}", r"https://www\.[a-z]+\.org/", r"j\d{3,4}@gmail\.com", r"\+44 .*", r"\d{3} \w+ \w+", r"[A-Z][a-z]+", r"[A-Z][a-z]+ \w+", r"Room \d+[A-D]\d\d")
    assert all(re.fullmatch(f, x) for f, x in zip(forms, r)), r


def test_rule_mode(scrubbed):
    g = {r["email_id"]: r for r in generate.generate(scrubbed, "rule", company_terms=TERMS.company).collect()}
    r = g[1]
    assert re.search(r"@(pine|oak)\.example>$", r["headers"]["From"]) and "norvik" not in r["raw"].lower() and "[" not in r["body"] and r["meta"]["leaks_after"] == []
    assert r["raw"].startswith("Message-ID: <") and "\n\n" + r["body"] in r["raw"] and r["quoted"] in r["raw"] and r["headers"]["Date"].split(",")[0] == "Thu"
    assert g[2]["headers"]["Date"].startswith("Fri, 01 Jun 2001 10:00:00") and g[2]["body"] == "" and g[3]["meta"]["mode"] == "rule"


def test_hybrid_keeps_the_best_attempt_and_repairs(spark, scrubbed):
    calls = []

    def bad(prompts):
        out = []
        for p in prompts:
            body = p[p.rfind("<body>\n") + 7 : p.rfind("\n</body>")]
            done = re.sub(r"\[[A-Z]+(?:_\d)?\]", "Acorn", body)
            out.append((f"<subject>s</subject><body>{done if 'attempt 1' in p else body} Gruber</body><quoted>q</quoted>", 0.01))
        return out

    cache = spark.createDataFrame([], rewrite.CACHE)
    g = {r["email_id"]: r for r in generate.generate(scrubbed, "hybrid", bad, cache, rounds=2).collect()}
    assert g[1]["meta"]["attempts"] == 2 and g[1]["meta"]["forced_redaction"] and "gruber" not in g[1]["body"].lower() and "leak" in g[1]["meta"]["problems"]
    nothing = generate.generate(scrubbed, "hybrid", lambda ps: [("no tags", 0.0) for _ in ps], cache, rounds=1)
    assert {r["body"] for r in nothing.collect()} == {""} and "format" in nothing.first()["meta"]["problems"] and not calls
    direct = generate.generate(scrubbed, "direct", lambda ps: [("<subject>a</subject><body>William Gruber</body>", 0.0) for _ in ps], cache).filter("email_id = 1").first()
    assert direct["quoted"] == "" and direct["meta"]["leaks_after"] == ["gruber", "william gruber"] and not direct["meta"]["forced_redaction"]
    with pytest.raises(ValueError):
        generate.generate(scrubbed, "other")


def test_cache_is_kept_and_budget_comes_first(spark, tmp_path):
    prompts = spark.createDataFrame([(k, f"p{k % 3}") for k in range(9)], "id int, prompt string")
    path = str(tmp_path / "cache")
    ask = lambda ps: [(p.upper(), 0.5) for p in ps]
    answers, new = rewrite.answer(prompts, rewrite.read_cache(spark, path), ask, "m", cache_path=path)
    assert answers.count() == 9 and new.count() == 3 and tuple(rewrite.cost_report(answers, new).first()) == (9, 3, 1.5, 3, 1.5)
    again, none = rewrite.answer(prompts, rewrite.read_cache(spark, path), None, "m")
    assert again.count() == 9 and none.count() == 0
    with pytest.raises(rewrite.BudgetExceeded):
        rewrite.answer(prompts, spark.createDataFrame([], rewrite.CACHE), lambda ps: 1 / 0, "m", budget=1.0, cost_each=0.5)
    tries = []

    def flaky(ps):
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return [("ok", 0.0) for _ in ps]

    assert rewrite.patiently(flaky, wait=0.0)(["a"]) == [("ok", 0.0)] and len(tries) == 3


def test_survivors_and_privacy(spark):
    df = spark.createDataFrame([("Ida K\nMoor/HOU/ECT wrote\nFrom: Birk, Otto\n", "ida k. moor and OTTO\nBirk left", ["otto birk"]), (None, None, [])], "s string, d string, y array<string>")
    got = df.select(evaluate.source_names(F.col("s")), evaluate.survivors(evaluate.source_names(F.col("s")), F.col("d"), F.col("y"))).collect()
    assert [tuple(x) for x in got[0][0]] == [("ida", "moor"), ("otto", "birk")] and got[0][1] == ["ida moor"] and got[1][1] == []
    pairs = spark.createDataFrame([(1, "a b", "a b", "Ida Moor/HOU/ECT at norvik.example [ORG_1]", ["x@y"], "To: mila.birk"), (2, "", None, None, None, None)], "k int, source string, derived string, raw string, terms array<string>, own string")
    r = {x["k"]: x for x in evaluate.privacy(pairs, "k", spark.createDataFrame([("ida moor",), ("mila birk",)], "name string"), evaluate.markers("norvik", "norvik.example")).collect()}
    assert r[1]["markers"] == ["company", "domain", "route"] and r[1]["n_names"] == 1 and r[1]["placeholder_left"] and r[1]["any_leak"] and not r[2]["any_leak"]


def test_auc_tells_apart_what_can_be(spark):
    df = spark.range(2000).selectExpr("id", "cast(id % 2 as int) as y", "(id % 2) * 1.0 + (hash(id) % 100) / 100.0 as a", "cast(hash(id, 7) % 10 as double) as b")
    good, none = evaluate.form_auc(df, "y", "id", repeats=2).first(), evaluate.form_auc(df.withColumn("a", F.lit(1.0)), "y", "id", repeats=2).first()
    assert good["auc"] > 0.85 and abs(none["auc"] - 0.5) < 0.05 and good["n"] == 2000


def test_genders_and_artifacts(spark):
    lexicon = identity.gender_lexicon(spark)
    people = spark.createDataFrame([("p", "d.example", "en_US", "aila moor"), ("p", "d.example", "en_US", "bram moor"), ("p", "d.example", "en_US", "zz moor")], "profile_id string, domain string, locale string, identity string")
    got = {r["identity"]: r["first"] for r in identity.personas(people, lexicon).collect()}
    assert got["aila moor"] in identity.FIRST["f"] and got["bram moor"] in identity.FIRST["m"] and got["zz moor"] in identity.FIRST["u"]
    texts = ["Janel= =20 Guerro, it=92s", "IMCEANOTES-x+20y z", "<a@b.example>@SYS", "a [mailto:x@in.example]b"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redact.clean_artifacts(F.col("t"), "in.example")).collect()] == ["Janel Guerro, it's", " z", "<a@b.example>", "ab"]
