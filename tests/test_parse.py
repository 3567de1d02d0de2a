from email import message_from_string

from postloom.operators import parse
from pyspark.sql import functions as F

MESSAGE = """Message-ID: <1.2@x.example>
Date: Thu, 24 Jun 2021 12:21:41 -0600 (MDT)
From: Ida Field <IDA.field@x.example>
To: a.b@x.example,
\tc.d@y.example
Subject: A long
 subject
X-From: Ida Field

Hello,

text
-----Original Message-----
old"""


def test_fields_match_the_standard_parser(spark):
    raw = spark.createDataFrame([("f1", MESSAGE), ("f2", MESSAGE.replace("\n", "\r\n")), ("f3", "no head"), ("f4", None), ("f5", "Date: 31 Feb 2020 10:00:00 +0000\nTo:\n\n")], "file string, message string")
    got = {r["file"]: r for r in parse.parse_messages(raw).collect()}
    for key in ("f1", "f2"):
        r = got[key]
        m = message_from_string(MESSAGE)
        assert (r["message_id"], r["subject"], r["from_addr"]) == (m["Message-ID"], "A long subject", "ida.field@x.example")
        assert r["to_addrs"] == ["a.b@x.example", "c.d@y.example"] and r["cc_addrs"] == []
        assert r["date"] == "2021-06-24T12:21:41-06:00"
        assert (r["body"], r["trailer"]) == ("Hello,\n\ntext", "-----Original Message-----\nold")
    assert got["f3"]["subject"] == "" and got["f4"]["raw_body"] == "" and got["f5"]["date"] is None and got["f5"]["to_addrs"] == []


def test_both_modes_agree(spark):
    raw = spark.createDataFrame([("f1", MESSAGE), ("f2", None)], "file string, message string")
    fast, exact = (f(raw).select("file", "message_id", "date", "from_addr", "to_addrs", "subject", "x_from", "body", "trailer") for f in (parse.parse_messages, parse.parse_exact))
    assert sorted(map(str, fast.collect())) == sorted(map(str, exact.collect()))


def test_tags_and_json(spark):
    df = spark.createDataFrame([("<body>\nx\n</body>",), ("none",), ('say {"a": 1} ok',)], "t string")
    assert [r[0] for r in df.select(parse.tagged(F.col("t"), "body")).collect()] == ["x", None, None]
    assert [r[0] and r[0]["a"] for r in df.select(parse.json_object(F.col("t"), "a int")).collect()] == [None, None, 1]


def test_render_leaves_out_empty_fields(spark):
    df = spark.createDataFrame([(1, "a@x.example", ["b@x.example"], [], "", None, "text", "")], "email_id long, from_addr string, to_addrs array<string>, cc_addrs array<string>, subject string, date string, body string, trailer string")
    assert parse.render(df).first()["text"] == "From: a@x.example\nTo: b@x.example\n\ntext"
