import hashlib

from pyspark.sql import functions as F

from postloom.functions import mail, text
from postloom.functions.hashing import hash_digits, hex_mod, keyed
from postloom.operators import style


def values(spark, texts, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(*columns).collect()]


def test_words_and_lines(spark):
    texts = ["", "  \n ", "a b c\n", "one", None, "x\n\ny"]
    assert [r[0] for r in values(spark, texts, text.word_count(F.col("t")))] == [len((t or "").split()) for t in texts]
    assert [r[0] for r in values(spark, ["", "a\nb"], text.line_count(F.col("t")))] == [1, 2]


def test_ngrams_short_and_repeated(spark):
    c = text.ngrams(text.tokens(F.col("t")), 2)
    assert [r[0] for r in values(spark, ["a", "", "a b a b"], c)] == [[], [], ["a b", "b a"]]


def test_hex_mod_is_big_integer_modulo(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    for n in (2, 12, 97):
        assert [r[0] for r in values(spark, digests, hex_mod(F.col("t"), n))] == [int(d, 16) % n for d in digests]
    assert values(spark, ["x"], keyed(F.col("t"), salt="s"))[0][0] == hashlib.sha256(b"x|s").hexdigest()
    assert values(spark, ["ff00" * 8], hash_digits(F.col("t"), "+1 ##-#"))[0][0] == "+1 50-5"


def test_split_trailer(spark):
    texts = ["new\n\n-----Original Message-----\nold", "new\n> old", "new\nOn Monday, A B wrote:\n> x", "no history \n", "-----Original Message-----\nx", "On 16 Jul the auditor wrote: nothing"]
    got = values(spark, texts, mail.split_trailer(F.col("t")), mail.split_trailer(F.col("t"), "trailer"))
    assert got == [("new", "-----Original Message-----\nold"), ("new", "> old"), ("new", "On Monday, A B wrote:\n> x"), ("no history", ""), ("", "-----Original Message-----\nx"), ("On 16 Jul the auditor wrote: nothing", "")]


def test_paths_and_subjects(spark):
    assert values(spark, ["A-b/Inbox/1.", "x", ""], mail.folder_type(F.col("t"))) == [("inbox",), ("unknown",), ("unknown",)]
    assert values(spark, ["Re: FW:re: Hello ", None, "Reply"], mail.base_subject(F.col("t"))) == [("hello",), ("",), ("reply",)]


def laid(spark, how, text, width):
    return spark.createDataFrame([(text, width)], "t string, w int").select(how(F.col("t"), F.col("w"))).first()[0]


def test_wrap_round_trip(spark):
    paragraph = " ".join(f"word{k}" for k in range(60))
    wrapped = laid(spark, style.wrap, paragraph, 70) + "\n\nShort end.\n- item one\n- item two"
    assert max(map(len, wrapped.split("\n"))) <= 70
    width = spark.createDataFrame([(wrapped,)], "t string").select(style.wrap_width(F.col("t"))).first()[0]
    assert 60 <= width <= 70
    flat = laid(spark, style.unwrap, wrapped, width)
    assert flat.split("\n")[0] == paragraph and flat.endswith("\n\nShort end.\n- item one\n- item two")
    assert laid(spark, style.wrap, flat, 70) == wrapped
    assert laid(spark, style.wrap, "  " + "ab " * 40, 60) == "\n".join("  " + " ".join(["ab"] * n) for n in (19, 19, 2))
    for how in (style.wrap, style.unwrap):
        assert [laid(spark, how, t, w) for t, w in ((None, 60), ("", 60), ("a\nb", None), ("x" * 90, 60), ("http://" + "y z" * 40, 60))] == [None, "", "a\nb", "x" * 90, "http://" + "y z" * 40]

def test_typography(spark):
    reference = "One.  Two.  Three.  Four. End"
    got = spark.createDataFrame([("A “quote” – here. Next… Now.", reference)], "t string, r string").select(style.restore(F.col("t"), F.col("r"))).first()[0]
    assert got == 'A "quote" - here.  Next...  Now.'


def test_signer(spark):
    rows = [("x\nThanks,\nIda", "y\nBest,\nMila", "Ida", True), ("x\nThanks,\nIda", "y\nBest,\nida", "Ida", False), ("x", "y", "Ida", False), ("x\nIda", None, "Ida", True), ("x\nIda", "y", None, False)]
    df = spark.createDataFrame(rows, "s string, d string, f string, want boolean")
    assert all(r[0] == r[1] for r in df.select(style.signer_missing(F.col("s"), F.col("d"), F.col("f")), "want").collect())
