from postloom.operators import judge


def test_texts_are_judged_whole(spark):
    pairs = spark.createDataFrame([(0, "a" * 9000 + "END", "b" * 7000 + "FIN")], "idx long, source string, derived string")
    asked = {r["kind"]: r["prompt"] for r in judge.prompts(pairs).collect()}
    assert asked["realism_source"].endswith("aEND") and asked["labels_derived"].endswith("bFIN") and asked["pair"].endswith("bFIN") and "aEND\n" in asked["pair"]
    assert {r["kind"]: r["prompt"] for r in judge.prompts(pairs, longest=5).collect()}["labels_source"].endswith("\naaaaa")
