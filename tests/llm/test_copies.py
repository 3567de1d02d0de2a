import random

from postloom.llm.components import connected_components
from postloom.llm.dedup import collapse_copies

SCHEMA = "email_id long, message_id string, body string, h string, rep int, key_a string"


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(parts)
    copies, groups = collapse_copies(df)
    return {(r["id"], r["rep"]) for r in copies.collect()}, {r["rep"]: r["n"] for r in groups.collect()}


def test_formatting_differences_are_copies(spark):
    body = "Hi Ida,\n\nPrice: 5\nBook: Blue Hill\n\nThe plan\nis ready."
    rows = [
        (5, "<1.a@x>", body),
        (2, " <1.A@X >", body.upper()),
        (9, "1.a@x", body.replace("Price: 5\nBook: Blue Hill", "Book: Blue Hill\n\nPrice: 5")),
        (7, "<1.a@x>", " ".join(body.split())),
        (8, "<1.a@x>", body.replace("5", "6")),
        (3, "<2.a@x>", body),
        (4, "<1.a@x>", body.replace("plan\nis", " plan is")),
        (6, "<1.a@x>", "The plan is ready. " + body.replace("The plan\nis ready.", "")),
    ]
    copies, groups = found(spark, rows)
    assert copies == {(4, 2), (5, 2), (7, 2), (9, 2)} and groups == {2: 5, 3: 1, 6: 1, 8: 1}


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, None, "x"), (3, "...", "x"), (4, "a", None), (5, "A", ""), (None, "a", ""), (6, "b", "w " * 100_000), (7, "b", "W\n" * 100_000), (8, "c", "same"), (8, "c", "same")]
    copies, groups = found(spark, rows)
    assert copies == {(5, 4), (7, 6)} and sum(groups.values()) == 8 and groups[4] == 2
    assert found(spark, []) == (set(), {})


def test_hot_group_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, f"m{0 if rng.random() < 0.4 else rng.randrange(60)}", rng.choice(("a b", "A, b", "c"))) for i in rng.sample(range(10_000), 900)]
    first = {}
    for i, m, b in sorted(rows):
        first.setdefault((m, "".join(c for c in b.lower() if c.isalnum())), i)
    want = {(i, f) for i, m, b in rows if (f := first[m, "".join(c for c in b.lower() if c.isalnum())]) != i}
    for parts in (1, 7):
        assert found(spark, rows, parts)[0] == want


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(50)]
    df = spark.createDataFrame([*path, *hub, (5, 5), (None, 3)], "u long, v long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in [1000, *range(1001, 1051)]}}
    assert connected_components(df.limit(0)).count() == 0
