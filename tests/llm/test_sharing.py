import random
from collections import defaultdict

import numpy as np
from postloom.llm.chunks import Chunker
from postloom.llm.sharing import find_shared


def brute(texts, least=160):
    where = defaultdict(set)
    for k, t in texts.items():
        for i in range(len(t) - least + 1):
            where[t[i : i + least]].add(k)
    out = {}
    for k, t in texts.items():
        covered = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                covered[i : i + least] = True
        if covered.any():
            out[k] = int(covered.sum())
    return out


def corpus(n=120):
    rng = random.Random(4)
    letters = "abcdefghij klmno äöü\n"
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [make(k) for k in (120, 158, 159, 160, 161, 175, 199, 230, 400)]
    texts = {}
    for i in range(n):
        t = make(rng.randrange(0, 300))
        for s in rng.sample(shared, rng.choice((0, 0, 1, 2))):
            cut = rng.choice((0, 0, 5))
            t += s[cut:] + make(rng.randrange(0, 80))
        texts[i] = t
    texts[n] = texts[n + 1] = make(500)
    texts[n + 2], texts[n + 3] = "a" * 1000, "a" * 400  # ties everywhere
    return texts


def test_found_and_measured_as_by_brute_force(spark):
    texts = corpus()
    want = brute(texts)
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()] + [(900, None, ""), (901, "", "")], "rec long, text string, d string").repartition(5)
    assert {r["rec"]: r["shared"] for r in find_shared(df).collect()} == want
    assert {r["rec"] for r in find_shared(df, measure=False).collect()} == set(want)


def test_hot_chunk_and_repeated_rows(spark):
    rng = random.Random(5)
    notice = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(200))) + notice) for i in range(400)] + [(500, "q" * 20 + notice[:150]), (501, "only " * 60), (501, "only " * 60)]
    df = spark.createDataFrame(rows, "rec long, text string")
    assert {r["rec"] for r in find_shared(df, measure=False).collect()} == set(range(400))
    assert find_shared(df.limit(0)).count() == 0


def test_boundaries_resist_insertions():
    rng = random.Random(6)
    tail = "".join(rng.choice("abcdef ghi") for _ in range(600))
    one, two = Chunker([tail], 36), Chunker(["inserted words " + tail], 36)
    shift = len("inserted words ")
    a, b = set(one.boundaries[3:].tolist()), {x - shift for x in two.boundaries.tolist()}
    assert a <= b and max(np.diff(one.boundaries)) <= 36
    assert one.digest(np.array([10]), np.array([90]))[0] == two.digest(np.array([10 + shift]), np.array([90 + shift]))[0]
