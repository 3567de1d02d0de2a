import random

import numpy as np
from postloom.llm.fmindex import FMIndex, suffix_order
from postloom.llm.leakage import find_leaks, item_body, words
from pyspark.sql import functions as F


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 400):
        s = rng.integers(0, 4, n)
        assert suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_index_finds_and_locates_all():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 6, rng.integers(0, 60)) for _ in range(40)] + [np.tile([1, 2], 50)] * 3
    flat = np.concatenate([np.append(t, 0) for t in texts])
    index = FMIndex.of(flat, sample=7)
    patterns = np.array([flat[i : i + 4] for i in range(len(flat) - 4) if (flat[i : i + 4] > 0).all()] + [[5, 5, 5, 5]])
    rows, low, high = index.search(patterns)
    got = {tuple(patterns[r]): sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(rows, low, high)}
    for p in map(tuple, patterns):
        want = [i for i in range(len(flat) - 3) if tuple(flat[i : i + 4]) == p]
        assert got.get(p, []) == want


def test_leaks_as_by_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(60)) for i in range(12)}
    docs = {}
    for d in range(150):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))
        if d % 3 == 0:
            source = items[rng.randrange(12)].split()
            at, n = rng.randrange(30), rng.choice((12, 19, 20, 25))
            text += " " + "\n> ".join(w.upper() + rng.choice(("", ",", ".")) for w in source[at : at + n]) + " end"
        docs[d] = text
    grams = {}
    for i, t in items.items():
        w = t.split()
        for k in range(len(w) - 19):
            grams.setdefault(tuple(w[k : k + 20]), set()).add(i)
    want = {(d, i) for d, t in docs.items() for k in range(len(words(t))) for i in grams.get(tuple(words(t)[k : k + 20]), ())}
    df = spark.createDataFrame([(d, t, 7) for d, t in docs.items()] + [(900, None, 1), (901, "", 1), (902, "?!", 1), (903, "x " * 300_000, 1)], "doc_id long, text string, item_id int")
    held = spark.createDataFrame([(i, t) for i, t in items.items()] + [(99, None), (98, "short")], "item_id long, text string")
    for block in (32_000_000, 300):
        rows = find_leaks(df, held, block_chars=block, shard_words=500).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    for r in rows:
        assert words(docs[r["doc_id"]][r["start_char"] : r["end_char"]]) == words(docs[r["doc_id"]])[r["first_word"] : r["first_word"] + r["n_words"]]
    assert find_leaks(df.limit(0), held).count() == 0 and find_leaks(df, held.limit(0)).count() == 0


def test_item_body(spark):
    texts = ["A: b\n\nnew text\n\n-----Original Message-----\nold", "A: b\r\n\r\nnew\n> old", "no blank line", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "m string").select(item_body(F.col("m"))).collect()] == ["new text\n", "new\n", None, None]
