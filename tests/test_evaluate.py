import numpy as np
import pandas as pd

from postloom.operators import dedup, evaluate, profile, sample
from pyspark.sql import functions as F


def test_rank_correlation_and_distance_match_pandas(spark):
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"g": rng.choice(["a", "b"], 300), "x": rng.integers(0, 20, 300), "y": rng.integers(0, 25, 300)})
    s = spark.createDataFrame(df)
    rho = {r["g"]: r["spearman"] for r in evaluate.spearman(s, "g", "x", "y").collect()}
    gaps = {r["g"]: r["ks"] for r in evaluate.ks(s, "g", "x", "y").collect()}
    for g, own in df.groupby("g"):
        assert abs(rho[g] - own["x"].rank().corr(own["y"].rank())) < 1e-5
        at = np.unique(np.concatenate([own["x"], own["y"]]))
        assert abs(gaps[g] - max(abs((own["x"] <= v).mean() - (own["y"] <= v).mean()) for v in at)) < 1e-5
    assert evaluate.spearman(s.limit(0), "g", "x", "y").count() == 0


def test_agreement_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b string")
    assert tuple(evaluate.agreement(make([("y", "y"), ("n", "y"), ("n", "n"), (None, "y")]), "a", "b").first()) == (3, round(2 / 3, 6), 0.4)
    assert tuple(evaluate.agreement(make([("y", "y")]), "a", "b").first())[2] == 1.0
    assert tuple(evaluate.agreement(make([]), "a", "b").first()) == (0, None, None)


def test_nearest_is_exact_in_blocks(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(80, 6))
    m[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None)], "id long, vector array<double>").repartition(5)
    got = {(r["query"], r["rank"]): r["id"] for r in evaluate.nearest(df, df.filter("id % 10 = 0 and vector is not null"), 3, block=3).collect()}
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for q in range(0, 80, 10):
        order = [j for j in np.argsort(-(unit @ unit[q]), kind="stable") if j not in (q, 7)]
        assert [got[q, k] for k in (1, 2, 3)] == order[:3]


def test_mean_similarity_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(12, 4))
    df = spark.createDataFrame([("a", [float(x) for x in v]) for v in m] + [("b", [1.0, 0.0, 0.0, 0.0])], "g string, vector array<double>")
    got = evaluate.mean_similarity(df, "g").collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert len(got) == 1 and abs(got[0]["mean_cosine"] - (unit @ unit.T)[np.triu_indices(12, 1)].mean()) < 1e-5


def test_copy_ratio(spark):
    df = spark.createDataFrame([("a b c d", "x a b c"), ("a", "a"), (None, "a b c")], "d string, s string")
    assert [r[0] for r in df.select(evaluate.copy_ratio(F.col("d"), F.col("s"), 3)).collect()] == [0.5, 0.0, 0.0]


def test_samples_ignore_partitioning(spark):
    df = spark.range(2000).withColumn("g", F.col("id") % 3)
    for f in (lambda x: sample.hash_sample(x, F.col("id"), 0.2, 1), lambda x: sample.stratified(x, ["g"], F.col("id"), 7, 1), lambda x: sample.first_n(x, F.col("id"), 9, 1)):
        assert sorted(r["id"] for r in f(df.repartition(1)).collect()) == sorted(r["id"] for r in f(df.repartition(11)).collect())
    assert 300 < sample.hash_sample(df, F.col("id"), 0.2, 1).count() < 500


def test_first_wins_and_stats(spark):
    df = spark.createDataFrame([(3, "A  b"), (1, " a B "), (2, None), (4, ""), (5, "c")], "id int, body string")
    assert sorted(r["id"] for r in dedup.first_wins(df, dedup.body_key(F.col("body")), ["id"]).collect()) == [1, 2, 5]
    assert tuple(dedup.dup_stats(df, "id", "body").first())[:3] == (5, 5, 4)


def test_features_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, "x"), (2, "a/b/c", "2020", ["x@y.example"], [], "Re: x", "Hi all\n" + "w " * 50_000, "", "call 555-010-1234 $5 www.x.example", "a@in.example", "y")], "email_id int, file string, date string, to_addrs array<string>, cc_addrs array<string>, subject string, body string, trailer string, raw_body string, from_addr string, n_to string")
    got = {r["email_id"]: r for r in profile.featurize(df.drop("n_to"), "in.example", "acme").collect()}
    assert got[1]["body_words"] == 0 and got[1]["folder_type"] == "unknown" and got[1]["n_lines"] == 1
    r = got[2]
    assert (r["body_words"], r["is_re"], r["has_greeting"], r["n_phones"], r["n_money"], r["n_urls"], r["external_sender"]) == (50_002, True, True, 1, 1, 1, False)
    assert profile.summarize(profile.featurize(df.limit(0), "in.example", "acme")).count() == 0
