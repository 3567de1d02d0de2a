"""Comparing rewritten messages with their sources: copying, fidelity, agreement, retrieval, detectability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from postloom.functions import text

FLAGS = ("has_greeting", "has_signoff", "has_trailer", "all_lower", "has_url", "mentions_attachment")


def copy_ratio(derived: Column, source: Column, n: int = 8) -> Column:
    """Share of the derived text's distinct n-grams of words that the source has; 0 without n-grams."""
    a, b = text.ngrams(text.tokens(F.coalesce(derived, F.lit(""))), n), text.ngrams(text.tokens(F.coalesce(source, F.lit(""))), n)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def distinct_n(df: DataFrame, by: str, c: Column, n: int) -> DataFrame:
    """Distinct n-grams over all n-grams, pooled over the texts of each group."""
    grams = df.select(by, F.explode(text.ngrams_all(text.tokens(F.coalesce(c, F.lit(""))), n)).alias("g")).groupBy(by, "g").agg(F.count("*").alias("k"))
    return grams.groupBy(by).agg(F.count("*").alias("n_distinct"), F.sum("k").alias("n_all")).withColumn("ratio", F.round(F.col("n_distinct") / F.col("n_all"), 6))


def spearman(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties, for each group.

    Values are counted first, so ranks are cumulative sums over distinct values; no group's rows are sorted in one task.
    """
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str) -> DataFrame:
        before = Window.partitionBy(by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(by, c).agg(F.count("*").alias("k"))
        return counts.select(by, c, (F.coalesce(F.sum("k").over(before), F.lit(0)) + (F.col("k") + 1) / 2).alias(f"rank_{c}"))

    pairs = rows.groupBy(by, a, b).agg(F.count("*").alias("w")).join(ranks(a), [by, a]).join(ranks(b), [by, b])
    x, y, w = F.col(f"rank_{a}"), F.col(f"rank_{b}"), F.col("w")
    sums = pairs.groupBy(by).agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    cov, vx, vy = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    return sums.select(by, F.round(F.try_divide(cov, F.sqrt(vx * vy)), 6).alias("spearman"))


def ks(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between two columns, for each group, with its asymptotic p-value. Nulls are left out of their sample."""
    long = df.select(by, F.explode(F.array(F.struct(F.col(a).alias("v"), F.lit(1).alias("side")), F.struct(F.col(b).alias("v"), F.lit(0).alias("side")))).alias("x")).select(by, "x.v", "x.side").filter("v is not null")
    counts = long.groupBy(by, "v").agg(F.sum("side").alias("na"), F.sum(1 - F.col("side")).alias("nb"))
    up_to, whole = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    gaps = counts.select(by, F.sum("na").over(whole).alias("ta"), F.sum("nb").over(whole).alias("tb"), F.abs(F.sum("na").over(up_to) / F.sum("na").over(whole) - F.sum("nb").over(up_to) / F.sum("nb").over(whole)).alias("gap"))
    found = gaps.groupBy(by).agg(F.max("gap").alias("d"), F.max("ta").alias("ta"), F.max("tb").alias("tb"))
    scaled = F.sqrt(F.col("ta") * F.col("tb") / (F.col("ta") + F.col("tb"))) * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * scaled * scaled))
    return found.select(by, F.round("d", 6).alias("ks"), F.round(F.when(scaled < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series))), 6).alias("ks_p"))


def fidelity(pairs: DataFrame, by: str) -> DataFrame:
    """Summary of paired structural features o_* (source) and s_* (derived), for each group."""
    ratio = (F.col("s_body_words") + 1) / (F.col("o_body_words") + 1)
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    one = pairs.withColumn("ratio", ratio).groupBy(by).agg(
        F.count("*").alias("n"),
        *(F.round(F.percentile("ratio", F.lit(p)), 6).alias(f"ratio_q{round(100 * p)}") for p in (0.25, 0.5, 0.75)),
        *(rate(F.col(f"o_{f}").eqNullSafe(F.col(f"s_{f}"))).alias(f"{f}_agree") for f in FLAGS),
        *(rate(F.col(f"o_{f}")).alias(f"{f}_source_rate") for f in FLAGS),
        *(rate(F.col(f"s_{f}")).alias(f"{f}_derived_rate") for f in FLAGS),
    )
    return one.join(spearman(pairs, by, "o_body_words", "s_body_words"), by).join(ks(pairs, by, "o_body_words", "s_body_words"), by)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows on which two labels agree, and Cohen's kappa; rows where a label is null are left out. Without rows kappa is null, without variation 1."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    left, right = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("l")), cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "c").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("chance"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    po, pe = F.try_divide("same", "n"), F.try_divide(F.col("chance"), F.col("n") * F.col("n"))
    return total.join(F.broadcast(chance)).select("n", F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).when(pe >= 1, F.lit(1.0)), 6).alias("kappa"))  # one row each


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(c: Column) -> Column:
    norm = F.sqrt(dot(c, c))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(query, id, cosine, rank): each query's ``k`` nearest other vectors, exactly; ties by id.

    The stated queries go to the tasks in blocks of about ``block`` vectors, and each task keeps the best k of its rows per query with a matrix
    product, so only k rows a task and query are shuffled. Null and zero vectors are near nothing.
    """
    import numpy as np
    import pandas as pd

    rows = queries.select("id", "vector").filter("id is not null and vector is not null")
    blocks = max(1, math.ceil(rows.count() / block))
    found = None
    for b in range(blocks):  # by hash, so blocks are of about the same size and no task sees all queries
        own = rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        ids, matrix = np.array([r["id"] for r in own], dtype=np.int64), np.array([r["vector"] for r in own], dtype=np.float64)

        def best(batches, ids=ids, matrix=matrix):
            if not len(ids):
                return
            unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
            kept = None
            for df in batches:
                if df.empty:
                    continue
                m = np.array(df["vector"].tolist(), dtype=np.float64)
                norms = np.linalg.norm(m, axis=1)
                score = unit @ (m / np.maximum(norms, 1e-300)[:, None]).T
                other = df["id"].to_numpy()
                score[(ids[:, None] == other[None, :]) | (norms == 0)[None, :]] = -np.inf
                top = min(k, score.shape[1])
                part = np.argsort(-score, axis=1, kind="stable")[:, :top]
                new = pd.DataFrame({"query": np.repeat(ids, top), "id": other[part].ravel(), "cosine": np.take_along_axis(score, part, axis=1).ravel()})
                kept = pd.concat([kept, new[np.isfinite(new["cosine"])]]).sort_values(["query", "cosine", "id"], ascending=[True, False, True]).groupby("query").head(k)
            if kept is not None:
                yield kept

        part = vectors.select("id", "vector").filter("id is not null and vector is not null").mapInPandas(best, "query long, id long, cosine double")
        found = part if found is None else found.unionByName(part)
    rounded = found.withColumn("cosine", F.round("cosine", 6))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))).filter(F.col("rank") <= k)


def mean_similarity(vectors: DataFrame, by: str) -> DataFrame:
    """Mean cosine of all pairs of each group, in closed form from the sum of its unit vectors: no pair is built. Groups of one have none."""
    parts = vectors.select(by, F.posexplode(normalised(F.col("vector"))).alias("at", "x"))
    summed = parts.groupBy(by, "at").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return summed.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).filter("n > 1").select(by, "n", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


def form_auc(features: DataFrame, label: str, key: str, folds: int = 5, repeats: int = 10, c: float = 0.5, seed: int = 0, steps: int = 12, bins: int = 10_000) -> DataFrame:
    """(auc, spread, n): mean and spread of the area under the curve of a logistic model on standardised form features, over ``repeats`` times ``folds`` hash folds.

    The models (L2, weight ``c`` of the data) are fitted together by Newton steps: each step is one pass in which every task adds up the
    gradients and second derivatives of all models, so the driver sees some numbers per model only. Areas are taken over ``bins`` bins of the scores.
    Without rows of both labels in a fold's test part the fold is left out.
    """
    import numpy as np
    import pandas as pd

    names = [x for x in features.columns if x not in (label, key)]
    m, p = repeats * folds, len(names) + 1
    split = F.array(*(F.pmod(F.xxhash64(key, F.lit(seed + r)), F.lit(folds)).cast("int") for r in range(repeats)))
    data = features.select(F.array(*(F.col(x).cast("double") for x in names)).alias("x"), F.col(label).cast("double").alias("y"), split.alias("f")).persist()
    n = data.count()

    def arrays(df: pd.DataFrame) -> tuple:
        return np.column_stack([np.ones(len(df)), np.array(df["x"].tolist())]), df["y"].to_numpy(), np.array(df["f"].tolist())

    def added(work, width: int) -> np.ndarray:
        """Sums over all rows of what ``work(x, y, f, model)`` gives for each model."""

        def run(batches):
            total = np.zeros((m, width))
            for df in batches:
                if len(df):
                    x, y, f = arrays(df)
                    for k in range(m):
                        total[k] += work(x, y, f[:, k // folds] == k % folds, k)
            yield pd.DataFrame({"model": range(m), "v": total.tolist()})

        def merge(batches):
            sums: dict[int, np.ndarray] = {}
            for df in batches:
                for k, v in zip(df["model"], df["v"]):
                    sums[k] = sums[k] + v if k in sums else np.array(v)
            if sums:
                yield pd.DataFrame({"model": list(sums), "v": [v.tolist() for v in sums.values()]})

        schema = "model int, v array<double>"
        rows = data.mapInPandas(run, schema).repartition(min(m, 8), "model").mapInPandas(merge, schema).collect()  # one row for each model
        out = np.zeros((m, width))
        for r in rows:
            out[r["model"]] = r["v"]
        return out

    sums = added(lambda x, y, test, k: np.concatenate([[np.sum(~test)], x[~test].sum(axis=0), (x[~test] ** 2).sum(axis=0)]), 1 + 2 * p)
    count = np.maximum(sums[:, :1], 1)
    mean = sums[:, 1 : 1 + p] / count
    scale = np.sqrt(np.maximum(sums[:, 1 + p :] / count - mean**2, 0))
    mean[:, 0], scale[:, 0] = 0, 1
    scale[scale < 1e-12] = 1
    w = np.zeros((m, p))
    ridge = np.eye(p)
    ridge[0, 0] = 1e-9

    def derivatives(x, y, test, k, mean=mean, scale=scale):
        z = (x[~test] - mean[k]) / scale[k]
        q = 1 / (1 + np.exp(-np.clip(z @ w[k], -30, 30)))
        return np.concatenate([z.T @ (q - y[~test]), ((z * (q * (1 - q))[:, None]).T @ z).ravel()])

    for _ in range(steps):
        d = added(derivatives, p + p * p)
        moves = np.array([np.linalg.solve(c * d[k, p:].reshape(p, p) + ridge, c * d[k, :p] + ridge @ w[k]) for k in range(m)])
        w -= moves
        if np.abs(moves).max() < 1e-6:
            break

    def score(batches):
        for df in batches:
            if len(df):
                x, y, f = arrays(df)
                parts = []
                for k in range(m):
                    test = f[:, k // folds] == k % folds
                    q = 1 / (1 + np.exp(-np.clip(((x[test] - mean[k]) / scale[k]) @ w[k], -30, 30)))
                    parts.append(pd.DataFrame({"model": k, "bin": (q * bins).astype(int), "pos": y[test], "neg": 1 - y[test]}).groupby(["model", "bin"], as_index=False).sum())
                yield pd.concat(parts)

    by_bin = data.mapInPandas(score, "model int, bin int, pos double, neg double").groupBy("model", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = Window.partitionBy("model").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows of a model
    pairs = by_bin.withColumn("lower", F.coalesce(F.sum("neg").over(below), F.lit(0.0))).groupBy("model").agg(F.try_divide(F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    out = pairs.agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("spread")).first()
    data.unpersist()
    return features.sparkSession.createDataFrame([(out["auc"], out["spread"], n)], "auc double, spread double, n long")


def markers(company: str, internal_domain: str) -> dict[str, str]:
    """Patterns of what tells the source corpus wherever it stands, by name: its firm and domain, routes of an old mail system, encoded addresses, mailto marks."""
    domain = internal_domain.replace(".", r"\.")
    return {"company": f"(?i){company}", "domain": f"(?i){domain}", "route": r"/[A-Z]{2,5}/[A-Z]{2,5}(?:@[A-Za-z]+)?", "encoded": "IMCEA[A-Z]+-", "mailto": r"(?i)\[mailto:"}


def privacy(pairs: DataFrame, key: str, names: DataFrame, found: dict[str, str]) -> DataFrame:
    """Per row of ``pairs(key, source, derived, raw, terms, own)``: which ``terms`` of the source are left in ``raw``, copying in 8-grams, markers, corpus people named, placeholders, and whether anything leaked.

    ``names(name)`` are full names of the corpus's people; those whose words all stand in ``own`` (the derived headers) don't count. They are
    joined on pairs of neighbouring words, so no text meets all of them.
    """
    from postloom.operators import redact

    words = text.tokens(F.coalesce("own", F.lit("")))
    hits = redact.name_hits(pairs.select(F.col(key).alias("doc"), F.col("raw").alias("text")), names).join(pairs.select(F.col(key).alias("doc"), words.alias("own")), "doc")
    strange = hits.filter(F.size(F.array_except(F.split("name", " "), "own")) > 0).groupBy(F.col("doc").alias(key)).agg(F.count("*").alias("n_names"))
    seen = F.array_compact(F.array(*(F.when(F.coalesce("raw", F.lit("")).rlike(p), k) for k, p in found.items())))
    rows = pairs.withColumns({"leaks": redact.leaks(F.col("raw"), F.col("terms")), "copy8": F.round(copy_ratio(F.col("derived"), F.col("source")), 6), "markers": seen, "placeholder_left": F.coalesce(F.col("raw").rlike(redact.PLACEHOLDER), F.lit(False))})
    n = F.coalesce("n_names", F.lit(0))
    return rows.join(strange, key, "left").withColumn("n_names", n).withColumn("any_leak", (F.size("leaks") > 0) | (F.size("markers") > 0) | (n > 0)).drop("source", "derived", "raw", "terms", "own")


_NAMED = (
    (r"(\p{Lu}[\p{L}'.-]+)(?:\s+\p{Lu}\.?)?\s+(\p{Lu}[\p{L}'-]+)\s*/\s*\p{Lu}", 1, 2),
    (r"(?m)^[ \t>]*(?:From|To|Cc|Sent by):[ \t]*\"?(\p{Lu}[\p{L}'-]+),\s+(\p{Lu}[\p{L}'-]+)", 2, 1),
    (r"(?m)^[ \t>]*(?:From|To|Cc|Sent by):[ \t]*\"?(\p{Lu}[\p{L}'-]+) (\p{Lu}[\p{L}'-]+)", 1, 2),
)


def source_names(c: Column) -> Column:
    """(first, last), in lower case, of the people that a text names in routes and in header lines; found by patterns of their own, not by those that scrub."""
    c = F.coalesce(c, F.lit(""))
    groups = [F.arrays_zip(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(a)), F.lower).alias("first"), F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(b)), F.lower).alias("last")) for p, a, b in _NAMED]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*groups), lambda n: (F.length(n["first"]) >= 3) & (F.length(n["last"]) >= 3))))


def survivors(names: Column, derived: Column, synthetic: Column) -> Column:
    """Which of ``names`` (see ``source_names``) a derived text still has, with or without a middle initial and over line ends; names in ``synthetic`` don't count."""
    flat = text.collapse(F.lower(F.coalesce(derived, F.lit(""))))
    left = lambda n: F.rlike(flat, F.concat(F.lit(r"(?<!\p{L})\Q"), n["first"], F.lit(r"\E(?: \p{L}\.?)? \Q"), n["last"], F.lit(r"\E(?!\p{L})")))
    return F.array_sort(F.transform(F.filter(names, lambda n: left(n) & ~F.array_contains(synthetic, F.concat_ws(" ", n["first"], n["last"]))), lambda n: F.concat_ws(" ", n["first"], n["last"])))


def pair_similarity(pairs: DataFrame, by: str) -> DataFrame:
    """(by, n, pair_cosine, random_cosine) of ``pairs(by, a, b)``: the mean cosine of paired vectors, and of all pairs of a group's a and b, in closed form from their sums. Null and zero vectors are left out."""
    unit = pairs.select(by, normalised(F.col("a")).alias("a"), normalised(F.col("b")).alias("b")).filter("a is not null and b is not null")
    paired = unit.groupBy(by).agg(F.count("*").alias("n"), F.avg(dot(F.col("a"), F.col("b"))).alias("pair"))
    sums = unit.select(by, F.posexplode(F.arrays_zip("a", "b")).alias("at", "x")).groupBy(by, "at").agg(F.sum("x.a").alias("sa"), F.sum("x.b").alias("sb"))
    whole = sums.groupBy(by).agg(F.sum(F.col("sa") * F.col("sb")).alias("q"))
    return paired.join(whole, by).select(by, "n", F.round("pair", 6).alias("pair_cosine"), F.round(F.col("q") / (F.col("n") * F.col("n")), 6).alias("random_cosine"))


def embed(texts: DataFrame, cache: DataFrame, embedder, longest: int | None = None, workers: int = 8) -> tuple[DataFrame, DataFrame]:
    """(vectors, new) of ``texts(id, text)``: vectors of length 1 from the ``cache(text_key, vector)`` first, the rest by ``embedder``, which takes a list of texts and gives a vector for each.

    The key is the SHA-1 of what is embedded, so equal texts are done once; ``longest`` gives the characters a model takes of each. Null texts have no vector.
    """
    import pandas as pd

    from postloom.plans.lineage import cut

    taken = F.col("text") if longest is None else F.left("text", F.lit(longest))
    keyed = texts.filter("text is not null").select("id", taken.alias("text")).withColumn("text_key", F.sha1("text"))
    missing = keyed.join(cache.select("text_key"), "text_key", "left_anti").dropDuplicates(["text_key"]).select("text_key", "text")

    def run(batches):
        for df in batches:
            yield pd.DataFrame({"text_key": df["text_key"], "vector": [list(map(float, v)) for v in embedder(list(df["text"]))]})

    new = cut(missing.repartition(workers).mapInPandas(run, "text_key string, vector array<double>"))
    known = cache.select("text_key", F.col("vector").cast("array<double>").alias("vector")).unionByName(new)
    return keyed.join(known, "text_key").select("id", "text_key", normalised(F.col("vector")).alias("vector")), new


def macro_mean(*rates: str) -> Column:
    """The mean of the rates that aren't null."""
    listed = F.array_compact(F.array(*(F.col(r) for r in rates)))
    return F.try_divide(F.aggregate(listed, F.lit(0.0), lambda s, x: s + x), F.size(listed))
