"""Samples that depend on keys and seeds only, not on the order or partitioning of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postloom.functions.hashing import sample_order


def hash_sample(df: DataFrame, key: Column, fraction: float, seed: int) -> DataFrame:
    """Each row with probability ``fraction``, decided by the first 32 bits of a hash of its key; rows with equal keys stay together. The filter runs in the scan's stage."""
    return df.filter(F.conv(F.left(sample_order(key, seed), F.lit(8)), 16, 10).cast("bigint") < int(fraction * 2**32))


def stratified(df: DataFrame, strata: list[str], key: Column, per: int, seed: int, total: int | None = None) -> DataFrame:
    """At most ``per`` rows of each stratum, in hash order; of these the first ``total``.

    Each task first keeps ``per`` rows of a stratum (Spark's group limit), so a hot stratum isn't shuffled whole.
    """
    ranked = df.withColumn("_order", sample_order(key, seed)).withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy("_order"))).filter(F.col("_rank") <= per)
    return (ranked.orderBy("_order").limit(total) if total else ranked).drop("_order", "_rank")


def first_n(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows in hash order; a sampling operator, so the limit is its purpose."""
    return df.withColumn("_order", sample_order(key, seed)).orderBy("_order").limit(n).drop("_order")


def eligible(features: DataFrame, least: int = 8, most: int = 700) -> DataFrame:
    """Messages with a date, a recipient and ``least`` to ``most`` words of new text."""
    return features.filter(F.col("body_words").between(least, most) & (F.col("n_to") > 0) & F.col("date").isNotNull())
