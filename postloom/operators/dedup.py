"""Exact de-duplication by normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postloom.functions import text

NORMALISERS = {"ws": text.collapse, "ws_strip_lower": text.collapse_strip_lower}


def body_key(c: Column, normaliser: str = "ws_strip_lower") -> Column:
    """Digest of the text in normal form; null counts as empty."""
    return F.md5(NORMALISERS[normaliser](F.coalesce(c, F.lit(""))))


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``. The first is found by a pre-aggregated minimum, so a key that a third of all rows have is no hot task."""
    keyed = df.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    return keyed.join(first, "_key").filter(F.struct(*order) == F.col("_first")).drop("_key", "_first")


def dup_stats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows, distinct ids and texts, share of repeats and most copies; texts with white space collapsed."""
    per = df.select(F.col(id_col).alias("i"), body_key(F.col(text_col), "ws").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    ids = df.agg(F.count("*").alias("n_rows"), F.count_distinct(id_col).alias("n_ids"))
    return per.agg(F.count("*").alias("n_bodies"), F.max("n").alias("most_copies"), F.sum("n").alias("n")).join(F.broadcast(ids)).select("n_rows", "n_ids", "n_bodies", F.round(1 - F.col("n_bodies") / F.col("n"), 6).alias("duplicate_share"), "most_copies")  # one row each
