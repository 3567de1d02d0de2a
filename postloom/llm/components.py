"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postloom.plans.lineage import cut


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and all its neighbours. The minimum is pre-aggregated before the shuffle, so a hub of any size is one row of the joined side."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = _with_least(down)
    pairs = seen.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
    return pairs.select("e.u", "e.v").filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that stands in ``links(u, v)``; the component is its smallest id.

    Null ends and loops are ignored, so an id with loops only is absent. Rounds grow with the logarithm of the longest path. Only a count and
    a checksum come to the driver; each round is cut into the checkpoint folder.
    """
    edges = cut(links.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    # Stars already: no id is both a centre and a leaf, and no leaf has two centres. Then a round would change nothing.
    odd = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u").unionByName(edges.groupBy("u").count().filter("count > 1").select("u"))
    if before[0] and odd.limit(1).count():
        for _ in range(max_rounds):
            edges = cut(_small_star(_large_star(edges)))
            after = _state(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
