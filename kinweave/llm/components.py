"""Connected components by alternating stars; every round is written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.plans.lineage import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (x, y: BIGINT): the smallest node it is connected with.

    Roots are listed with themselves. Each node's larger neighbours move to its smallest one, then its
    smaller neighbours do; a long chain is folded in a logarithmic number of rounds.
    """
    stars = cut(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    state = _state(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(stars)
        if state == before:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
