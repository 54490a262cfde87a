"""Connected components by alternating large and small stars, on a stored table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import drop_stored, stored

ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large: every larger neighbour of a node goes to its least neighbour (or itself); small: every smaller one, and the node."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), for every node of edges (a, b); stored. Loops and repeated edges do no harm.

    Both kinds of star keep the components; together they end in stars after logarithmically many rounds.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(ROUNDS):
        new = stored(_stars(_stars(now, True), False))
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_stored(now)
        now = new
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"no components after {ROUNDS} rounds")
    return stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
