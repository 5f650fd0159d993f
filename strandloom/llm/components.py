"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import settle


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge that is not its own root.

    Each round points every neighbour of a node that is larger than it at the
    smallest neighbour (large star), then every smaller one (small star); a round
    is two shuffles of at most one row per edge, and the number of rounds grows with
    the logarithm of the longest path. Nodes that are roots, or in no edge, get no
    row. Nulls and loops are ignored. The edges never leave the executors.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    pairs = settle(pairs.where("u > v").distinct())
    before = None
    for _ in range(most_rounds):
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = settle(small.select("e.u", "e.v").where("u > v").distinct())
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state := (row["n"], row["h"])) == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
