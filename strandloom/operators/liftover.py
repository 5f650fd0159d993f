"""Coordinate lifting through chains of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import as_of


def with_next(blocks: DataFrame) -> DataFrame:
    """Adds the new start of the next block of (chr, start1, len, start2, chr2), and the chain's first."""
    w = Window.partitionBy("chr").orderBy("start1")
    return blocks.withColumn("next2", F.lead("start2").over(w))


def lift(features: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds new_chr, new_start, new_end, lifted to (chr, start, end) features, ends inclusive.

    A start in a gap moves to the next block's first base, an end in a gap to the
    last base before it; a feature that loses an end or turns around is not lifted.
    """
    chain = with_next(blocks)
    first = chain.groupBy("chr").agg(F.min_by("start2", "start1").alias("_first2"), F.min("chr2").alias("_chr2"))
    out = features
    for side in ("start", "end"):
        found = as_of(out, chain, ["chr"], side, "start1", ["len", "start2", "next2"])
        inside = F.col(side) < F.col("start1") + F.col("len")
        at = F.col("start2") + F.col(side) - F.col("start1")
        out = found.withColumn(f"_{side}", F.when(inside, at).otherwise(F.col("next2") if side == "start" else F.col("start2") + F.col("len") - 1)).withColumn("_before", F.col("start1").isNull()).drop("start1", "len", "start2", "next2")
        if side == "start":
            out = out.join(first, "chr", "left").withColumn("_start", F.when(F.col("_before"), F.col("_first2")).otherwise(F.col("_start")))
        out = out.drop("_before")
    good: Column = F.coalesce(F.col("_end") >= F.col("_start"), F.lit(False))
    return out.select(*features.columns, F.when(good, F.col("_chr2")).alias("new_chr"), F.when(good, F.col("_start")).alias("new_start"), F.when(good, F.col("_end")).alias("new_end"), good.alias("lifted"))
