"""Alleles of single-nucleotide variants that aligned blocks cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join


def read_alleles(blocks: DataFrame, snps: DataFrame, bin_size: int = 1 << 12) -> DataFrame:
    """(read_id, chr, pos, allele) of blocks (read_id, chr, start, end, seq): 1 or 2 by genotype, 3 neither, 4 unknown base.

    seq is the block's read sequence, so its base over a variant is at pos - start.
    """
    points = snps.select("chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "ref", "a1", "a2")
    hit = overlap_join(blocks.select("read_id", "chr", "start", "end", "seq"), points, ["chr"], bin_size)
    base = F.substring(F.col("seq"), (F.col("r_start") - F.col("start") + 1).cast("int"), F.lit(1))
    code = F.when(base == F.col("a1"), 1).when(base == F.col("a2"), 2).when(base.isin("A", "C", "G", "T"), 3).otherwise(4)
    return hit.select("read_id", "chr", F.col("r_start").alias("pos"), code.alias("allele"))
