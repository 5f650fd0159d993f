"""Reports over result tables: matrix comparison, merges over samples, BED rows, insert sizes, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import introns


def compare_matrices(left: DataFrame, right: DataFrame) -> DataFrame:
    """(n, mard, r2) of two (cb, gene, value) tables over the entries of either; mard is the mean of |a - b| / (a + b)."""
    both = left.select("cb", "gene", F.col("value").cast("double").alias("a")).join(right.select("cb", "gene", F.col("value").cast("double").alias("b")), ["cb", "gene"], "full_outer")
    filled = both.select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")).where("a + b > 0")
    return filled.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))).alias("mard"), F.pow(F.corr("a", "b"), 2).alias("r2"))


def merge_gene_counts(tables: DataFrame, samples: list[str], column: str = "unstranded") -> DataFrame:
    """(gene, one column per sample) of (sample, gene, counts...); genes that a sample lacks count 0."""
    return tables.groupBy("gene").pivot("sample", samples).agg(F.sum(column)).na.fill(0)


def junctions_of_alignments(rows: DataFrame) -> DataFrame:
    """(read_id, chr, start, end): introns of alignments (read_id, chr, pos 0-based, cigar), each once per read."""
    return rows.select("read_id", "chr", F.explode(introns(F.col("pos"), F.col("cigar"))).alias("j")).select("read_id", "chr", "j.start", "j.end").distinct()


def extract_cells(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """The entries of called cells."""
    return counts.join(cells.select("cb"), "cb", "left_semi")


def bed12(transcripts: DataFrame) -> DataFrame:
    """(value): a BED12 line per transcript of exons (chr, start, end, strand, transcript)."""
    ex = transcripts.groupBy("chr", "transcript", "strand").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("x"))
    lo, hi = F.col("x")[0]["start"], F.array_max(F.transform("x", lambda e: e["end"]))
    sizes = F.array_join(F.transform("x", lambda e: (e["end"] - e["start"]).cast("string")), ",")
    begins = F.array_join(F.transform("x", lambda e: (e["start"] - lo).cast("string")), ",")
    sign = F.when(F.col("strand") == 1, "+").when(F.col("strand") == 2, "-").otherwise(".")
    return ex.select(F.concat_ws("\t", "chr", lo, hi, "transcript", F.lit(0), sign, lo, hi, F.lit("0"), F.size("x"), sizes, begins).alias("value"))


def end_profile(distances: DataFrame, half: int = 50) -> DataFrame:
    """(distance, n, smooth): counts per distance and their mean over ``half`` distances on either side that have counts."""
    hist = distances.groupBy("distance").agg(F.count("*").alias("n"))
    return hist.withColumn("smooth", F.avg("n").over(Window.orderBy("distance").rowsBetween(-half, half)))


def consistent_types(members: DataFrame) -> DataFrame:
    """(gene, type) of genes all of whose transcripts have one type."""
    return members.groupBy("gene").agg(F.countDistinct("type").alias("_k"), F.first("type").alias("type")).where("_k = 1").drop("_k")


def smart_seq_counts(fragments: DataFrame) -> DataFrame:
    """(cell, gene, n_reads, n_exact): reads, and distinct extended starts and lengths, per cell and gene."""
    return fragments.groupBy("cell", "gene").agg(F.count("*").alias("n_reads"), F.countDistinct(F.struct("chr", "start", "length")).alias("n_exact"))


def read_flags(reads: DataFrame, flags: list[str]) -> DataFrame:
    """(cb, one count per flag): how many of a barcode's reads have each boolean set."""
    return reads.groupBy("cb").agg(*(F.count_if(F.col(f)).alias(f) for f in flags))


def junctions_from_sam(rows: DataFrame) -> DataFrame:
    """(chr, start, end, n_uniq, n_multi): introns of alignments (read_id, chr, pos, cigar, nh); each counts once per read."""
    each = rows.select("read_id", "chr", "nh", F.explode(introns(F.col("pos"), F.col("cigar"))).alias("j"))
    once = each.groupBy("read_id", "chr", F.col("j.start").alias("start"), F.col("j.end").alias("end")).agg(F.max("nh").alias("nh"))
    return once.groupBy("chr", "start", "end").agg(F.count_if(F.col("nh") == 1).alias("n_uniq"), F.count_if(F.col("nh") > 1).alias("n_multi"))


def matrix_from_tags(alignments: DataFrame) -> DataFrame:
    """(cb, gene, n_umis) of alignments with tags (cb, umi, gene); "-" and null are no value."""
    given = [F.col(c).isNotNull() & ~F.col(c).cast("string").isin("-", "") for c in ("cb", "umi", "gene")]
    return alignments.where(given[0] & given[1] & given[2]).groupBy("cb", "gene").agg(F.countDistinct("umi").alias("n_umis"))


def insert_sizes(pairs: DataFrame, most: int = 2000) -> DataFrame:
    """(size, n) of proper pairs (start, end) of unique fragments, up to a size."""
    size = F.col("end") - F.col("start")
    return pairs.where(size.between(1, most)).groupBy(size.alias("size")).agg(F.count("*").alias("n"))


def gene_body_coverage(bases: DataFrame, parts: int = 100) -> DataFrame:
    """(part, weight): covered transcript positions (transcript, position, length) by hundredths of the length; each transcript weighs 1."""
    of = Window.partitionBy("transcript")
    placed = bases.withColumn("part", F.expr(f"position * {parts} div length")).withColumn("_n", F.count("*").over(of))
    return placed.groupBy("part").agg(F.sum(F.lit(1.0) / F.col("_n")).alias("weight"))


def merge_logs(logs: DataFrame, samples: list[str]) -> DataFrame:
    """(label, one column per sample) of (sample, label, value)."""
    return logs.groupBy("label").pivot("sample", samples).agg(F.first("value"))


def strand_tags(alignments: DataFrame, first_is_reverse: bool = True) -> DataFrame:
    """Adds xs, the transcript's strand by a stranded protocol, from the flag."""
    flag = F.col("flag")
    turned = (flag.bitwiseAND(16) > 0) != (flag.bitwiseAND(128) > 0)
    return alignments.withColumn("xs", F.when(turned == F.lit(first_is_reverse), "+").otherwise("-"))


def shifted_contigs(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """Features on contigs moved to the super-contig (contig, super, offset) that holds them; others stay."""
    joined = features.join(contigs.withColumnRenamed("contig", "chr"), "chr", "left")
    offset = F.coalesce("offset", F.lit(0))
    moved = {"chr": F.coalesce("super", "chr"), "start": F.col("start") + offset, "end": F.col("end") + offset}
    return joined.select(*(moved.get(c, F.col(c)).alias(c) for c in features.columns))


def barcode_quality(reads: DataFrame, least: int = 30, phred: int = 33) -> DataFrame:
    """(q30_barcode, q30_read): the part of bases with at least that quality, of (cb_qual, qual)."""

    def good(name):
        high = "".join(chr(c) for c in range(phred + least, 127))
        return F.length(name) - F.length(F.translate(name, high, ""))

    return reads.agg(*((F.sum(good(c)) / F.sum(F.length(c))).alias(n) for n, c in (("q30_barcode", "cb_qual"), ("q30_read", "qual"))))


def junction_feature_counts(observed: DataFrame, junctions: DataFrame) -> DataFrame:
    """(cb, junction, n_reads, n_umis): each junction of the table as a feature, counted over uniquely mapped reads (cb, umi, chr, start, end, nh)."""
    numbered = junctions.select("chr", "start", "end", F.concat_ws(":", "chr", "start", "end").alias("junction"))
    hit = observed.where("nh = 1").join(numbered, ["chr", "start", "end"])
    return hit.groupBy("cb", "junction").agg(F.count("*").alias("n_reads"), F.countDistinct("umi").alias("n_umis"))
