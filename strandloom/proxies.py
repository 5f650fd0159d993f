"""Deterministic projections of the general tables onto the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def solo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cb, gene, umi): a read per line item; UMIs of five 2-bit bases."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cb"), (F.col("l_partkey") % 20).alias("gene"), (F.col("l_orderkey") % 1024).alias("umi"))


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junction observations per read; motif and annotation are functions of the junction."""
    start, gap = F.col("l_partkey") * 7, 21 + F.col("l_suppkey") * 11
    uniq = (F.col("l_linenumber") % 2 == 0).cast("int")
    code = (start + gap) % 7
    return _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.concat("l_returnflag", "l_linestatus").alias("chr"), start.alias("start"), (start + gap).alias("end"), (F.lit(1) + code % 2).cast("int").alias("strand"), code.cast("int").alias("motif"), ((start + gap) % 11 == 0).cast("int").alias("annot"),
        uniq.alias("n_uniq"), (1 - uniq).alias("n_multi"), F.col("l_quantity").cast("int").alias("over_left"), F.col("l_quantity").cast("int").alias("over_right"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned blocks of reads (a read per line item of an order), with loci nh per order."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    start = (day * 100 + F.col("l_orderkey") % 100).cast("long")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_returnflag").alias("chr"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), (1 + F.col("l_orderkey") % 2).cast("int").alias("strand"), (1 + F.floor(F.col("l_orderkey") / 2) % 4).cast("int").alias("nh"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene intervals from parts, on the chromosomes of blocks."""
    start = ((F.col("p_partkey") * 113) % 250_000).cast("long")
    chrom = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 2).alias("gene"), chrom.alias("chr"), start.alias("start"), (start + 50 + F.col("p_size") * 20).alias("end"), (F.col("p_partkey") % 3).cast("int").alias("strand"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of reads: an order's line items, scored by price."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("align_idx"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("score"), F.col("l_quantity").cast("long").alias("span"))


def barcodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(whitelist, reads): suppliers' keys as 8-base codes; a read in three has one base changed."""
    known = _t(spark, sf_dir, "supplier").select(((F.col("s_suppkey") * 37) % 65_536).alias("code")).distinct()
    code = (F.col("l_suppkey") * 37) % 65_536
    flip = F.expr("shiftleft(1L, cast(2 * (l_orderkey % 8) as int))")
    changed = F.when(F.col("l_orderkey") % 3 == 0, code.bitwiseXOR(flip)).otherwise(code)
    reads = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("read_id"), changed.alias("code"), (F.lit(35) + F.col("l_quantity").cast("int") % 30).alias("quality"))
    return known, reads.groupBy("read_id", "code").agg(F.max("quality").alias("quality"))


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(features, blocks): intervals of events per user class, chain blocks of 60 bases in every 100."""
    second = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    at = (second % 100_000).alias("start")
    features = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("chr"), at).withColumn("end", F.col("start") + F.col("id") % 150)
    kinds = features.select("chr").distinct()
    steps = kinds.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(999))))
    blocks_ = steps.select("chr", (F.col("i") * 100).cast("long").alias("start1"), F.lit(60).cast("long").alias("len"), (F.col("i") * 90 + 7).cast("long").alias("start2"), F.concat(F.lit("new_"), F.col("chr")).alias("chr2"))
    return features, blocks_


def spliced_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three exons of 100 bases per part, 300 apart."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("transcript"), F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("i"))
    begin = F.col("transcript") * 1000 + F.col("i") * 300
    return part.select(F.lit("c").alias("chr"), begin.alias("start"), (begin + 100).alias("end"), "transcript")


def spliced_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reads, exons): (read_id, chr, blocks) of reads in an exon, across a junction, beside one, into an intron, or in it; equal line items are equal rows."""
    read = F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    rows = _t(spark, sf_dir, "lineitem").select(read.alias("read_id"), (F.col("l_partkey") * 1000).alias("base"), (F.col("l_linenumber") % 5).alias("kind"), (F.col("l_suppkey") % 40).alias("off"))
    base, kind, off = F.col("base"), F.col("kind"), F.col("off")

    def block(a, b):
        return F.struct((base + a).alias("start"), (base + b).alias("end"))

    shapes = F.when(kind == 0, F.array(block(off, off + 30))).when(kind == 1, F.array(block(off + 50, F.lit(100)), block(F.lit(300), off + 310))).when(kind == 2, F.array(block(off + 40, F.lit(95)), block(F.lit(300), off + 310))).when(kind == 3, F.array(block(off + 80, off + 140))).otherwise(F.array(block(off + 120, off + 150)))
    return rows.select("read_id", F.lit("c").alias("chr"), shapes.alias("blocks")), spliced_exons(spark, sf_dir)
