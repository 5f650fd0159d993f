"""Read sources: FASTQ, FASTA and SAM text, manifests. Compression is by Spark's codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, line, value): lines numbered within their file.

    Numbers need the file's order: files are read whole by one task each (text
    with wholetext off keeps the order within a split, so the number of a line is a
    running count over splits, joined back from one row per split).
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    within = Window.partitionBy("file", "_block").orderBy("_id")
    sized = raw.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = sized.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return raw.withColumn("_k", F.row_number().over(within) - 1).join(before.select("file", "_block", "_before"), ["file", "_block"]).select("file", (F.col("_before") + F.col("_k")).alias("line"), "value")


def fastq(spark: SparkSession, path, limit: int | None = None) -> DataFrame:
    """(file, ordinal, name, filter, seq, qual) of four-line records; filter is Y or N from the second word's second field."""
    lines = _lines(spark, path).withColumn("ordinal", F.expr("line div 4")).withColumn("part", (F.col("line") % 4).try_cast("int"))
    clean = F.regexp_replace("value", "[\\x00-\\x1F]", "")
    wide = lines.groupBy("file", "ordinal").agg(*(F.max(F.when(F.col("part") == p, clean)).alias(n) for p, n in ((0, "head"), (1, "seq"), (3, "qual"))))
    flag = F.coalesce(F.nullif(F.regexp_extract("head", r"^\S+\s+[^:\s]*:([YN]):", 1), F.lit("")), F.lit("N"))
    out = wide.select("file", "ordinal", F.regexp_extract("head", r"^@(\S+)", 1).alias("name"), flag.alias("filter"), "seq", "qual")
    return out if limit is None else out.where(F.col("ordinal") < limit)


def fasta(spark: SparkSession, path, quality: str = "A") -> DataFrame:
    """(file, ordinal, name, seq, qual) of records whose sequence may span lines."""
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>", "")).where(F.trim("value") != "").withColumn("file", F.col("_metadata.file_path")).withColumn("_id", F.monotonically_increasing_id())
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    w = Window.partitionBy("file").orderBy("_id")
    return records.select("file", (F.row_number().over(w) - 1).try_cast("long").alias("ordinal"), F.regexp_extract("value", r"^(\S+)", 1).alias("name"), seq.alias("seq")).withColumn("qual", F.repeat(F.lit(quality), F.length("seq")))


def mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two read tables zipped by ordinal; the name and filter are the first mate's."""
    b = second.select("ordinal", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return first.withColumnsRenamed({"seq": "seq1", "qual": "qual1"}).join(b, "ordinal")


def sam(spark: SparkSession, path) -> DataFrame:
    """(file, line, qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags) of alignment lines."""
    f = F.split("value", "\t")
    names = (("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string"))
    rows = _lines(spark, path).where("not startswith(value, '@') and value != ''")
    return rows.select("file", "line", *(F.get(f, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)), F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))).alias("tags"))


def sam_header(spark: SparkSession, path) -> DataFrame:
    """The header lines."""
    return spark.read.text(path).where("startswith(value, '@')")


def sam_reads(rows: DataFrame) -> DataFrame:
    """Original reads of SAM rows: reverse-strand ones are complemented back."""
    back: Column = F.col("flag").bitwiseAND(16) > 0
    return rows.select("file", "line", "qname", F.when(F.col("flag").bitwiseAND(64) > 0, 1).when(F.col("flag").bitwiseAND(128) > 0, 2).otherwise(0).alias("mate"), F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), "tags")


def manifest(spark: SparkSession, path) -> DataFrame:
    """(read1, read2, read_group): read2 is null for "-"; a bare group name gets its ID tag."""
    f = F.split("value", "\t")
    group = F.when(F.startswith(F.get(f, F.lit(2)), F.lit("ID:")), F.array_join(F.slice(f, 3, F.size(f)), "\t")).otherwise(F.concat(F.lit("ID:"), F.get(f, F.lit(2))))
    return spark.read.text(path).where("trim(value) != ''").select(F.get(f, F.lit(0)).alias("read1"), F.nullif(F.get(f, F.lit(1)), F.lit("-")).alias("read2"), group.alias("read_group"))
