"""Reference sources: genome FASTA, GTF, junction lists, VCF, chain files, whitelists, matrices, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.mapping import tiles as cut_tiles
from .reads import _lines, fasta


def genome(spark: SparkSession, path, tile: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(chromosomes (chr, length), tiles (chr, tile, seq)): upper-case sequence in pieces of ``tile`` bases."""
    seqs = fasta(spark, path).select(F.col("name").alias("chr"), F.upper("seq").alias("seq"))
    cut = cut_tiles(seqs, tile, 0).select("chr", "tile", F.col("tile_seq").alias("seq"))
    return seqs.select("chr", F.length("seq").cast("long").alias("length")), cut


def gtf(spark: SparkSession, path, feature: str = "exon", prefix: str = "", transcript_tag: str = "transcript_id", gene_tags: tuple[str, ...] = ("gene_id",), name_tags: tuple[str, ...] = ("gene_name",), type_tags: tuple[str, ...] = ("gene_type", "gene_biotype")) -> DataFrame:
    """(chr, start, end, strand, transcript, gene, gene_name, gene_type): half-open exons.

    strand is 1, 2, or 0. Missing transcripts are named after the interval, missing
    genes MissingGeneID, missing names and types as the gene and MissingGeneType.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("not startswith(value, '#')").select(F.get(f, F.lit(0)).alias("c"), F.get(f, F.lit(2)).alias("feature"), F.get(f, F.lit(3)).try_cast("long").alias("s"), F.get(f, F.lit(4)).try_cast("long").alias("e"), F.get(f, F.lit(6)).alias("str"), F.get(f, F.lit(8)).alias("attributes")).where(F.col("feature") == feature)

    def tag(names):
        return F.coalesce(*(F.nullif(F.regexp_extract("attributes", rf'(?:^|[\s;]){n}[ =]"?([^";]+)"?', 1), F.lit("")) for n in names))

    chrom = F.concat(F.lit(prefix), F.col("c"))
    name = F.coalesce(tag((transcript_tag,)), F.concat_ws("_", F.lit("tr"), chrom, F.col("s"), F.col("e")))
    gene = F.coalesce(tag(gene_tags), F.lit("MissingGeneID"))
    return rows.select(chrom.alias("chr"), (F.col("s") - 1).alias("start"), F.col("e").alias("end"), F.when(F.col("str") == "+", 1).when(F.col("str") == "-", 2).otherwise(0).alias("strand"), name.alias("transcript"), gene.alias("gene"), F.coalesce(tag(name_tags), gene).alias("gene_name"), F.coalesce(tag(type_tags), F.lit("MissingGeneType")).alias("gene_type"))


def within_chromosomes(exons: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Exons on known chromosomes that end within them."""
    return exons.join(chromosomes, "chr").where("end <= length").drop("length")


def junction_list(spark: SparkSession, path) -> DataFrame:
    """(chr, start, end, strand): half-open introns; strand +, - or anything else as 1, 2, 0."""
    f = F.split("value", r"[ \t]+")
    strand = F.when(F.get(f, F.lit(3)).isin("+", "1"), 1).when(F.get(f, F.lit(3)).isin("-", "2"), 2).otherwise(0)
    return spark.read.text(path).where("trim(value) != ''").select(F.get(f, F.lit(0)).alias("chr"), (F.get(f, F.lit(1)).try_cast("long") - 1).alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"), strand.alias("strand"))


def vcf(spark: SparkSession, path, hetero_only: bool = False) -> DataFrame:
    """(chr, pos, ref, a1, a2): genotyped single-nucleotide variants, 0-based; homozygous reference and missing ones are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("not startswith(value, '#') and value != ''").select(F.get(f, F.lit(0)).alias("chr"), (F.get(f, F.lit(1)).try_cast("long") - 1).alias("pos"), F.get(f, F.lit(3)).alias("ref"), F.split(F.get(f, F.lit(4)), ",").alias("alts"), F.split(F.split(F.get(f, F.lit(9)), ":")[0], r"[|/]").alias("gt"))
    single = (F.length("ref") == 1) & F.forall("alts", lambda a: F.length(a) == 1)
    called = (F.size("gt") == 2) & F.forall("gt", lambda g: g.rlike("^[0-9]+$"))
    alleles = F.concat(F.array("ref"), F.col("alts"))
    out = rows.where(single & called).select("chr", "pos", "ref", F.try_element_at(alleles, F.get("gt", F.lit(0)).try_cast("int") + 1).alias("a1"), F.try_element_at(alleles, F.get("gt", F.lit(1)).try_cast("int") + 1).alias("a2"))
    out = out.where("a1 is not null and a2 is not null and not (a1 = ref and a2 = ref)")
    return out.where("a1 != a2") if hetero_only else out


def chain(spark: SparkSession, path) -> DataFrame:
    """(chr, start1, len, start2, chr2): the blocks of a chain file, starts by running sums over the lines of each chain."""
    lines = _lines(spark, path).where("trim(value) != ''").withColumn("f", F.split(F.trim("value"), r"[ \t]+"))
    w = Window.partitionBy("file").orderBy("line")
    head = F.get("f", F.lit(0)) == "chain"
    marked = lines.withColumn("_chain", F.sum(head.cast("int")).over(w)).withColumn("_head", F.last(F.when(head, F.col("f")), ignorenulls=True).over(w)).where(~head)
    num = lambda i: F.coalesce(F.try_element_at("f", F.lit(i + 1)).try_cast("long"), F.lit(0))
    before = Window.partitionBy("file", "_chain").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    s1 = F.get("_head", F.lit(5)).try_cast("long") + F.coalesce(F.sum(num(0) + num(1)).over(before), F.lit(0))
    s2 = F.get("_head", F.lit(10)).try_cast("long") + F.coalesce(F.sum(num(0) + num(2)).over(before), F.lit(0))
    return marked.select(F.get("_head", F.lit(2)).alias("chr"), s1.alias("start1"), num(0).alias("len"), s2.alias("start2"), F.get("_head", F.lit(7)).alias("chr2"))


def whitelist(spark: SparkSession, path) -> DataFrame:
    """(cb): distinct barcodes without N."""
    return spark.read.text(path).select(F.trim("value").alias("cb")).where("cb != '' and not contains(cb, 'N')").distinct()


def matrix(spark: SparkSession, path) -> DataFrame:
    """(gene, cb, n_umis): a MatrixMarket file's entries, 1-based indices, values rounded half away from zero."""
    rows = _lines(spark, path).where("not startswith(value, '%') and trim(value) != ''").withColumn("f", F.split(F.trim("value"), r"[ \t]+"))
    first = rows.groupBy("file").agg(F.min("line").alias("_dims"))
    return rows.join(first, "file").where("line > _dims").select(F.get("f", F.lit(0)).try_cast("long").alias("gene"), F.get("f", F.lit(1)).try_cast("long").alias("cb"), F.round(F.get("f", F.lit(2)).try_cast("double")).try_cast("long").alias("n_umis"))


def clusters(spark: SparkSession, path) -> DataFrame:
    """(cb, cluster)."""
    f = F.split(F.trim("value"), r"[ \t]+")
    return spark.read.text(path).where("trim(value) != ''").select(F.get(f, F.lit(0)).alias("cb"), F.get(f, F.lit(1)).try_cast("int").alias("cluster"))
