"""Sinks: SAM rows, junction, signal, count and matrix tables as text. Directories of part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import mapq


def _tsv(*columns) -> Column:
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def sam_rows(alignments: DataFrame) -> DataFrame:
    """(value): SAM lines of (name, flag, chr, pos 0-based, nh, hit, cigar, seq, qual, score, nm)."""
    tags = F.concat_ws("\t", F.concat(F.lit("NH:i:"), F.col("nh")), F.concat(F.lit("HI:i:"), F.col("hit")), F.concat(F.lit("AS:i:"), F.col("score")), F.concat(F.lit("nM:i:"), F.col("nm")))
    return alignments.select(_tsv(F.col("name"), F.col("flag"), F.col("chr"), F.col("pos") + 1, mapq(F.col("nh")), F.col("cigar"), F.lit("*"), F.lit(0), F.lit(0), F.col("seq"), F.col("qual"), tags).alias("value"))


def sam_header(chromosomes: DataFrame, groups: list[str] = (), program: str = "strandloom", comments: list[str] = ()) -> list[str]:
    """Header lines; one row per chromosome comes to the driver."""
    rows = [f"@SQ\tSN:{r['chr']}\tLN:{r['length']}" for r in chromosomes.orderBy("chr").toLocalIterator()]
    return ["@HD\tVN:1.4\tSO:coordinate", *rows, *(f"@RG\t{g}" for g in groups), f"@PG\tID:{program}", *(f"@CO\t{c}" for c in comments)]


def junction_rows(junctions: DataFrame) -> DataFrame:
    """(value): nine columns, 1-based intron bounds, the left overhang."""
    c = F.col
    return junctions.select(_tsv(c("chr"), c("start") + 1, c("end"), c("strand"), c("motif"), c("annot"), c("n_uniq"), c("n_multi"), c("over_left")).alias("value"))


def bedgraph_rows(runs: DataFrame, scale: float | None = None) -> DataFrame:
    """(value): chr, start, end, value; five decimals, scaled to reads per million if asked."""
    value = F.col("value") * (1.0 if scale is None else scale)
    return runs.select(_tsv(F.col("chr"), F.col("start"), F.col("end"), F.format_string("%.5f", value)).alias("value"))


def gene_count_rows(counts: DataFrame, unmapped: int = 0) -> DataFrame:
    """(ord, value): the four summary rows first, then genes by name; missing summary rows as zero."""
    spark = counts.sparkSession
    heads = ["N_unmapped", "N_multimapping", "N_noFeature", "N_ambiguous"]
    extra = spark.createDataFrame([("N_unmapped", unmapped)] + [(h, 0) for h in heads[1:]], "gene string, z long").select("gene", *(F.col("z").alias(m) for m in ("unstranded", "same", "reverse")))
    whole = counts.unionByName(extra).groupBy("gene").agg(*(F.sum(m).alias(m) for m in ("unstranded", "same", "reverse")))
    order = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(h) for h in heads)), F.col("gene")), F.lit(0).cast("long")), F.lit(99).cast("long"))
    return whole.select(order.alias("ord"), "gene", _tsv(F.col("gene"), F.col("unstranded"), F.col("same"), F.col("reverse")).alias("value")).orderBy("ord", "gene").select("value")


def matrix_rows(counts: DataFrame, features: int, cells: int, kind: str = "integer", value: str = "n_umis") -> DataFrame:
    """(value): a MatrixMarket file's lines, header first, then entries (gene, cb, value; 1-based) by cell and gene.

    Range-sorted, so part files in their order are the file.
    """
    entries = counts.count()
    head = [f"%%MatrixMarket matrix coordinate {kind} general", "%", f"{features} {cells} {entries}"]
    top = counts.sparkSession.createDataFrame([(-1, i, x) for i, x in enumerate(head)], "a long, b long, value string")
    rows = counts.select(F.col("cb").cast("long").alias("a"), F.col("gene").cast("long").alias("b"), F.concat_ws(" ", F.col("gene"), F.col("cb"), F.col(value)).alias("value"))
    return top.unionByName(rows).repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("value")


def write_matrix(counts: DataFrame, path: str, features: DataFrame, barcodes: DataFrame, kind: str = "integer", value: str = "n_umis", name: str = "matrix.mtx") -> None:
    """A matrix folder: features.tsv (id, name, type), barcodes.tsv and the matrix of (cb, gene, value) with ids of both, each as part files in order.

    features has (gene_id, name, type), barcodes (cb); genes and cells are numbered from 1 in the order of their ids.
    """

    def numbered(rows: DataFrame, column: str, out: str) -> DataFrame:
        ids = rows.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id())
        sizes = ids.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = F.row_number().over(Window.partitionBy("_p").orderBy(column))
        return ids.join(F.broadcast(sizes), "_p").withColumn(out, F.col("_before") + within).select(column, out)

    genes, cells = numbered(features, "gene_id", "_g"), numbered(barcodes, "cb", "_c")
    features.select(F.concat_ws("\t", "gene_id", "name", "type").alias("value"), "gene_id").repartitionByRange("gene_id").sortWithinPartitions("gene_id").select("value").write.mode("overwrite").text(f"{path}/features.tsv")
    barcodes.select(F.col("cb").cast("string").alias("value"), "cb").distinct().repartitionByRange("cb").sortWithinPartitions("cb").select("value").write.mode("overwrite").text(f"{path}/barcodes.tsv")
    entries = counts.withColumnRenamed("gene", "gene_id").join(genes, "gene_id").join(cells, "cb").select(F.col("_g").alias("gene"), F.col("_c").alias("cb"), F.col(value))
    matrix_rows(entries, features.count(), barcodes.select("cb").distinct().count(), kind, value).write.mode("overwrite").text(f"{path}/{name}")


def tagged_sam_rows(alignments: DataFrame) -> DataFrame:
    """(value): SAM lines with mate fields and tags NH HI AS nM NM MD jM jI XS MC RG, each tag where its column is not null.

    Columns: name, flag, chr, pos (0-based), nh, hit, cigar, mate_chr, mate_pos, tlen, seq, qual, and score, nm, edit, md, motifs (array), introns (array of start, end), xs, mate_cigar, group.
    """
    c = F.col

    def tag(name: str, kind: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}:{kind}:"), value.cast("string"))

    def listed(name: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}:B:"), F.array_join(F.concat(F.array(F.lit("i" if name == "jI" else "c")), values.cast("array<string>")), ","))).otherwise(F.lit(f"{name}:B:" + ("i,-1" if name == "jI" else "c,-1")))

    bounds = F.flatten(F.transform("introns", lambda j: F.array(j["start"] + 1, j["end"])))
    tags = [tag("NH", "i", c("nh")), tag("HI", "i", c("hit")), tag("AS", "i", c("score")), tag("nM", "i", c("nm")), tag("NM", "i", c("edit")), tag("MD", "Z", c("md")), listed("jM", c("motifs")), listed("jI", bounds), tag("XS", "A", c("xs")), tag("MC", "Z", c("mate_cigar")), tag("RG", "Z", c("group"))]
    same = F.when(c("mate_chr").isNull(), F.lit("*")).when(c("mate_chr") == c("chr"), F.lit("=")).otherwise(c("mate_chr"))
    fields = _tsv(c("name"), c("flag"), c("chr"), c("pos") + 1, mapq(c("nh")), c("cigar"), same, F.coalesce(c("mate_pos") + 1, F.lit(0)), F.coalesce(c("tlen"), F.lit(0)), c("seq"), c("qual"))
    return alignments.select(F.concat_ws("\t", fields, *tags).alias("value"))


def gtf_rows(features: DataFrame) -> DataFrame:
    """(value): GTF lines of (chr, source, feature, start 0-based, end, score, strand, frame, attributes)."""
    c = F.col
    dot = lambda n: F.coalesce(c(n).cast("string"), F.lit("."))
    return features.select(F.concat_ws("\t", c("chr"), dot("source"), dot("feature"), (c("start") + 1).cast("string"), c("end").cast("string"), dot("score"), dot("strand"), dot("frame"), F.coalesce(c("attributes"), F.lit(""))).alias("value"))


def wiggle_rows(runs: DataFrame) -> DataFrame:
    """(value): a variableStep line for each run of coverage, with its span."""
    span = F.col("end") - F.col("start")
    return runs.select(F.concat(F.lit("variableStep chrom="), F.col("chr"), F.lit(" span="), span.cast("string"), F.lit("\n"), (F.col("start") + 1).cast("string"), F.lit(" "), F.format_string("%.5f", F.col("value"))).alias("value"))


def signal_scales(reads: DataFrame) -> DataFrame:
    """(unique, all): factors to reads per million, from (read_id, nh) with a row per locus."""
    return reads.agg((F.lit(1e6) / F.count_if(F.col("nh") == 1)).alias("unique"), (F.lit(1e6) / F.sum(F.lit(1.0) / F.col("nh"))).alias("all"))


def summary_rows(one: DataFrame) -> DataFrame:
    """(value): label and value lines of a one-row statistics table."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in one.columns))).alias("p")
    return one.select(pairs).select(F.concat_ws(" |\t", "p.k", "p.v").alias("value"))


def split_lifted(lifted: DataFrame, path: str) -> None:
    """Lifted features and the others, as the folders lifted=true and lifted=false of one write."""
    lifted.write.mode("overwrite").partitionBy("lifted").csv(path, sep="\t")
