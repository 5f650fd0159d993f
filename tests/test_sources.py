"""Sources, sinks and the stream on tiny files."""

from pyspark.sql import functions as F

from strandloom.sources import reads, references, sinks
from strandloom.streaming.partials import merged, stream_counts


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fastq_and_mates(spark, tmp_path):
    a = put(tmp_path, "1.fq", "@r1 1:Y:0\nACGT\n+\nIIII\n@r2 1:N:0\nGG\n+\nII\n")
    b = put(tmp_path, "2.fq", "@r1 2:Y:0\nTTTT\n+\nJJJJ\n@r2\nCC\n+\nJJ\n")
    got = sorted((r["ordinal"], r["name"], r["filter"], r["seq1"], r["seq2"]) for r in reads.mates(reads.fastq(spark, a), reads.fastq(spark, b)).collect())
    assert got == [(0, "r1", "Y", "ACGT", "TTTT"), (1, "r2", "N", "GG", "CC")]
    assert reads.fastq(spark, a, limit=1).count() == 1


def test_fasta_genome(spark, tmp_path):
    p = put(tmp_path, "g.fa", ">c1 first\nacg\nTTT\n>c2\nA\n")
    chrom, tiles = references.genome(spark, p, tile=4)
    assert {(r["chr"], r["length"]) for r in chrom.collect()} == {("c1", 6), ("c2", 1)}
    assert {(r["chr"], r["tile"], r["seq"]) for r in tiles.collect()} == {("c1", 0, "ACGT"), ("c1", 1, "TT"), ("c2", 0, "A")}


def test_sam(spark, tmp_path):
    p = put(tmp_path, "a.sam", "@HD\tVN:1\nr\t16\tc\t5\t255\t4M\t*\t0\t0\tAACG\tABCD\tNH:i:1\tHI:i:1\n")
    rows = reads.sam(spark, p)
    one = reads.sam_reads(rows).first()
    assert rows.first()["tags"] == ["NH:i:1", "HI:i:1"] and (one["seq"], one["qual"]) == ("CGTT", "DCBA")
    assert reads.sam_header(spark, p).count() == 1


def test_annotation(spark, tmp_path):
    p = put(tmp_path, "a.gtf", '#x\nc\ts\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t"; gene_name "N";\nc\ts\texon\t31\t40\t.\t-\t.\tnote "x";\nc\ts\tgene\t1\t2\t.\t+\t.\tgene_id "g";\n')
    got = sorted((r["start"], r["end"], r["strand"], r["transcript"], r["gene"], r["gene_name"]) for r in references.gtf(spark, p).collect())
    assert got == [(10, 20, 1, "t", "g", "N"), (30, 40, 2, "tr_c_31_40", "MissingGeneID", "MissingGeneID")]


def test_variants_junctions_chain_matrix(spark, tmp_path):
    v = put(tmp_path, "v.vcf", "##h\n#CHROM\nc\t5\t.\tA\tG\t.\t.\t.\tGT\t0|1\nc\t6\t.\tA\tG,T\t.\t.\t.\tGT\t1/2\nc\t7\t.\tA\tG\t.\t.\t.\tGT\t0/0\nc\t8\t.\tAT\tG\t.\t.\t.\tGT\t0/1\nc\t9\t.\tA\tG\t.\t.\t.\tGT\t1/1\nc\t10\t.\tA\tG\t.\t.\t.\tGT\t./.\n")
    assert {(r["pos"], r["a1"], r["a2"]) for r in references.vcf(spark, v).collect()} == {(4, "A", "G"), (5, "G", "T"), (8, "G", "G")}
    assert references.vcf(spark, v, hetero_only=True).count() == 2
    j = put(tmp_path, "j.tab", "c\t10\t20\t+\nc\t30\t40\t2\nc\t50\t60\t.\n")
    assert {(r["start"], r["end"], r["strand"]) for r in references.junction_list(spark, j).collect()} == {(9, 20, 1), (29, 40, 2), (49, 60, 0)}
    c = put(tmp_path, "l.chain", "chain 1 a 100 + 10 60 b 100 + 5 50 1\n10 5 0\n20 0 3\n15\n")
    assert {(r["start1"], r["len"], r["start2"]) for r in references.chain(spark, c).collect()} == {(10, 10, 5), (25, 20, 15), (45, 15, 38)}
    m = put(tmp_path, "m.mtx", "%%MatrixMarket\n%\n3 2 2\n1 1 2.5\n3 2 1\n")
    assert {(r["gene"], r["cb"], r["n_umis"]) for r in references.matrix(spark, m).collect()} == {(1, 1, 3), (3, 2, 1)}
    w = put(tmp_path, "w.txt", "ACGT\nACGN\nACGT\n")
    assert references.whitelist(spark, w).count() == 1


def test_sinks(spark, tmp_path):
    sj = spark.createDataFrame([("c", 9, 20, 1, 1, 0, 3, 1, 12)], "chr string, start long, end long, strand int, motif int, annot int, n_uniq long, n_multi long, over_left int")
    assert sinks.junction_rows(sj).first()["value"] == "c\t10\t20\t1\t1\t0\t3\t1\t12"
    counts = spark.createDataFrame([("g", 1, 2, 3), ("N_ambiguous", 4, 0, 0)], "gene string, unstranded long, same long, reverse long")
    assert [r["value"] for r in sinks.gene_count_rows(counts, 7).collect()] == ["N_unmapped\t7\t7\t7", "N_multimapping\t0\t0\t0", "N_noFeature\t0\t0\t0", "N_ambiguous\t4\t0\t0", "g\t1\t2\t3"]
    runs = spark.createDataFrame([("c", 0, 5, 1.5)], "chr string, start long, end long, value double")
    assert sinks.bedgraph_rows(runs).first()["value"] == "c\t0\t5\t1.50000"
    m = spark.createDataFrame([("gA", "AAAC", 2), ("gC", "AAAC", 1), ("gC", "TTTT", 5)], "gene string, cb string, n_umis long")
    genes = spark.createDataFrame([(g, g.lower(), "Gene Expression") for g in ("gC", "gA", "gB")], "gene_id string, name string, type string")
    cells = spark.createDataFrame([("TTTT",), ("AAAC",), ("CCCC",)], "cb string")
    sinks.write_matrix(m, str(tmp_path / "mtx"), genes, cells)

    def lines(name):
        folder = tmp_path / "mtx" / name
        return [x for part in sorted(folder.glob("part-*")) for x in part.read_text().splitlines()]

    assert lines("matrix.mtx") == ["%%MatrixMarket matrix coordinate integer general", "%", "3 3 3", "1 1 2", "3 1 1", "3 3 5"]
    assert lines("features.tsv") == ["gA\tga\tGene Expression", "gB\tgb\tGene Expression", "gC\tgc\tGene Expression"] and lines("barcodes.tsv") == ["AAAC", "CCCC", "TTTT"]
    assert sinks.gtf_rows(spark.createDataFrame([("c", None, "exon", 0, 9, None, "+", None, 'gene_id "g";')], "chr string, source string, feature string, start long, end long, score double, strand string, frame string, attributes string")).first()["value"] == 'c\t.\texon\t1\t9\t.\t+\t.\tgene_id "g";'
    assert sinks.wiggle_rows(runs).first()["value"] == "variableStep chrom=c span=5\n1 1.50000"


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).select((F.col("id") % 7).alias("k")).repartition(5).write.parquet(src)
    stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 2).parquet(src)
    stream_counts(spark, stream, ["k"], str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["k"], r["n"]) for r in merged(spark, str(tmp_path / "out"), ["k"]).collect()}
    assert got == {(r["k"], r["count"]) for r in spark.read.parquet(src).groupBy("k").count().collect()}
