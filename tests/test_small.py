"""Small operators and sources, each on rows worked out by hand."""

from pyspark.sql import functions as F

from strandloom.functions import sequence
from strandloom.operators import alignments, barcodes, chimeras, reports, seeds
from strandloom.sources import reads, references, sinks


def test_sources(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a_1.fq\ta_2.fq\ts1\nb.fq\t-\tID:s2\tPL:x\n")
    (tmp_path / "c.txt").write_text("AAAC 1\nTTTT\t2\n")
    assert [tuple(r) for r in reads.manifest(spark, str(tmp_path / "m.tsv")).collect()] == [("a_1.fq", "a_2.fq", "ID:s1"), ("b.fq", None, "ID:s2\tPL:x")]
    assert {tuple(r) for r in references.clusters(spark, str(tmp_path / "c.txt")).collect()} == {("AAAC", 1), ("TTTT", 2)}
    ex = spark.createDataFrame([("c", 0, 10), ("c", 5, 12), ("d", 0, 1)], "chr string, start long, end long")
    assert references.within_chromosomes(ex, spark.createDataFrame([("c", 11)], "chr string, length long")).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("f1", 5, True), ("f2", 7, False), ("f3", 9, True)], "id string, start long, lifted boolean")
    sinks.split_lifted(rows, str(tmp_path / "out"))
    assert {r["_c0"] for r in spark.read.csv(str(tmp_path / "out/lifted=true"), sep="\t").collect()} == {"f1", "f3"}
    assert [r["value"] for r in sinks.summary_rows(spark.createDataFrame([(3, 1.5)], "reads long, part double")).collect()] == ["reads |\t3", "part |\t1.5"]
    head = sinks.sam_header(spark.createDataFrame([("c2", 5), ("c1", 9)], "chr string, length long"), ["ID:a"], comments=["x"])
    assert head[1:4] == ["@SQ\tSN:c1\tLN:9", "@SQ\tSN:c2\tLN:5", "@RG\tID:a"] and head[-1] == "@CO\tx"
    al = spark.createDataFrame([("r", 0, "c", 9, 1, 1, "4M", "ACGT", "IIII", 4, 0)], "name string, flag int, chr string, pos long, nh int, hit int, cigar string, seq string, qual string, score int, nm int")
    assert sinks.sam_rows(al).first()["value"] == "r\t0\tc\t10\t255\t4M\t*\t0\t0\tACGT\tIIII\tNH:i:1\tHI:i:1\tAS:i:4\tnM:i:0"


def test_operators(spark):
    m = spark.createDataFrame([(1, 10), (1, 12), (2, 8), (2, 8), (3, 9)], "query int, len int")
    assert sorted((r["query"], r["len"], r["n_rep"]) for r in seeds.best_seed(m, most=1).collect()) == [(1, 12, 1), (3, 9, 1)]
    assert chimeras.candidates(spark.createDataFrame([(1, 80, 100), (2, 81, 100)], "read_id int, score int, l_read int")).count() == 1
    dealt = barcodes.by_barcode(spark.range(50).select((F.col("id") % 5).alias("cb"), "id"), 3)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.withColumn("p", F.spark_partition_id()).groupBy("cb").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    order = spark.createDataFrame([("b", 1, 1), (None, 0, 2), ("a", 5, 3), ("a", 2, 4)], "chr string, pos long, read_id long")
    assert [r["read_id"] for r in alignments.coordinate_sort(order, 2).collect()] == [4, 3, 1, 2]
    best = spark.createDataFrame([(1, 1, 9, 50), (1, 2, 9, 40), (1, 3, 8, 30)], "read_id long, align_idx int, score int, span long")
    assert {r["align_idx"] for r in alignments.mark_primary(best).where("primary").collect()} == {2} and alignments.mark_primary(best, "AllBestScore").where("primary").count() == 2
    first, again = ({r["align_idx"] for r in alignments.mark_primary(best, "Random").where("primary").collect()} for _ in range(2))
    assert first == again and len(first) == 1
    ready = spark.createDataFrame([(1, [(-1, 5)], 0, 101, True), (2, [(1, 90)], 3, 101, False), (3, [], 40, 101, True)], "read_id int, gaps array<struct<kind:int,len:int>>, extended_mm int, l_read int, both_mates boolean")
    assert {r["read_id"] for r in alignments.transcriptome_ready(ready).collect()} == {2} and alignments.transcriptome_ready(ready, True).count() == 0
    row = spark.range(1).select(sequence.valid_umi(F.lit("AAAA")).alias("a"), sequence.valid_umi(F.lit("ACGT")).alias("b"), sequence.hamming(F.lit("ACGT"), F.lit("AGGA")).alias("h"), sequence.clamp_quality(F.lit("!~"), shift=31).alias("q"), sequence.motif_strand(F.lit(4)).alias("s")).first()
    assert (row.a, row.b, row.h, row.q, row.s) == (False, True, 2, "@~", 2)
    logs = spark.createDataFrame([("A", "reads", "5"), ("B", "reads", "7"), ("B", "bases", "9")], "sample string, label string, value string")
    assert {tuple(r) for r in reports.merge_logs(logs, ["A", "B"]).collect()} == {("reads", "5", "7"), ("bases", None, "9")}
    pair = spark.createDataFrame([("c1", 10, "+", "c2", 20, "-", 1, 0, 2, "r", 5, "5M", 21, "6M")], "chr_donor string, first_donor int, strand_donor string, chr_acceptor string, first_acceptor int, strand_acceptor string, motif int, repeat_left int, repeat_right int, name string, start_1 int, cigar_1 string, start_2 int, cigar_2 string")
    assert chimeras.junction_rows(pair).first()["value"] == "c1\t10\t+\tc2\t20\t-\t1\t0\t2\tr\t5\t5M\t21\t6M"
