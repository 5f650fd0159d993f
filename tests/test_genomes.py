"""Genomes with variants, remapped alleles, stored indices, second passes, BAM files, oligos and read kinds."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import clip
from strandloom.operators import barcodes, genomes, mapping, seeds
from strandloom.sources import bam, reads, references

RNG = random.Random(31)
CHROM = "".join(RNG.choice("ACGT") for _ in range(900))


def sequences(spark, **named):
    return spark.createDataFrame(list(named.items()), "chr string, seq string")


def test_variants_and_the_way_back(spark):
    genome = sequences(spark, c=CHROM)
    rows = [("c", 100, CHROM[100], "A" if CHROM[100] != "A" else "C"), ("c", 200, CHROM[200:203], ""), ("c", 300, CHROM[300], CHROM[300] + "GGGG"), ("c", 201, CHROM[201], "T"), ("c", 400, "NN", "A"), ("d", 1, "A", "C")]
    new, blocks = genomes.with_variants(genome, spark.createDataFrame(rows, "chr string, pos long, ref string, alt string"), "_x")
    want = CHROM[:100] + rows[0][3] + CHROM[101:200] + CHROM[203:300] + CHROM[300] + "GGGG" + CHROM[301:]
    assert [tuple(r) for r in new.collect()] == [("c_x", want)]
    assert sorted((r["start1"], r["len"], r["start2"]) for r in blocks.collect()) == [(0, 100, 0), (101, 99, 101), (203, 97, 200), (301, 599, 302)]
    # a block in one stretch, one that starts among the inserted bases, one that lies in them
    kind = "read_id long, align_idx int, chr string, strand int, blocks array<struct<r:int,g:long,len:int>>"
    moved = genomes.to_reference(spark.createDataFrame([(1, 0, "c_x", 1, [(0, 210, 20), (20, 310, 5)]), (2, 0, "c_x", 1, [(0, 299, 10)]), (3, 0, "c_x", 1, [(0, 298, 2)])], kind), blocks)
    got = {r["read_id"]: (r["chr"], [tuple(b) for b in r["blocks"]]) for r in moved.collect()}
    assert got == {1: ("c", [(0, 213, 20), (20, 309, 5)]), 2: ("c", [(3, 301, 7)])}
    both, _ = genomes.haplotypes(genome, spark.createDataFrame([("c", 5, CHROM[5], CHROM[5], "N")], "chr string, pos long, ref string, a1 string, a2 string"))
    assert dict(both.collect()) == {"c_h1": CHROM, "c_h2": CHROM[:5] + "N" + CHROM[6:]}


def test_alleles_remapped(spark):
    other = {b: "ACGT"["ACGT".index(b) - 1] for b in "ACGT"}
    # a second place that equals the first with the other allele at 150
    twin = CHROM[400:450] + CHROM[120:150] + other[CHROM[150]] + CHROM[151:180] + CHROM[450:500]
    genome = sequences(spark, c=CHROM, t=twin)
    rows = [(1, CHROM[20:80]), (2, CHROM[120:180]), (3, CHROM[600:630] + "N" + CHROM[631:660]), (4, CHROM[700:760])]
    df = spark.createDataFrame(rows, "read_id long, seq string")
    snps = spark.createDataFrame([("c", p, CHROM[p], CHROM[p], other[CHROM[p]]) for p in (40, 60, 150, 630)], "chr string, pos long, ref string, a1 string, a2 string")
    found = mapping.align(df, genome, read_max=100, tile=64)
    best = mapping.select_multi(found)
    got = {r["read_id"]: r["type"] for r in genomes.remapped_types(best, df, genome, snps, read_max=100, tile=64).collect()}
    # 1 covers two variants and maps alike, 2 moves to the twin, 3 has an unknown base there, 4 covers none
    assert got == {1: 1, 2: 6, 3: 3}


def test_index_and_common_kmers(spark, tmp_path):
    genome = sequences(spark, c=CHROM[:300] + "A" * 200 + CHROM[300:], d=CHROM[500:800])
    df = spark.createDataFrame([(1, CHROM[280:300] + "A" * 30), (2, CHROM[510:560]), (3, "A" * 40)], "read_id long, seq string")
    mapping.write_index(genome, str(tmp_path / "index"), partitions=3)
    loaded, index = mapping.load_index(spark, str(tmp_path / "index"))

    def rows(found):
        return sorted((r["read_id"], r["chr"], r["strand"], r["score"], [tuple(b) for b in r["blocks"]]) for r in found.collect())

    assert rows(mapping.align(df, loaded, read_max=100, tile=64, index=index)) == rows(mapping.align(df, genome, read_max=100, tile=64))
    few = rows(mapping.align(df, genome, mapping.MapOptions(common=50), read_max=100, tile=64))
    assert [r for r in few if r[0] == 1] == [(1, "c", 1, 50, [(0, 280, 50)])] and not [r for r in few if r[0] == 3] and len([r for r in few if r[0] == 2]) == 2
    q, r = (spark.createDataFrame([(1, s)], f"{n} int, seq string") for n, s in (("query", CHROM[280:300] + "A" * 30), ("reference", CHROM[:300] + "A" * 200)))
    long = {(x["q_start"], x["r_start"], x["len"]) for x in seeds.maximal_matches(q, r, 12, common=50).collect()}
    assert (0, 280, 50) in long and long < {(x["q_start"], x["r_start"], x["len"]) for x in seeds.maximal_matches(q, r, 12).collect()}


def test_second_pass_prefers_found_junctions(spark):
    kind = "read_id long, align_idx int, chr string, strand int, score int, blocks array<struct<r:int,g:long,len:int>>, gaps array<struct<kind:int,len:long,annot:int>>"
    rows = [(1, 0, "c", 1, 50, [(0, 100, 50)], []), (1, 1, "c", 1, 49, [(0, 100, 44), (44, 500, 6)], [(1, 356, 0)]), (2, 0, "c", 1, 52, [(0, 100, 30), (30, 300, 30)], [(0, 170, 0)])]
    found = spark.createDataFrame(rows, kind)
    novel, none = spark.createDataFrame([("c", 144, 500)], "chr string, start long, end long"), spark.createDataFrame([], "chr string, start long, end long")
    got = {r["read_id"]: (r["align_idx"], r["score"], r["n_tr"]) for r in mapping.two_pass(found, none, novel, 0).collect()}
    assert got == {1: (1, 51, 1), 2: (0, 52, 1)}
    assert sorted((r["read_id"], r["align_idx"]) for r in mapping.in_table(found, novel).collect()) == [(1, 0), (1, 1)]


def test_bam_round_trip(spark, tmp_path):
    long = "ACGTN" * 60
    rows = [("r1", 99, "c1", 10, 255, "5S200M90N95M", "=", 500, 700, long, "I" * 300, ["NH:i:1", "MD:Z:3A2", "jM:B:c,1,2", "XS:A:+", "zf:f:0.5"]), ("r2", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "*", []), ("r3", 147, "c2", 70000, 3, "3M", "c1", 1, -5, "TTT", "#!~", [])]
    names = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags array<string>"
    df = spark.createDataFrame([(*r[:0], *r) for r in rows] + [(f"x{i}", *rows[0][1:]) for i in range(400)], names).repartition(2)
    n = bam.write_bam(df, str(tmp_path / "out"), ["@HD\tVN:1.4"], [("c1", 100_000), ("c2", 200_000)])
    back = bam.bam(spark, str(tmp_path / "out"))
    assert n == 403 and back.columns == ["file", "line", *[x.split()[0] for x in names.split(", ")]]
    got = {r["qname"]: tuple(r)[2:] for r in back.collect()}
    assert len(got) == 403 and all(got[r[0]] == r for r in rows) and reads.sam_reads(back).count() == 403
    assert bam.region_bin(0, 1) == 4681 and bam.region_bin(0, 1 << 29) == 0
    with pytest.raises(ValueError):
        list(bam.records(b"text of another kind"))


def test_fasta_names_may_hold_the_sign(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_text(">c1 a>b text\nACGT\nAC\n>c2\nTT\n")
    assert {(r["name"], r["seq"]) for r in reads.fasta(spark, str(path)).collect()} == {("c1", "ACGTAC"), ("c2", "TT")}
    chromosomes, cut = references.genome(spark, str(path), tile=4)
    assert {tuple(r) for r in cut.collect()} == {("c1", 0, "ACGT"), ("c1", 1, "AC"), ("c2", 0, "TT")} and chromosomes.count() == 2


def test_oligo_and_kinds(spark):
    oligo = "AAGCAGTGGTATCAACGCAGAGTACATGGG"
    rows = [(oligo + "CCTTCCTT" * 8,), (oligo[6:] + "C" * 40,), (oligo[12:] + "C" * 40,), (oligo[:10] + "T" + oligo[11:] + "C" * 30,), ("C" * 60,), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "seq string").select(clip.oligo_length(F.col("seq"), oligo)).collect()]
    assert got == [30, 24, 0, 30, 0, None, 0]
    assert spark.createDataFrame([("ACGT", None)], "a string, b string").select(clip.mate_overlap(F.col("a"), F.col("b")).alias("m")).first()["m"] is None
    df = spark.createDataFrame([("AAACCCGGGTTT", "IIIIIIIIIIII", "s1")], "seq string, qual string, read_group string")
    simple, complex_, smart = (barcodes.cell_and_umi(df, k, *a).first() for k, a in (("CB_UMI_Simple", (((0, 6),), (6, 3))), ("CB_UMI_Complex", (((0, 3), (9, 3)), (3, 2))), ("SmartSeq", ())))
    assert (simple["cb"], simple["umi"], complex_["cb"], complex_["umi"], smart["cb"], smart["umi"]) == ("AAACCC", "GGG", "AAA_TTT", "CC", "s1", None)
    with pytest.raises(ValueError):
        barcodes.cell_and_umi(df, "other")


def test_only_held_kmers_leave_the_references(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT\U0001f600é") for _ in range(n)) for n in (5, 70_000, 300)]
    texts[2] += texts[1][65_500:65_600]  # across the borders of pieces
    r = spark.createDataFrame(list(enumerate(texts)), "reference long, seq string")
    q = spark.createDataFrame([(0, texts[1][65_480:65_600]), (1, "AC"), (2, None)], "query long, seq string")
    held = seeds._held(q, 13)
    assert 100 <= seeds.kmers(r, "reference", "seq", 13, held=held).count() <= 250

    def found():
        return sorted(map(tuple, seeds.maximal_matches(q, r, 13).collect()))

    few = found()
    monkeypatch.setattr(seeds, "HELD_KMERS", 0)
    assert seeds._held(q, 13) is None and found() == few and (0, 1, 0, 65_480, 120) in few
