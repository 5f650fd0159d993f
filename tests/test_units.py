"""Hand-worked cases of the order-dependent operators and expressions."""

from pyspark.sql import functions as F

from strandloom.functions import cigar, sequence
from strandloom.operators import cells, chimeras, intervals, junctions, liftover, quant, transcripts, umi, variants
from strandloom.options import BarcodeMatch  # noqa: F401


def mols(spark, rows):
    return spark.createDataFrame([(1, 1, u, n) for u, n in rows], "cb long, gene long, umi long, n long")


def counted(df):
    return umi.count_corrected(df).first()["n_umis"]


def test_chain_of_umis(spark):
    # AAAA, AAAC, AACC: a chain of one-mismatch neighbours
    chain = mols(spark, [(0, 1), (1, 1), (5, 1)])
    assert counted(umi.correct_all(chain, 4)) == 1
    assert counted(umi.correct_cr(chain, 4)) == 2


def test_directional_threshold(spark):
    for pair, plain, minus in (((1, 1), 2, 1), ((2, 1), 1, 1), ((3, 2), 2, 1)):
        m = mols(spark, [(0, pair[0]), (1, pair[1])])
        assert counted(umi.correct_directional(m, 4)) == plain
        assert counted(umi.correct_directional(m, 4, -1)) == minus


def test_multi_gene_umis(spark):
    def kept(a, b):
        df = spark.createDataFrame([(1, 1, 7, a), (1, 2, 7, b)], "cb long, gene long, umi long, n long")
        return sorted(r["gene"] for r in umi.keep_top_gene(df).collect())

    assert kept(1, 1) == [] and kept(2, 1) == [1] and kept(2, 2) == [1, 2]


def test_em_moves_to_the_unique_gene(spark):
    ug = spark.createDataFrame([(1, 5, 1), (1, 5, 2)], "cb long, umi long, gene long")
    uq = spark.createDataFrame([(1, 1, 3), (1, 2, 1)], "cb long, gene long, n_umis long")
    got = {r["gene"]: r["value"] for r in umi.expectation_maximisation(ug, uq).collect()}
    assert abs(sum(got.values()) - 1) < 0.02 and got[1] > 0.7 > 0.3 > got[2]
    none = spark.createDataFrame([], "cb long, gene long, n_umis long")
    assert {r["value"] for r in umi.expectation_maximisation(ug, none).collect()} == {0.5}


def test_junction_filter_limits(spark):
    def row(start, end, motif, uniq, annot=0, over=40):
        return ("c", start, end, 1, motif, annot, uniq, 0, over, over)

    schema = "chr string, start long, end long, strand int, motif int, annot int, n_uniq long, n_multi long, over_left int, over_right int"
    df = spark.createDataFrame([row(0, 50_000, 1, 1), row(0, 50_001, 1, 1), row(1, 9, 0, 2), row(2, 9, 0, 2, annot=1), row(3, 99, 1, 1, over=11)], schema)
    kept = {(r["start"], r["end"]) for r in junctions.count_filter(df).collect()}
    assert kept == {(0, 50_000), (2, 9)}
    near = spark.createDataFrame([row(100, 1000, 1, 5), row(105, 2000, 0, 5), row(200, 3000, 0, 5), row(103, 4000, 0, 5, annot=1)], schema)
    assert {r["start"] for r in junctions.distance_filter(near).collect()} == {100, 200, 103}


def test_gene_counts_modes(spark):
    ex = spark.createDataFrame([("c", 0, 100, 1, "g1"), ("c", 50, 150, 2, "g2"), ("c", 300, 400, 0, "g3")], "chr string, start long, end long, strand int, gene string")
    bl = spark.createDataFrame([(1, "c", 10, 20, 1, 1), (2, "c", 60, 70, 1, 1), (3, "c", 310, 320, 2, 1), (4, "c", 10, 20, 1, 3), (5, "c", 500, 510, 1, 1)], "read_id long, chr string, start long, end long, strand int, nh int")
    got = {r["gene"]: (r["unstranded"], r["same"], r["reverse"]) for r in quant.gene_counts(bl, ex, 64).collect()}
    assert got == {"g1": (1, 2, 0), "g2": (0, 0, 1), "g3": (1, 1, 1), "N_multimapping": (1, 1, 1), "N_noFeature": (1, 1, 2), "N_ambiguous": (1, 0, 0)}


def test_coverage_runs(spark):
    bl = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 10, 20, 1.0), ("c", 15, 30, 0.5), ("c", 100, 110, 1.0)], "chr string, start long, end long, weight double")
    for tile in (8, 1 << 20):
        got = sorted((r["start"], r["end"], r["value"]) for r in intervals.coverage(bl, ["chr"], tile=tile).collect())
        assert got == [(0, 15, 1.0), (15, 20, 1.5), (20, 30, 0.5), (100, 110, 1.0)]


def test_liftover_gaps(spark):
    chain = spark.createDataFrame([("c", 100, 50, 1000, "d"), ("c", 200, 50, 1100, "d")], "chr string, start1 long, len long, start2 long, chr2 string")
    f = spark.createDataFrame([(1, "c", 110, 120), (2, "c", 160, 210), (3, "c", 110, 170), (4, "c", 160, 170), (5, "c", 50, 110), (6, "x", 1, 2)], "id long, chr string, start long, end long")
    got = {r["id"]: (r["new_start"], r["new_end"]) if r["lifted"] else None for r in liftover.lift(f, chain).collect()}
    assert got == {1: (1010, 1020), 2: (1100, 1110), 3: (1010, 1049), 4: None, 5: (1000, 1010), 6: None}


def test_cells_ties(spark):
    c = spark.createDataFrame([(i, n, 1) for i, n in enumerate([9, 7, 7, 7, 1])], "cb long, n long, n_genes long")
    assert cells.top_cells(c, 1).count() == 4 and cells.top_cells(c, 99).count() == 5


def test_alleles(spark):
    b = spark.createDataFrame([(1, "c", 10, 14, "ACGN")], "read_id long, chr string, start long, end long, seq string")
    s = spark.createDataFrame([("c", 10, "A", "A", "G"), ("c", 11, "T", "T", "C"), ("c", 12, "T", "T", "A"), ("c", 13, "A", "A", "C")], "chr string, pos long, ref string, a1 string, a2 string")
    assert {r["pos"]: r["allele"] for r in variants.read_alleles(b, s).collect()} == {10: 1, 11: 2, 12: 3, 13: 4}


def test_expressions(spark):
    row = spark.range(1).select(
        sequence.reverse_complement(F.lit("ACGTN")).alias("rc"), sequence.unknown_position(F.lit("ANC")).alias("one"), sequence.unknown_position(F.lit("NN")).alias("two"), sequence.decode(sequence.encode(F.lit("GATTACA")), 7).alias("code"),
        sequence.motif(F.lit("GC"), F.lit("AG")).alias("motif"), sequence.region_bin(F.lit(0), F.lit(1)).alias("bin"), sequence.local_hamming(F.lit("AACGT"), F.lit("CNT"))["position"].alias("at"), cigar.extended_cigar(F.lit("3S10M2D5M4S")).alias("cigar"), cigar.blocks(F.lit(5), F.lit("2S3M10N4M")).alias("blocks"),
    ).first()
    assert (row.rc, row.one, row.two, row.code, row.motif, row.bin, row["at"], row.cigar) == ("NACGT", 1, -2, "GATTACA", 3, 4681, 2, "13M2D9M")
    assert [(b.begin, b.end) for b in row.blocks] == [(5, 8), (18, 22)]


def test_clipping(spark):
    from strandloom.functions import clip

    row = spark.range(1).select(
        clip.adapter_start(F.lit("ACGTACGTAGATCGG"), "AGATCGGAAGAGC").alias("a"), clip.adapter_start(F.lit("CCCC"), "AG").alias("none"), clip.mate_overlap(F.lit("TTTTACGTAC"), F.lit("ACGTACGG")).alias("m"),
        clip.poly_a_length(F.lit("CGCG" + "A" * 25)).alias("p"), clip.poly_a_length(F.lit("C" + "A" * 10 + "G" + "A" * 19)).alias("q"), clip.poly_a_length(F.lit("A" * 19)).alias("short"), clip.poly_a_length(F.lit("CT" * 20)).alias("no"),
        *(c.alias(n) for c, n in zip(clip.repeat_shifts(F.lit("TTAG"), F.lit("CCAG"), F.lit("GTAA"), F.lit("GTCC")), ("left", "right"), strict=True)),
    ).first()
    assert (row.a, row.none, row.m, row.p, row.q, row.short, row.no, row.left, row.right) == (8, 4, 4, 25, 30, 0, 0, 2, 2)


def test_scores(spark):
    from strandloom.operators import scoring

    rows = [("ACGTN", "ACCTA", [(1, 100, 0)], 105), ("AC", "AC", [(-1, 3, 0), (-2, 2, 0), (0, 50, 0), (3, 9, 0), (5, 9, 0), (6, 9, 1), (-3, 0, 0)], 1)]
    df = spark.createDataFrame(rows, "read_bases string, genome_bases string, gaps array<struct<kind:int,len:int,annot:int>>, span long")
    got = sorted((r["n_match"], r["n_mm"], r["score"]) for r in scoring.score(df).collect())
    assert got == [(2, 0, 2 - 8 - 6 - 8 - 4 - 8 + 2), (3, 1, 2 - 2)]
    assert df.select(scoring.md_tag(F.lit("ACGTT"), F.lit("ACCTA")).alias("m")).first()["m"] == "2C1A0"


def test_projection_needs_matching_junctions(spark):
    from strandloom.operators import transcripts

    ex = spark.createDataFrame([("c", 0, 10, "t"), ("c", 20, 30, "t")], "chr string, start long, end long, transcript string")
    bl = spark.createDataFrame([(1, "c", 5, 10), (1, "c", 20, 25), (2, "c", 5, 9), (2, "c", 20, 25), (3, "c", 2, 4), (3, "c", 6, 8), (4, "c", 12, 15)], "read_id long, chr string, start long, end long")
    assert {(r["read_id"], r["t_start"], r["t_end"]) for r in transcripts.project(bl, ex).collect()} == {(1, 5, 15), (3, 2, 8)}
    assert {r["read_id"]: r["kind"] for r in transcripts.concordance(bl, ex).collect()} == {1: "exonic", 2: "spanning", 3: "exonic", 4: "intronic"}


def test_barcode_parts(spark):
    from strandloom.operators import barcodes

    df = spark.createDataFrame([("AACCGG", "ABCDEF", 2), ("AA", "AB", 1)], "seq string, qual string, at int")
    assert [(r["cb"], r["cb_qual"]) for r in barcodes.extract(df, 0, 3, "cb").collect()] == [("AAC", "ABC"), (None, None)]
    assert [r["cb"] for r in barcodes.extract(df, 1, 2, "cb", anchor="at").collect()] == ["CG", None]
    parts = spark.createDataFrame([(2, 1, 3)], "a long, b long, c long")
    one = barcodes.split_index(barcodes.combined_index(parts, [3, 4, 5], ["a", "b", "c"]).select("cb"), [3, 4, 5], ["a", "b", "c"]).first()
    assert (one["cb"], one["a"], one["b"], one["c"]) == (2 * 20 + 1 * 5 + 3, 2, 1, 3)


def test_prepared_junctions(spark):
    # (start, strand, motif, shift, priority); ends are 50 behind
    cases = [
        ([(10, 1, 1, 0, 10), (10, 1, 1, 0, 20)], [(10, 1, 1, 20)]),  # priority
        ([(12, 1, 0, 2, 10), (11, 1, 1, 1, 10)], [(11, 1, 1, 10)]),  # canonical, same place when shifted left
        ([(12, 1, 0, 2, 10), (11, 1, 0, 1, 10)], [(11, 1, 0, 10)]),  # left-most
        ([(10, 1, 0, 0, 10), (10, 2, 0, 0, 10)], [(10, 0, 0, 10)]),  # both strands, neither canonical
        ([(12, 1, 0, 2, 10), (11, 2, 0, 1, 10)], [(12, 0, 0, 10)]),  # the same after the shift; the plus row's place
        ([(10, 1, 2, 0, 10), (10, 2, 2, 0, 10)], [(10, 2, 2, 10)]),  # the motif's strand
        ([(10, 1, 1, 0, 10), (10, 2, 1, 0, 10)], [(10, 1, 1, 10)]),
        ([(10, 1, 1, 0, 10), (10, 2, 1, 0, 30)], [(10, 2, 1, 30)]),  # priority before strand
        ([(10, 2, 1, 0, 10), (10, 0, 1, 0, 10)], [(10, 2, 1, 10)]),  # a defined strand stays
        ([(10, 2, 1, 0, 10), (10, 0, 1, 0, 20)], [(10, 1, 1, 20)]),  # an undefined one of higher priority gets its motif's strand
        ([(10, 0, 0, 0, 10)], [(10, 0, 0, 10)]),
        ([(12, 1, 1, 2, 10), (11, 1, 0, 1, 20), (12, 2, 1, 2, 10)], [(11, 1, 0, 20), (12, 2, 1, 10)]),  # different places after the way back
        ([(10, None, 1, None, None), (10, 9, 0, 0, 0)], [(10, 1, 1, 0)]),  # nulls count as 0, other strands as undefined
        ([], []),
    ]
    for rows, want in cases:
        union = spark.createDataFrame([("c", s, s + 50, *rest) for s, *rest in rows], "chr string, start long, end long, strand int, motif int, shift int, priority int")
        assert sorted((r["start"], r["strand"], r["motif"], r["priority"]) for r in junctions.prepared(union).collect()) == want, rows
    one = {n: spark.createDataFrame([("c", 5, 9, k, 0, 0)], "chr string, start long, end long, strand int, motif int, shift int") for n, k in (("gtf", 1), ("file", 2))}
    assert [(r["strand"], r["priority"]) for r in junctions.union_sources(junctions.prepared, **one).collect()] == [(1, 20)]


def test_transcript_cigars_to_genome(spark):
    # pieces of 10 bases at 100, 150 and 300; on the minus strand the same, the last first
    pieces = [("p", 0, 10, "c", 100, 1), ("p", 10, 10, "c", 150, 1), ("p", 20, 10, "c", 300, 1), ("m", 0, 10, "c", 300, 2), ("m", 10, 10, "c", 150, 2), ("m", 20, 10, "c", 100, 2)]
    stretches = spark.createDataFrame(pieces, "transcript string, start long, len long, chr string, g_start long, t_strand int")
    cases = [
        (("p", 2, 1, "5M"), (102, 1, "5M")),
        (("p", 5, 1, "10M"), (105, 1, "5M40N5M")),
        (("p", 5, 1, "5M"), (105, 1, "5M")),  # the gap behind the last base goes
        (("p", 5, 1, "5M3S"), (105, 1, "5M3S")),  # also before a clip
        (("p", 5, 1, "20M"), (105, 1, "5M40N10M140N5M")),
        (("p", 8, 1, "1S7M"), (150, 1, "3S5M")),  # two bases before the first junction
        (("p", 8, 1, "5M"), (150, 1, "2S3M")),  # three behind it are enough
        (("p", 5, 1, "7M2S"), (105, 1, "5M4S")),  # two behind the last junction
        (("p", 5, 1, "5M2I5M"), (105, 1, "5M40N2I5M")),
        (("p", 5, 1, "3M4D4M"), (105, 1, "3M2D40N2D4M")),
        (("p", 5, 1, "5M2I10N5M"), (105, 1, "5M190N2I5M")),  # N, I, N: one junction, with the N behind it
        (("m", 5, 1, "10M"), (155, 2, "5M140N5M")),
        (("m", 12, 2, "5M1S"), (153, 1, "1S5M")),
        (("m", 8, 1, "1S7M"), (155, 2, "5M3S")),
        (("p", 30, 1, "5M"), None),
        (("x", 0, 1, "5M"), None),
        (("p", 0, 1, None), "any"),
    ]
    rows = spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(cases)], "id int, transcript string, pos long, strand int, cigar string")
    got = {r["id"]: (r["pos"], r["strand"], r["cigar"]) for r in transcripts.to_genome(rows, stretches).collect()}
    for i, (row, want) in enumerate(cases):
        if want != "any":
            assert got.get(i) == want, row
    assert transcripts.to_genome(rows.limit(0), stretches).count() == 0


def test_breakpoints(spark):
    def found(read, donor, acceptor, strand=0, strand_1=1, strand_2=1, **options):
        rows = spark.createDataFrame([(read, donor, acceptor, strand, 100, 900, strand_1, strand_2)], "read string, donor string, acceptor string, strand int, g_1 long, g_2 long, strand_1 int, strand_2 int")
        out = chimeras.breakpoints(rows, 4, chimeras.ChimeraOptions(**{"overhang_min": 2, **options})).collect()
        return [(r["offset"], r["motif"], r["repeat_left"], r["repeat_right"], r["first_donor"], r["first_acceptor"], r["chim_score"]) for r in out]

    read, donor, acceptor = "ACGACCTGACTG", "CCCCACGACCGTCCCCCCCC", "TTTTTTTTAGTGACTGAAAA"
    assert found(read, donor, acceptor) == [(6, 1, 0, 0, 106, 905, 12)]
    assert found(read.lower(), donor, acceptor, strand=1) == [(6, 1, 0, 0, 106, 905, 12)]
    assert found(read, donor, acceptor, strand=2) == [(6, 0, 0, 0, 106, 905, 11)]  # the motif is the other strand's
    assert found(read, donor, acceptor, strand_1=2, strand_2=2) == [(6, 1, 0, 0, 94, 895, 12)]
    assert found(read, donor, acceptor, overhang_min=7) == []
    # no motif: the first of equals, with what repeats behind it; with a motif two bases on, that one
    assert found("ACGACCAAGCTG", "CCCCACGACCAACCCCCCCC", "TTTTTTTTTTAAGCTGAAAA") == [(6, 0, 0, 2, 106, 905, 11)]
    assert found("ACGACCAGGCTG", "CCCCACGACCAGGTCCCCCC", "TTTTTTTTTTAGGCTGAAAA") == [(8, 1, 2, 1, 108, 907, 12)]
    # unknown bases, nothing to split
    assert found("ACNACCTGACTG", donor, acceptor) == [] and found(None, donor, acceptor) == [] and found("", donor, acceptor) == [] and found("A", donor, acceptor) == []
    with_n = donor.replace("ACGACC", "ACNACC")
    assert found(read, with_n, acceptor) == [] and found(read, with_n, acceptor, genome_n=False) == [(6, 1, 0, 0, 106, 905, 10)]
