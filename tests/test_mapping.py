"""Hand-worked cases of the alignment of reads, of classes against transcripts, and of tiled windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar
from strandloom.operators import barcodes, cells, intervals, junctions, mapping, quant
from strandloom.options import EmptyDrops, KneeFilter

RNG = random.Random(12)
A, B, MID = ("".join(RNG.choice("ACGT") for _ in range(n)) for n in (60, 60, 200))


def aligned(spark, reads, genome, **options):
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    found = mapping.align(df, spark.createDataFrame([("c", genome)], "chr string, seq string"), mapping.MapOptions(**options), read_max=200, tile=64)
    best = {}
    for r in found.withColumn("cigar", cigar.build(F.col("blocks"), F.lit(0))).collect():
        if r["read_id"] not in best or r["score"] > best[r["read_id"]]["score"]:
            best[r["read_id"]] = r
    return best


def blocks(row):
    return [(b["r"], b["g"], b["len"]) for b in row["blocks"]]


def test_junctions_and_indels(spark):
    genome = "T" * 30 + A + "GT" + MID + "AG" + B + "C" * 30
    plus = A[20:] + B[:40]
    minus = plus[::-1].translate(str.maketrans("ACGT", "TGCA"))
    deletion, insertion = A[:30] + A[35:], A[:30] + "ACCAC" + A[30:]
    got = aligned(spark, [plus, minus, deletion, insertion, A, "", A[:30] + "N" + A[31:]], genome)
    assert (got[0]["score"], got[0]["strand"], blocks(got[0]), [(g["kind"], g["len"]) for g in got[0]["gaps"]]) == (80, 1, [(0, 50, 40), (40, 294, 40)], [(1, 204)])
    assert (got[1]["score"], got[1]["strand"], blocks(got[1])) == (80, 2, blocks(got[0]))
    assert got[2]["score"] == 55 - 2 - 10 and [(g["kind"], g["len"]) for g in got[2]["gaps"]] == [(-1, 5)] and sum(b[2] for b in blocks(got[2])) == 55
    assert got[3]["score"] == 60 - 2 - 10 and [(g["kind"], g["len"]) for g in got[3]["gaps"]] == [(-2, 5)] and got[3]["n_match"] == 60
    assert (got[4]["score"], blocks(got[4])) == (60, [(0, 30, 60)]) and 5 not in got
    assert (got[6]["score"], got[6]["n_mm"], blocks(got[6])) == (59, 0, [(0, 30, 60)])


def test_noncanonical_junction_costs_and_annotation_pays(spark):
    genome = A + "CC" + MID + "CC" + B
    got = aligned(spark, [A + B], genome)[0]
    assert got["score"] == 120 - 8 and got["gaps"][0]["kind"] == 0
    found = spark.createDataFrame([got.asDict(recursive=True)], mapping.align(spark.createDataFrame([(1, A)], "read_id long, seq string"), spark.createDataFrame([("c", genome)], "chr string, seq string")).schema)
    start, end = blocks(got)[0][1] + blocks(got)[0][2], blocks(got)[1][1]
    marked = mapping.annotate(found, spark.createDataFrame([("c", start, end), ("c", 1, 2)], "chr string, start long, end long")).first()
    assert marked["score"] == 120 + 2 and marked["gaps"][0]["annot"] == 1
    assert mapping.final_filter(found, keep_noncanonical=False).count() == 0 and mapping.final_filter(found).count() == 1
    observed = mapping.junction_observations(found.withColumn("n_tr", F.lit(1))).first()
    assert (observed["start"], observed["end"], observed["motif"], observed["over_left"]) == (start, end, 0, 60 if start == 60 else observed["over_left"])


def test_ends_are_extended_within_mismatches():
    o = mapping.MapOptions(mismatch_max=2)
    read = np.array([0, 1, 2, 3] * 5, np.int8)
    genome = read.copy()
    genome[[3, 8]] = 4 - genome[[3, 8]] % 2 - 1
    assert mapping.extend(read, genome, 50, 0, o) == (20, 18, 2)
    assert mapping.extend(read, genome, 50, 1, o) == (8, 7, 1) and mapping.extend(read, genome, 50, 2, o) == (3, 3, 0)
    assert mapping.extend(read, 3 - read, 50, 0, o) == (0, 0, 0) and mapping.extend(read[:0], genome, 9, 0, o) == (0, 0, 0)


def test_velocyto_models(spark):
    rows = [
        (1, 1, 1, "t1", "g", 1), (1, 1, 2, "t1", "g", 1),  # exonic only: spliced
        (1, 2, 1, "t1", "g", 1), (1, 2, 2, "t1", "g", 2),  # exon and intron, no span: unspliced
        (1, 3, 1, "t1", "g", 1), (1, 3, 2, "t1", "g", 8),  # exonic, and spanning: neither exonic only nor all spanning
        (1, 4, 1, "t1", "g", 1), (1, 4, 1, "t2", "g", 2),  # two transcripts that disagree: ambiguous
        (1, 5, 1, "t1", "g", 1), (1, 5, 1, "t3", "h", 1),  # two genes
        (1, 6, 1, "t1", "g", 1), (1, 6, 2, "t2", "g", 1),  # no transcript shared
        (1, 7, 1, "t1", "g", 8),
    ]
    df = spark.createDataFrame(rows, "cb long, umi long, read long, transcript string, gene string, kind int")
    got = quant.velocyto(df).collect()
    assert [(r["gene"], r["spliced"], r["unspliced"], r["ambiguous"]) for r in got] == [("g", 1, 3, 1)]


def test_overlap_classes(spark):
    ex = spark.createDataFrame([("c", 0, 100, 1, "t", "g"), ("c", 200, 300, 1, "t", "g"), ("c", 0, 300, 2, "u", "h")], "chr string, start long, end long, strand int, transcript string, gene string")
    rows = [(1, 0, 0, 50, 100, False), (1, 0, 1, 200, 250, True), (2, 0, 0, 50, 99, False), (2, 0, 1, 200, 250, True), (3, 0, 0, 90, 190, False), (4, 0, 0, 400, 410, False)]
    al = spark.createDataFrame([(r, a, "c", s, b, lo, hi, j) for s in (1, 2) for r, a, b, lo, hi, j in [(x[0] + 10 * s, *x[1:]) for x in rows]], "read_id long, align_idx int, chr string, strand int, block int, start long, end long, joined boolean")
    got = {r["read_id"]: (r["class"], r["genes"]) for r in quant.overlap_classes(al, ex).collect()}
    # the antisense transcript u has all of 3 in one exon; spliced reads agree with t alone
    assert got[11] == ("exonic", ["g"]) and got[12] == ("half_exonic", ["g"]) and got[13] == ("exonic_antisense", []) and got[14] == ("intergenic", [])
    assert got[21] == ("exonic_antisense", []) and got[22] == ("half_exonic", ["h"]) and got[23] == ("exonic", ["h"])


def test_one_unknown_base(spark):
    wl = spark.createDataFrame([(0b000110,), (0b010110,), (0b111111,)], "code long")  # ACG, CCG, TTT
    reads = spark.createDataFrame([(1, "NCG"), (2, "NTT"), (3, "NNT"), (4, "ACG"), (5, "ACN")], "read_id long, cb string")
    one = {(r["read_id"], r["match"], r["base"]) for r in barcodes.unknown_base(reads, wl, 3).collect()}
    assert one == {(2, 0b111111, 0), (5, 0b000110, 2)}
    assert barcodes.unknown_base(reads, wl, 3, many=True).count() == 4


def test_match_modes(spark):
    wl = spark.createDataFrame([(0b00000000,), (0b11111111,)], "code long")  # AAAA, TTTT
    rows = [(1, "AAAA", "IIII"), (2, "AAAC", "III#"), (3, "TTTA", "IIII"), (4, "NAAA", "#III"), (5, "CCCC", "IIII"), (6, "AACC", "IIII")]
    df = spark.createDataFrame(rows, "read_id long, cb string, qual string")

    def found(mode):
        return {r["read_id"]: r["match"] for r in barcodes.match(df, wl, 4, mode).collect()}

    # TTTT has no exact read, so it needs pseudocounts
    assert found("Exact") == {1: 0} and found("1MM") == {1: 0, 2: 0, 4: 0} and found("1MM_multi_pseudocounts") == {1: 0, 2: 0, 3: 255, 4: 0}
    assert found("EditDist_2") == {1: 0, 2: 0, 3: 255, 6: 0}
    with pytest.raises(ValueError):
        found("2MM")


def test_tiles_do_not_change_windows(spark):
    rng = random.Random(3)
    rows = [("c" if i % 3 else "d", s, s + rng.randint(1, 40)) for i, s in enumerate(rng.randint(0, 2000) for _ in range(120))] + [("c", 100, 900)]
    df = spark.createDataFrame(rows, "chr string, start long, end long").distinct()
    points = spark.createDataFrame([("c", p) for p in range(0, 2100, 7)] + [("e", 5)], "chr string, at long")

    def same(make):
        small, large = (sorted(map(str, make(t).collect())) for t in (16, 1 << 20))
        assert small == large and small

    same(lambda t: intervals.islands(df, ["chr"], gap=3, tile=t))
    same(lambda t: intervals.running_end(df, ["chr"], tile=t).select("chr", "start", "end", "end_max"))
    schema = "chr string, start long, end long, strand int, motif int, annot int, n_uniq long, n_multi long, over_left int, over_right int"
    novel = spark.createDataFrame([("c", a, a + rng.randint(40, 60), 1, rng.randint(0, 6), 0, 5, 0, 40, 40) for a in rng.sample(range(3000), 400)], schema)
    same(lambda t: junctions.distance_filter(novel, tile=t))
    same(lambda t: intervals.as_of(points, df.select("chr", F.col("start").alias("s")).distinct(), ["chr"], "at", "s", [], tile=t))


def test_empty_drops_finds_the_odd_cell(spark):
    rng = np.random.default_rng(5)
    rows = [(i, g, int(c)) for i in range(200) for g, c in enumerate(rng.multinomial(30, [0.04] * 25)) if c]
    rows += [(1000 + i, g, int(c)) for i in range(3) for g, c in enumerate(rng.multinomial(4000, [0.04] * 25)) if c] + [(2000, 3, 40), (2001, 7, 45)]
    counts = spark.createDataFrame(rows, "cb long, gene long, n_umis long")
    options = EmptyDrops(ambient_from=5, ambient_to=205, umi_min=20, simulations=400)
    first, again = (sorted(r["cb"] for r in cells.call_cells(counts, "EmptyDrops_CR", knee_options=KneeFilter(expected=3), drops=options).collect()) for _ in range(2))
    assert first == again == [1000, 1001, 1002, 2000, 2001]
    assert cells.call_cells(counts, "TopCells", top=2).count() == 3 and cells.call_cells(counts, "None").count() == 205
