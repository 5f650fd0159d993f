"""Chimeric pairs of a read's segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import reference_length


@dataclass(frozen=True)
class ChimeraOptions:
    """Least segment length, score drop from the read length, score range and number of pairs kept, least non-chimeric drop;
    at the breakpoint: penalty of other motifs than GT/AG, least bases on either side, whether unknown bases of the genome forbid it."""

    segment_min: int = 15
    drop_max: int = 20
    score_range: int = 1
    multimap_max: int = 10
    nonchimeric_drop: int = 20
    other_motif: int = -1
    overhang_min: int = 20
    genome_n: bool = True


def segment_pairs(segments: DataFrame, options: ChimeraOptions = ChimeraOptions()) -> DataFrame:
    """(read_id, i, j, chim_score, n_pairs) of segments (read_id, idx, r_start, r_end, score, l_read).

    Pairs of different segments of a read, the first starting before the second, with both
    long enough outside their overlap; the score is the sum less the overlap. Pairs
    within the range of the best stay, unless there are too many.
    """
    long = segments.where(F.col("r_end") - F.col("r_start") >= options.segment_min)
    a, b = (long.select("read_id", *(F.col(c).alias(f"{c}_{s}") for c in ("idx", "r_start", "r_end", "score")), *(["l_read"] if s == "a" else [])) for s in "ab")
    overlap = F.greatest(F.col("r_end_a") - F.col("r_start_b"), F.lit(0))
    pairs = a.join(b, "read_id").where("idx_a != idx_b and (r_start_a < r_start_b or (r_start_a = r_start_b and idx_a < idx_b))")
    pairs = pairs.where((F.col("r_start_b") - F.col("r_start_a") >= options.segment_min) & (F.col("r_end_b") - F.col("r_end_a") >= options.segment_min))
    w = Window.partitionBy("read_id")
    scored = pairs.withColumn("chim_score", F.col("score_a") + F.col("score_b") - overlap).where(F.col("chim_score") + options.drop_max >= F.col("l_read"))
    top = scored.withColumn("_best", F.max("chim_score").over(w)).where(F.col("chim_score") + options.score_range >= F.col("_best")).withColumn("n_pairs", F.count("*").over(w))
    return top.where(F.col("n_pairs") <= options.multimap_max).select("read_id", F.col("idx_a").alias("i"), F.col("idx_b").alias("j"), "chim_score", "n_pairs")


def candidates(reads: DataFrame, options: ChimeraOptions = ChimeraOptions()) -> DataFrame:
    """Reads whose best alignment leaves room for a chimera: score at most the read length less the drop."""
    return reads.where(F.col("score") <= F.col("l_read") - options.nonchimeric_drop)


def best_and_next(segments: DataFrame, separation: int = 10, intron_max: int = 1_000_000) -> DataFrame:
    """(read_id, i, j, chim_score): the main segment with its best partner, if the next partner scores less by the separation.

    segments has (read_id, idx, r_start, r_end, score, main, chr, strand, g_start). A partner lies on another chromosome or strand, or farther than intron_max.
    """
    main = segments.where("main").select("read_id", *(F.col(c).alias(f"{c}_m") for c in ("idx", "r_start", "r_end", "score", "chr", "strand", "g_start")))
    far = (F.col("chr") != F.col("chr_m")) | (F.col("strand") != F.col("strand_m")) | (F.abs(F.col("g_start") - F.col("g_start_m")) > intron_max)
    overlap = F.greatest(F.least("r_end", "r_end_m") - F.greatest("r_start", "r_start_m"), F.lit(0))
    pairs = segments.where("not main").join(main, "read_id").withColumn("chim_score", F.col("score") + F.col("score_m") - overlap)
    w = Window.partitionBy("read_id").orderBy(F.desc("chim_score"), "idx")
    ranked = pairs.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("chim_score").over(w)).withColumn("_far", far)
    first = ranked.where("_r = 1 and _far").where(F.col("_next").isNull() | (F.col("chim_score") - F.col("_next") > separation))
    return first.select("read_id", F.col("idx_m").alias("i"), F.col("idx").alias("j"), "chim_score")


def breakpoints(pairs: DataFrame, flank: int = 100, options: ChimeraOptions = ChimeraOptions()) -> DataFrame:
    """Pairs of segments of one mate with their breakpoint: all columns, then offset, motif, repeat_left, repeat_right, first_donor, first_acceptor, chim_score.

    pairs has read, the bases from the first segment's first to the second's last; donor and acceptor, the genome along the two
    segments as the read runs, from ``flank`` bases before read to ``flank`` behind it; strand, 0 where the segments' introns name none;
    and for both segments the place (g_1, g_2) that its alignment gives to the first base of read, and its strand (strand_1, strand_2: 1, 2).
    offset is the number of bases on the first segment: the one that matches best, where a motif other than GT/AG (1) or CT/AC (2, as
    seen along the read) costs ``other_motif``; of equals the last with a motif, else the first. A known strand excludes the other strand's motif. Repeats are
    equal bases of both sides along the breakpoint, 100 at most. first_donor and first_acceptor are the first bases inside the gap.
    chim_score counts matches less mismatches of the two blocks, with the cost of the motif. Pairs with an unknown base (or null) in the read,
    and in the genome if genome_n, go, and those with fewer than ``overhang_min`` bases on a side.
    """
    r, d, a, j = (F.col(c) for c in ("_r", "_d", "_a", "_j"))
    # inline() keeps filters from being moved before the arrays, where they would make them anew for each base
    rows = pairs.select("*", F.inline(F.array(F.struct(*(F.split(F.upper(c), "").alias(f"_{c[0]}") for c in ("read", "donor", "acceptor")))))).where(F.size("_r") > 1)
    inner = F.sequence(F.lit(0), F.size("_r") - 2)
    known = F.forall(F.slice("_r", 1, F.size("_r") - 1), lambda b: b.isin(*"ACGT"))
    if options.genome_n:
        known &= F.forall(inner, lambda i: d[i + flank].isin(*"ACGT") & a[i + flank].isin(*"ACGT"))

    def step(acc, i):
        side = F.when(d[i + flank] == a[i + flank], 0).when(r[i] == d[i + flank], 1).when(r[i] == a[i + flank], -1).otherwise(0)
        gap = F.concat(d[i + flank + 1], d[i + flank + 2], a[i + flank - 1], a[i + flank])
        motif = F.when((gap == "GTAG") & (F.col("strand") != 2), 1).when((gap == "CTAC") & (F.col("strand") != 1), 2).otherwise(0)
        score = acc["score"] + side
        whole = score + F.when(motif == 0, options.other_motif).otherwise(0)
        better = (whole > acc["best"]) | ((whole == acc["best"]) & (motif > 0))
        new = {"score": score, "best": F.when(better, whole).otherwise(acc["best"]), "j": F.when(better, i).otherwise(acc["j"]), "motif": F.when(better, motif).otherwise(acc["motif"])}
        return F.struct(*(v.cast("int").alias(c) for c, v in new.items()))

    start = F.struct(*(F.lit(v).cast("int").alias(c) for c, v in (("score", 0), ("best", -999_999), ("j", 0), ("motif", 0))))
    found = rows.select("*", F.explode(F.array(F.when(known, F.aggregate(inner, start, step)))).alias("_b")).withColumn("_j", F.col("_b.j"))
    found = found.where((j + 1 >= options.overhang_min) & (F.size("_r") - j - 1 >= options.overhang_min))

    def run(places):
        """How many bases agree before the first that don't."""
        same = F.transform(places, lambda i: F.coalesce(d[i] == a[i], F.lit(False)))
        stop = F.array_position(same, F.lit(False))
        return F.least(F.when(stop == 0, F.size(same)).otherwise(stop - 1), F.lit(100)).cast("int")

    ahead = F.when(flank + j + 1 < F.size("_d"), F.sequence(flank + j + 1, F.size("_d") - 1)).otherwise(F.array().cast("array<int>"))
    back = F.sequence(flank + j, F.lit(0), F.lit(-1))
    block = F.aggregate(F.sequence(F.lit(0), F.size("_r") - 1), F.lit(0), lambda acc, i: acc + F.when(r[i] == F.when(i <= j, d[i + flank]).otherwise(a[i + flank]), 1).otherwise(-1))
    plus = lambda c: F.col(c) == 1
    new = {
        "offset": j + 1, "motif": F.col("_b.motif"), "repeat_left": run(back), "repeat_right": run(ahead),
        "first_donor": F.when(plus("strand_1"), F.col("g_1") + j + 1).otherwise(F.col("g_1") - j - 1), "first_acceptor": F.when(plus("strand_2"), F.col("g_2") + j).otherwise(F.col("g_2") - j),
        "chim_score": block + F.when(F.col("_b.motif") == 0, options.other_motif).otherwise(0),
    }
    return found.select(*(F.col(c) for c in pairs.columns), *(v.alias(c) for c, v in new.items()))


def junction_rows(pairs: DataFrame) -> DataFrame:
    """(value): the fourteen columns of a chimeric junction table, tab-separated, of rows that have them under their names."""
    names = ("chr_donor", "first_donor", "strand_donor", "chr_acceptor", "first_acceptor", "strand_acceptor", "motif", "repeat_left", "repeat_right", "name", "start_1", "cigar_1", "start_2", "cigar_2")
    return pairs.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in names)).alias("value"))


def circular(junctions: DataFrame, least_reads: int = 1, span_max: int = 100_000) -> DataFrame:
    """(chr, start, end, strand, n_reads) of back-splices: donor behind acceptor on one chromosome and strand, canonical, within span_max, both segments inside."""
    plus = F.col("strand_donor") == "+"
    low = F.when(plus, F.col("first_acceptor")).otherwise(F.col("first_donor"))
    high = F.when(plus, F.col("first_donor")).otherwise(F.col("first_acceptor"))
    kept = junctions.where((F.col("chr_donor") == F.col("chr_acceptor")) & (F.col("strand_donor") == F.col("strand_acceptor")) & (F.col("motif") > 0) & (low < high) & (high - low < span_max))
    inside = kept.where((F.least("start_1", "start_2") > low) & (F.greatest(F.col("start_1") + reference_length(F.col("cigar_1")), F.col("start_2") + reference_length(F.col("cigar_2"))) <= high))
    return inside.groupBy(F.col("chr_donor").alias("chr"), low.alias("start"), high.alias("end"), F.col("strand_donor").alias("strand")).agg(F.countDistinct("name").alias("n_reads")).where(F.col("n_reads") >= least_reads)
