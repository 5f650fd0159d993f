"""Alignments against transcripts: projection and concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar
from .intervals import within_join


def numbered_exons(exons: DataFrame) -> DataFrame:
    """Adds ex, the exon's number in its transcript from 0, and len_before, spliced bases before it."""
    of = Window.partitionBy("transcript").orderBy("start", "end")
    before = F.sum(F.col("end") - F.col("start")).over(of.rowsBetween(Window.unboundedPreceding, -1))
    return exons.withColumn("ex", F.row_number().over(of) - 1).withColumn("len_before", F.coalesce(before, F.lit(0)))


def gathered(blocks: DataFrame) -> DataFrame:
    """(read_id, chr, blocks, whole) of rows (read_id, chr, start, end): a read's blocks on a chromosome, ordered, and whether it has none elsewhere."""
    per = blocks.repartition("read_id").groupBy("read_id", "chr").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("blocks"))
    return per.withColumn("whole", F.count("*").over(Window.partitionBy("read_id")) == 1)


def _within(alignments: DataFrame, exons: DataFrame, bin_size: int | None) -> DataFrame:
    """Alignments with the transcripts that contain them, as arrays: exons, and _b, the blocks with the exons that hold each."""
    piece = F.struct("start", "end", "ex", "len_before")
    models = numbered_exons(exons).groupBy("chr", "transcript").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(piece)).alias("exons"))
    pairs = within_join(alignments, models, bin_size, keep_bin=True)

    def held(b):
        return F.struct(b["start"].alias("start"), b["end"].alias("end"), F.filter("exons", lambda e: (e["start"] <= b["start"]) & (b["end"] <= e["end"])).alias("in"))

    return pairs.withColumn("_b", F.transform("blocks", held))


def _concordant() -> Column:
    """Whether each block of _b lies in one exon, and neighbours in one or at the meeting ends of two."""

    def follows(b, i):
        before, home = F.get(F.col("_b"), i - 1), F.get(b["in"], F.lit(0))
        last = F.get(before["in"], F.lit(0))
        return (F.size(b["in"]) == 1) & ((i == 0) | (home["ex"] == last["ex"]) | ((home["ex"] == last["ex"] + 1) & (last["end"] == before["end"]) & (b["start"] == home["start"])))

    return F.forall(F.transform("_b", follows), lambda ok: F.coalesce(ok, F.lit(False)))


def project_reads(alignments: DataFrame, exons: DataFrame, bin_size: int | None = None, distinct: bool = False) -> DataFrame:
    """project() of (read_id, chr, blocks), blocks an ordered array of (start, end): one shuffle of the reads, none of the pairs. distinct: equal rows once."""
    rows = _within(alignments, exons, bin_size)

    def at(b):
        return b["in"][0]["len_before"] + b["start"] - b["in"][0]["start"]

    ends = F.array_min(F.transform("_b", at)).alias("t_start"), F.array_max(F.transform("_b", lambda b: at(b) + b["end"] - b["start"])).alias("t_end")
    # a filter on _b would be pushed into the join, where _b is computed anew for each use and block; one on generated rows isn't
    found = rows.select("chr", "_bin", "read_id", "transcript", F.explode_outer(F.array(F.when(_concordant(), F.struct(*ends)))).alias("_t")).where("_t is not null")
    return _once(found.select("chr", "_bin", "read_id", "transcript", "_t.t_start", "_t.t_end"), distinct)


def project(blocks: DataFrame, exons: DataFrame, bin_size: int | None = None) -> DataFrame:
    """(read_id, transcript, t_start, t_end) of alignments that are concordant with a transcript.

    blocks has (read_id, chr, start, end), exons (chr, start, end, transcript). Every
    block lies in an exon; neighbouring blocks lie in one exon, or end and begin with
    neighbouring exons. Positions are in the spliced transcript, half-open.
    """
    return project_reads(gathered(blocks).where("whole"), exons, bin_size)


def concordance_reads(alignments: DataFrame, exons: DataFrame, bin_size: int | None = None, distinct: bool = False) -> DataFrame:
    """concordance() of (read_id, chr, blocks), blocks an ordered array of (start, end); with a column whole, only where it is set is a read exonic. distinct: equal rows once."""
    touched = F.exists("blocks", lambda b: F.exists("exons", lambda e: (e["start"] < b["end"]) & (b["start"] < e["end"])))
    exact = _concordant() & (F.col("whole") if "whole" in alignments.columns else F.lit(True))
    kind = F.when(exact, "exonic").when(touched, "spanning").otherwise("intronic")
    return _once(_within(alignments, exons, bin_size).select("chr", "_bin", "read_id", "transcript", kind.alias("kind")), distinct)


def concordance(blocks: DataFrame, exons: DataFrame, bin_size: int | None = None) -> DataFrame:
    """(read_id, transcript, kind) of alignments within a transcript's extent: "exonic" as project(), "intronic" without an exonic base, else "spanning"."""
    return concordance_reads(gathered(blocks), exons, bin_size)


def _once(rows: DataFrame, distinct: bool) -> DataFrame:
    """Rows without chr and _bin; equal ones once, if asked, which needs no shuffle where the pairs were found."""
    return (rows.distinct() if distinct else rows).drop("chr", "_bin")


def flank_concordance(alignments: DataFrame, exons: DataFrame, flank: int = 6, intron_max: int = 1_000_000, distinct: bool = False) -> DataFrame:
    """(read_id, transcript, gene, kind) of alignments within a transcript, judged with tolerance at exon ends.

    alignments has (read_id, chr, blocks), blocks an ordered array of (start, end) cut at junctions only; exons (chr, start,
    end, transcript, gene). Ends that reach over a boundary by ``flank`` bases or less don't count, nor do blocks of ``flank`` bases or less.
    kind is 1 exonic, 2 intronic, 4 both but no block across a boundary, 8 with such a block. Spliced alignments that touch
    an intron, and any within an intron longer than intron_max, have no row. Native: exons come as one array per transcript.
    distinct: equal rows once.
    """
    models = exons.groupBy("chr", "transcript", "gene").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))
    models = models.withColumn("start", F.col("exons")[0]["start"]).withColumn("end", F.element_at("exons", -1)["end"])
    pairs = within_join(alignments, models, keep_bin=distinct)

    def judge(b):
        k = F.size(F.filter("exons", lambda e: e["start"] <= b["start"]))
        here, after = F.col("exons")[k - 1], F.get(F.col("exons"), k)
        begin, last = b["start"] + flank, b["end"] - 1
        crosses = F.when(last >= after["start"] + flank, 8).when(last > here["end"] - 1 + flank, F.when(after["start"] - here["end"] + 1 > intron_max, 16).otherwise(2)).otherwise(0)
        behind = F.when(last > after["end"] - 1 + flank, 8).when(last >= after["start"] + flank, 1).otherwise(0)
        inner = F.when(last - b["start"] < flank, 0).when(begin < here["end"], F.when(last <= here["end"] - 1 + flank, 1).otherwise(8)).when(begin < after["start"], crosses).otherwise(behind)
        return F.when(k == F.size("exons"), 1).otherwise(inner)

    judged = pairs.withColumn("_k", F.aggregate(F.transform("blocks", judge), F.lit(0), lambda acc, x: acc.bitwiseOR(x)))
    has = lambda bit: F.col("_k").bitwiseAND(bit) > 0
    spliced = F.size("blocks") > 1
    kind = F.when(has(16) | (spliced & (has(2) | has(8))), None).when(has(8), 8).when(~has(2), 1).when(has(1), 4).otherwise(2)
    kept = ["chr", "_bin"] if distinct else []
    return _once(judged.select(*kept, "read_id", "transcript", "gene", kind.alias("kind")).where("kind is not null"), distinct)


def to_genome(alignments: DataFrame, stretches: DataFrame, overhang: int = 3) -> DataFrame:
    """Alignments on transcripts, by CIGAR, as alignments on the genome: all columns, with chr added and pos, strand and cigar changed.

    alignments has (transcript, pos, strand 1 or 2, cigar of M, I, D, N and S), stretches (transcript, start, len, chr, g_start, t_strand): the
    neighbouring pieces of each transcript, starts counted from 0, g_start being a piece's first base on the plus strand. M, D and N are cut where
    a piece ends and the gap to the next one is put in as N; equal neighbours are merged, an N at the end goes. The first junction
    goes if fewer than ``overhang`` bases match before it, and what stands before it becomes a soft clip; so does the last. On transcripts of
    strand 2 the result is turned round. Native; rows without a transcript among the stretches, or that begin behind its end, go. A
    transcript's stretches travel as one array.
    """
    x = F.when(F.col("t_strand") == 2, -(F.col("g_start") + F.col("len"))).otherwise(F.col("g_start"))
    models = stretches.groupBy("transcript").agg(F.first("chr").alias("_chr"), F.first("t_strand").alias("_turn"), F.sort_array(F.collect_list(F.struct("start", "len", x.alias("x")))).alias("_p"))
    ends = F.transform("_p", lambda p, i: F.struct(p["start"].alias("start"), (p["start"] + p["len"]).alias("end"), (F.get(F.col("_p"), i + 1)["x"] - p["x"] - p["len"]).alias("gap"), p["x"].alias("x")))
    rows = alignments.join(models.withColumn("_p", ends), "transcript")
    home = F.filter("_p", lambda p: (p["start"] <= F.col("pos")) & (F.col("pos") < p["end"]))
    rows = rows.withColumn("_home", F.get(home, F.lit(0))).where("_home is not null").withColumn("_at", F.col("_home.x") + F.col("pos") - F.col("_home.start"))
    ops = cigar.operations(F.col("cigar"))
    for step in (lambda _: ops, lambda c: cigar.cut_at(c, F.col("pos"), F.col("_p")), cigar.merged, cigar.without_last_gap, cigar.without_last_gap):
        rows = rows.withColumn("_ops", step(F.col("_ops")))
    rows = rows.withColumn("_k", cigar.short_head(F.col("_ops"), overhang)).withColumn("_at", F.col("_at") + cigar.length_of(F.slice("_ops", 1, F.col("_k")), "M", "D", "N"))
    rows = rows.withColumn("_ops", F.reverse(cigar.clipped_head(F.col("_ops"), F.col("_k"))))
    rows = rows.withColumn("_ops", cigar.clipped_head(F.col("_ops"), cigar.short_head(F.col("_ops"), overhang)))
    turned = F.col("_turn") == 2
    at = F.when(turned, -(F.col("_at") + cigar.length_of(F.col("_ops"), "M", "D", "N"))).otherwise(F.col("_at"))
    new = {"pos": at, "strand": F.when(turned, 3 - F.col("strand")).otherwise(F.col("strand")), "cigar": cigar.text(F.when(turned, F.col("_ops")).otherwise(F.reverse("_ops")))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in alignments.columns), F.col("_chr").alias("chr"))
