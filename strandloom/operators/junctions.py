"""Splice junctions: collapse, filters, union with annotated ones."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import JunctionFilter

KEY = ("chr", "start", "end")


def per_read(observed: DataFrame, read: str = "read_id") -> DataFrame:
    """A junction counts once per read: the largest overhangs stay; n_uniq and n_multi are 0 or 1."""
    return observed.groupBy(read, *KEY).agg(
        F.max("strand").alias("strand"), F.max("motif").alias("motif"), F.max("annot").alias("annot"), F.max("n_uniq").alias("n_uniq"), F.max("n_multi").alias("n_multi"), F.max("over_left").alias("over_left"), F.max("over_right").alias("over_right")
    )


def collapse(observed: DataFrame) -> DataFrame:
    """Sums counts and takes the largest overhangs per (chr, start, end); fails if motifs of one junction differ.

    The strand is not part of the key. All sums are partial per task, so a junction
    seen by every read moves one row per task.
    """
    out = observed.groupBy(*KEY).agg(
        F.max("strand").alias("strand"), F.max("motif").alias("motif"), F.min("motif").alias("_low"), F.max("annot").alias("annot"), F.sum("n_uniq").alias("n_uniq"), F.sum("n_multi").alias("n_multi"), F.max("over_left").alias("over_left"), F.max("over_right").alias("over_right")
    )
    return out.withColumn("motif", F.when(F.col("_low") == F.col("motif"), F.col("motif")).otherwise(F.raise_error(F.lit("motifs of one junction differ")))).drop("_low")


def _at(values: tuple[int, ...]) -> Column:
    """The threshold of the row's motif class."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.expr("(motif + 1) div 2 + 1").cast("int"))


def _reaches(value: Column, values: tuple[int, ...]) -> Column:
    least = _at(values)
    return (least >= 0) & (value >= least)


def count_filter(junctions: DataFrame, options: JunctionFilter = JunctionFilter()) -> DataFrame:
    """Annotated junctions, and those with enough reads and overhang that are not too long for their reads."""
    total = F.col("n_uniq") + F.col("n_multi")
    caps = options.intron_max_by_reads
    cap = F.element_at(F.array(*(F.lit(c) for c in caps)), F.least(F.greatest(total, F.lit(1)), F.lit(len(caps))).cast("int"))
    counted = _reaches(F.col("n_uniq"), options.count_unique_min) | _reaches(total, options.count_total_min)
    over = _reaches(F.col("over_left"), options.overhang_min) & _reaches(F.col("over_right"), options.overhang_min)
    short = (total > len(caps)) | (F.col("end") - F.col("start") <= cap)
    return junctions.where((F.col("annot") > 0) | (counted & over & short))


def distance_filter(junctions: DataFrame, options: JunctionFilter = JunctionFilter(), tile: int = 1 << 20) -> DataFrame:
    """Novel junctions whose donor and acceptor keep the distance of their motif class to the nearest other's.

    Neighbours are all junctions given, annotated ones too. Only distances below the largest asked for matter, so
    windows go by tiles of positions, and a position that close to a tile's edge stands in the next tile as well: one
    shuffle each for donors and acceptors, and no chromosome is one task.
    """
    most = max(*options.distance_min, 1)

    def nearest(rows: DataFrame, name: str, out: str) -> DataFrame:
        at = F.array_distinct(F.array(*(F.expr(f"({name} + {d}) div {tile}") for d in (0, -most, most))))
        tiled = rows.withColumn("_tile", F.explode(at))
        w = Window.partitionBy("chr", "_tile").orderBy(name, "start", "end")
        gap = F.least(F.coalesce(F.col(name) - F.lag(name).over(w), F.lit(most)), F.coalesce(F.lead(name).over(w) - F.col(name), F.lit(most)))
        return tiled.withColumn(out, gap).where(F.col("_tile") == F.expr(f"{name} div {tile}")).drop("_tile")

    marked = nearest(nearest(junctions, "start", "_donor"), "end", "_acceptor")
    keep = (F.col("annot") > 0) | ((F.col("_donor") >= _at(options.distance_min)) & (F.col("_acceptor") >= _at(options.distance_min)))
    return marked.where(keep).drop("_donor", "_acceptor")


def junction_table(observed: DataFrame, options: JunctionFilter = JunctionFilter(), read: str = "read_id") -> DataFrame:
    """Per-read observations to the filtered table."""
    return distance_filter(count_filter(collapse(per_read(observed, read)), options), options)


def collapse_samples(tables: DataFrame) -> DataFrame:
    """Junction tables of several samples as one: counts summed, largest overhang, number of samples."""
    return tables.groupBy(*KEY, "strand", "motif", "annot").agg(F.sum("n_uniq").alias("n_uniq"), F.sum("n_multi").alias("n_multi"), F.max("overhang").alias("overhang"), F.count("*").alias("n_samples"))


def resolve(union: DataFrame) -> DataFrame:
    """One row per (chr, start, end) of several sources: highest priority, then canonical motif, then the left-most shift."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("priority"), F.desc((F.col("motif") > 0).cast("int")), "shift", "strand")
    return union.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def prepared(union: DataFrame) -> DataFrame:
    """(chr, start, end, strand, motif, shift, priority): the junctions of several sources, settled by place and strand.

    Rows are (chr, start, end, strand 0 undefined, 1 plus, 2 minus, motif, shift, priority), shift being the
    repeat length to the left. Of rows of one strand that agree when shifted left, the highest
    priority stays, then a canonical one, then the least shift. What stays goes back to its own place if it
    is canonical, and those of different strands at one place are settled in the order plus, minus, undefined: higher priority
    wins; two non-canonical ones become one of undefined strand; a canonical one wins over one that is not, and of two
    canonical ones that on its motif's strand; an undefined one wins over lower priority than that of
    the row before it, or where it is canonical and the strand would be undefined. Undefined canonical ones get their motif's strand.
    start and end are a row's own, not shifted. Null strands, motifs, shifts and priorities count as 0; other columns are left out.
    """
    kind = {c: F.coalesce(c, F.lit(0)).cast("int") for c in ("strand", "motif", "shift", "priority")}
    rows = union.select(*KEY, *(v.alias(c) for c, v in kind.items())).withColumn("side", F.when(F.col("strand").isin(1, 2), F.col("strand")).otherwise(0))
    # the least of these is the one that stays
    best = F.struct((-F.col("priority")).alias("low"), (F.col("motif") == 0).alias("plain"), "shift", "motif", "priority", "start", "end")
    left = [(F.col(c) - F.col("shift")).alias(f"_{c}") for c in ("start", "end")]
    each = rows.groupBy("chr", *left, "side").agg(F.min(best).alias("x"))
    # the motif is canonical for the place where the row was seen
    at = [F.when(F.col("x.motif") > 0, F.col(f"x.{c}")).otherwise(F.col(f"_{c}")).alias(f"_{c}") for c in ("start", "end")]
    sides = each.groupBy("chr", *at).agg(*(F.min(F.when(F.col("side") == i, F.col("x"))).alias(n) for i, n in ((1, "p"), (2, "m"), (0, "u"))))
    p, m, u = F.col("p"), F.col("m"), F.col("u")
    same = p.isNotNull() & m.isNotNull() & (p["priority"] == m["priority"])
    vague = F.coalesce(same & (p["motif"] == 0) & (m["motif"] == 0), F.lit(False))
    plus = p.isNotNull() & (m.isNull() | (p["priority"] > m["priority"]) | (same & ((m["motif"] == 0) | (p["motif"] % 2 == 1))))
    before = F.coalesce(m, p)
    third = u.isNotNull() & (before.isNull() | (u["priority"] > before["priority"]) | (vague & (u["priority"] == before["priority"]) & (u["motif"] > 0)))
    third, plus = (F.coalesce(x, F.lit(False)) for x in (third, plus))
    own = F.when(third, F.when(u["motif"] > 0, 2 - u["motif"] % 2).otherwise(0)).when(vague, 0).when(plus, 1).otherwise(2)
    stays = sides.select("chr", own.cast("int").alias("strand"), F.when(third, u).when(plus, p).otherwise(m).alias("x"))
    return stays.select("chr", "x.start", "x.end", "strand", "x.motif", "x.shift", "x.priority")


def novel_in(alignments: DataFrame, allowed: DataFrame) -> DataFrame:
    """Junctions of reads that are in a filtered table."""
    return alignments.join(allowed.select(*KEY), list(KEY), "left_semi")


def from_exons(exons: DataFrame) -> DataFrame:
    """(chr, start, end, strand, genes): introns between a transcript's neighbouring exons, with the sorted set of their genes."""
    w = Window.partitionBy("transcript").orderBy("start", "end")
    gaps = exons.withColumn("_prev", F.lag("end").over(w)).where("_prev is not null and start > _prev")
    return gaps.groupBy("chr", F.col("_prev").alias("i_start"), F.col("start").alias("i_end"), "strand").agg(F.sort_array(F.collect_set("gene")).alias("genes")).withColumnsRenamed({"i_start": "start", "i_end": "end"})


#: Priorities of sources of junctions (fixed values).
PRIORITIES = {"novel": 0, "file": 10, "gtf": 20, "saved": 30}


def union_sources(rule: Callable[[DataFrame], DataFrame] = resolve, /, **sources: DataFrame) -> DataFrame:
    """One row per junction of the named sources (keys of PRIORITIES), each (chr, start, end, strand, motif, shift), by resolve or prepared."""
    parts = [rows.select(*KEY, "strand", "motif", "shift").withColumn("priority", F.lit(PRIORITIES[name])) for name, rows in sources.items()]
    return rule(functools.reduce(DataFrame.unionByName, parts))
