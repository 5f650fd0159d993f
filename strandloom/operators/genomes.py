"""Genomes with variants put in, the way back, and reads remapped with the other alleles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import as_of
from .mapping import MapOptions, align, oriented
from .variants import read_alleles

_CHAIN = "array<struct<start1:long,len:long,start2:long>>"


def with_variants(genome: DataFrame, variants: DataFrame, suffix: str = "") -> tuple[DataFrame, DataFrame]:
    """(sequences (chr, seq), blocks (chr, start1, len, start2, chr2)): a genome (chr, seq) with variants (chr, pos, ref, alt) put in.

    Variants are taken by position; one that starts within the one before, or whose ref isn't there, is left out. New
    chromosomes are named with the suffix. The blocks are those of a chain: stretches of the old sequence in the new one. A chromosome is one row, so one task's.
    """
    rows = variants.select("chr", "pos", "ref", "alt").distinct()

    def put(key, sequences, changes):
        if not sequences.num_rows:
            return pa.table({"chr": pa.array([], pa.string()), "seq": pa.array([], pa.string()), "chain": pa.array([], kind)})
        seq = sequences.column("seq")[0].as_py()
        at, out, size, chain = 0, [], 0, []
        for pos, ref, alt in sorted(zip(*(changes.column(c).to_pylist() for c in ("pos", "ref", "alt")), strict=True)):
            if pos < at or not seq.startswith(ref, pos):
                continue
            if pos > at:
                chain.append({"start1": at, "len": pos - at, "start2": size})
            out += [seq[at:pos], alt]
            size += pos - at + len(alt)
            at = pos + len(ref)
        if at < len(seq):
            chain.append({"start1": at, "len": len(seq) - at, "start2": size})
        return pa.table({"chr": [key[0].as_py()], "seq": ["".join([*out, seq[at:]])], "chain": pa.array([chain], kind)})

    kind = pa.list_(pa.struct([("start1", pa.int64()), ("len", pa.int64()), ("start2", pa.int64())]))
    made = genome.select("chr", "seq").groupBy("chr").cogroup(rows.groupBy("chr")).applyInArrow(put, f"chr string, seq string, chain {_CHAIN}")
    name = F.concat("chr", F.lit(suffix))
    blocks = made.select("chr", F.explode("chain").alias("b")).select("chr", "b.start1", "b.len", "b.start2", name.alias("chr2"))
    return made.select(name.alias("chr"), "seq"), blocks


def haplotypes(genome: DataFrame, genotypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both haplotypes of a genome by genotypes (chr, pos, ref, a1, a2), as one genome of chromosomes named _h1 and _h2, and their blocks."""
    parts = [with_variants(genome, genotypes.where(F.col(a) != F.col("ref")).select("chr", "pos", "ref", F.col(a).alias("alt")), s) for a, s in (("a1", "_h1"), ("a2", "_h2"))]
    return parts[0][0].unionByName(parts[1][0]), parts[0][1].unionByName(parts[1][1])


def to_reference(alignments: DataFrame, chain: DataFrame) -> DataFrame:
    """Alignments on a changed genome as on the old one: each block moves by the stretch it starts in.

    chain is that of with_variants. A block that starts in inserted bases begins with the next stretch, as far as the block
    reaches; blocks that lie in inserted bases go, and alignments without a block with them. Chromosomes get their old names.
    """
    each = alignments.select("read_id", "align_idx", F.col("chr").alias("chr2"), F.posexplode("blocks").alias("i", "b")).select("read_id", "align_idx", "chr2", "i", "b.r", F.col("b.g").alias("at"), F.col("b.len").alias("n"))
    w = Window.partitionBy("chr2").orderBy("start2")
    stretches = chain.select("chr2", "start2", F.col("start1").alias("_old"), F.col("len").alias("_len"), F.col("chr").alias("_chr"), F.lead("start2").over(w).alias("_next"), F.lead("start1").over(w).alias("_next_old"))
    found = as_of(each, stretches, ["chr2"], "at", "start2", ["_old", "_len", "_chr", "_next", "_next_old"])
    inside = F.col("at") < F.col("start2") + F.col("_len")
    skip = F.when(inside, 0).otherwise(F.col("_next") - F.col("at"))
    moved = found.withColumn("_skip", skip).where("_skip < n")
    g = F.when(inside, F.col("_old") + F.col("at") - F.col("start2")).otherwise(F.col("_next_old"))
    block = F.struct("i", (F.col("r") + F.col("_skip")).cast("int").alias("r"), g.alias("g"), (F.col("n") - F.col("_skip")).cast("int").alias("len"))
    joined = moved.groupBy("read_id", "align_idx", "_chr").agg(F.transform(F.sort_array(F.collect_list(block)), lambda b: F.struct(b["r"].alias("r"), b["g"].alias("g"), b["len"].alias("len"))).alias("_blocks"))
    out = alignments.join(joined, ["read_id", "align_idx"])
    return out.select(*({"chr": F.col("_chr"), "blocks": F.col("_blocks")}.get(c, F.col(c)).alias(c) for c in alignments.columns))


def remapped_types(alignments: DataFrame, reads: DataFrame, genome: DataFrame, snps: DataFrame, options: MapOptions = MapOptions(), score_part: float = 0.66, **how) -> DataFrame:
    """(read_id, type) of reads that cover variants: does a read map alike with every combination of alleles?

    alignments are the selected ones (with n_tr), reads (read_id, seq), snps (chr, pos, ref, a1, a2). type is 1 alike, 2 several loci, 3 an unknown base at a
    variant, 4 a combination doesn't map, 5 maps to several loci, 6 maps elsewhere, 7 more than ten variants. Combinations, at most 1,024 for a read, are
    rows, mapped as reads of their own; the first that fails, in order, gives the type.
    """
    first = alignments.withColumn("_r", F.row_number().over(Window.partitionBy("read_id").orderBy("align_idx"))).where("_r = 1")
    whole = first.join(oriented(reads), ["read_id", "strand"]).select("read_id", "chr", "strand", "n_tr", "blocks", "seq")
    each = whole.select("read_id", "chr", "seq", F.explode("blocks").alias("b")).select("read_id", "chr", F.col("b.g").alias("start"), (F.col("b.g") + F.col("b.len")).alias("end"), F.substring("seq", F.col("b.r") + 1, F.col("b.len")).alias("seq"), F.col("b.r").alias("r"))
    alleles = read_alleles(each, snps).distinct()
    placed = alleles.join(each.select("read_id", "chr", "start", "end", "r"), ["read_id", "chr"]).where("start <= pos and pos < end").join(snps, ["chr", "pos"])
    marks = placed.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct((F.col("r") + F.col("pos") - F.col("start")).cast("int").alias("at"), "allele", "a1", "a2"))).alias("v"))
    known = whole.join(marks, "read_id").withColumn("n", F.size("v"))
    early = F.when(F.col("n_tr") > 1, 2).when(F.col("n") > 10, 7).when(F.exists("v", lambda x: x["allele"] == 4), 3)
    known = known.withColumn("early", early)
    bit = lambda c, i: F.floor(c / F.pow(F.lit(2.0), i)) % 2
    combos = known.where("early is null").select("*", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.col("n")) - 1).cast("int"))).alias("c"))
    own = F.forall(F.transform("v", lambda x, i: x["allele"] - 1 == bit(F.col("c"), i)), lambda x: x)
    changed = F.aggregate(F.transform("v", lambda x, i: F.struct(x["at"].alias("at"), F.when(bit(F.col("c"), i) == 0, x["a1"]).otherwise(x["a2"]).alias("base"))), F.col("seq"), lambda s, x: F.overlay(s, x["base"], x["at"] + 1, F.lit(1)))
    tried = combos.where(~own).select(F.concat_ws("#", "read_id", "c").alias("key"), F.col("read_id").alias("of"), "c", "chr", "strand", "blocks", changed.alias("seq"))
    again = align(tried.select(F.col("key").alias("read_id"), "seq"), genome, options, **how)
    w = Window.partitionBy("read_id")
    best = again.withColumn("_best", F.max("score").over(w)).where("score + 1 >= _best").withColumn("_n", F.count("*").over(w))
    # the changed sequence is in the strand's orientation, so the same place is on strand 1
    met = best.groupBy(F.col("read_id").alias("key")).agg(F.max("_best").alias("score"), F.max("_n").alias("k"), F.first("chr").alias("chr_"), F.first("strand").alias("strand_"), F.first("blocks").alias("blocks_"))
    judged = tried.join(met, "key", "left")
    kind = F.when(F.col("score").isNull() | (F.col("score") < F.floor((F.length("seq") - 1) * score_part)), 4).when(F.col("k") > 1, 5).when((F.col("chr") != F.col("chr_")) | (F.col("strand_") != 1) | (F.col("blocks") != F.col("blocks_")), 6).otherwise(1)
    worst = judged.select(F.col("of").alias("read_id"), "c", kind.alias("kind")).groupBy("read_id").agg(F.min_by("kind", F.when(F.col("kind") > 1, F.col("c"))).alias("late"))
    return known.select("read_id", "early").join(worst, "read_id", "left").select("read_id", F.coalesce("early", "late", F.lit(1)).alias("type"))
