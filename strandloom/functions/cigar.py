"""CIGAR expressions; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def operations(cigar: Column) -> Column:
    """ARRAY<STRUCT<op, len>> of a CIGAR string."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("len")))


def _total(cigar: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(operations(cigar), F.lit(0), lambda acc, o: acc + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    return _total(cigar, ("M", "D", "N", "=", "X"))


def read_length(cigar: Column) -> Column:
    return _total(cigar, ("M", "I", "S", "=", "X"))


def soft_start(cigar: Column) -> Column:
    """Length of the leading soft clip."""
    return F.coalesce(F.regexp_extract(cigar, "^([0-9]+)S", 1).try_cast("int"), F.lit(0))


def soft_end(cigar: Column) -> Column:
    """Length of the trailing soft clip."""
    return F.coalesce(F.regexp_extract(cigar, "([0-9]+)S$", 1).try_cast("int"), F.lit(0))


def extended_start(pos: Column, cigar: Column) -> Column:
    """The start as if the soft clip were aligned."""
    return pos - soft_start(cigar)


def extended_cigar(cigar: Column) -> Column:
    """The CIGAR with soft clips counted as matches."""
    merged = F.regexp_replace(cigar, "S", "M")
    ops = F.aggregate(
        operations(merged),
        F.array().cast("array<struct<op:string,len:int>>"),
        lambda acc, o: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["op"] == o["op"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(o["op"].alias("op"), (F.element_at(acc, -1)["len"] + o["len"]).alias("len"))))).otherwise(F.concat(acc, F.array(o))),
    )
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def blocks(pos: Column, cigar: Column) -> Column:
    """ARRAY<STRUCT<begin, end>>: aligned reference blocks, half-open, cut at introns only."""
    state = F.struct(pos.cast("long").alias("at"), pos.cast("long").alias("begin"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("out"))

    def step(acc, o):
        moves = o["op"].isin("M", "D", "=", "X")
        at = acc["at"] + F.when(moves | (o["op"] == "N"), o["len"]).otherwise(0)
        jump = o["op"] == "N"
        closed = F.concat(acc["out"], F.array(F.struct(acc["begin"].alias("begin"), acc["at"].alias("end"))))
        return F.struct(at.cast("long").alias("at"), F.when(jump, at).otherwise(acc["begin"]).cast("long").alias("begin"), F.when(jump, closed).otherwise(acc["out"]).alias("out"))

    return F.aggregate(operations(cigar), state, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["begin"].alias("begin"), acc["at"].alias("end")))))


def introns(pos: Column, cigar: Column) -> Column:
    """ARRAY<STRUCT<start, end>> of the introns, half-open."""
    b = blocks(pos, cigar)
    return F.when(F.size(b) > 1, F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: F.struct(b[i]["end"].alias("start"), b[i + 1]["begin"].alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def build(blocks_col: Column, read_len: Column) -> Column:
    """The CIGAR of ARRAY<STRUCT<r, g, len>> blocks of one mate: soft clips, matches, insertions, deletions and introns (21 bases or more)."""
    first, last = F.element_at(blocks_col, 1), F.element_at(blocks_col, -1)
    lead = F.when(first["r"] > 0, F.concat(first["r"].cast("string"), F.lit("S"))).otherwise("")

    def piece(b, i):
        nxt = F.try_element_at(blocks_col, i + 2)
        dr, dg = nxt["r"] - b["r"] - b["len"], nxt["g"] - b["g"] - b["len"]
        insert = F.when(dr > 0, F.concat(dr.cast("string"), F.lit("I"))).otherwise("")
        gap = F.when(dg >= 21, F.concat(dg.cast("string"), F.lit("N"))).when(dg > 0, F.concat(dg.cast("string"), F.lit("D"))).otherwise("")
        return F.concat(b["len"].cast("string"), F.lit("M"), F.when(nxt.isNull(), "").otherwise(F.concat(insert, gap)))

    rest = read_len - last["r"] - last["len"]
    tail = F.when(rest > 0, F.concat(rest.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(lead, F.array_join(F.transform(blocks_col, piece), ""), tail)


_OPS = "array<struct<op:string,len:int>>"


def _op(kind: Column | str, length: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("op"), length.cast("int").alias("len"))


def text(ops: Column) -> Column:
    """The CIGAR string of ARRAY<STRUCT<op, len>>."""
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def length_of(ops: Column, *kinds: str) -> Column:
    """Bases of all operations of these kinds."""
    return F.aggregate(ops, F.lit(0), lambda acc, o: acc + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def cut_at(ops: Column, pos: Column, stretches: Column) -> Column:
    """Operations from pos on, cut where a stretch ends, with an N of the gap behind it.

    stretches is an array of (start, end, gap) in order; the last has a null gap.
    """

    def parts(o, i):
        begin = pos + length_of(F.slice(ops, 1, i), "M", "D", "N")
        end = begin + o["len"]
        met = F.filter(stretches, lambda p: (p["start"] < end) & (p["end"] > begin))
        cut = F.flatten(F.transform(met, lambda p: F.array(_op(o["op"], F.least(p["end"], end) - F.greatest(p["start"], begin)), _op("N", F.when(p["end"] <= end, p["gap"])))))
        return F.when(o["op"].isin("M", "D", "N"), F.filter(cut, lambda x: x["len"] > 0)).otherwise(F.array(_op(o["op"], o["len"])))

    return F.flatten(F.transform(ops, parts))


def merged(ops: Column) -> Column:
    """Equal neighbours as one operation; an N behind an insertion that follows an N joins that N."""

    def step(acc, o):
        last, other, n = F.try_element_at(acc, F.lit(-1)), F.try_element_at(acc, F.lit(-2)), F.size(acc)
        longer = F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(_op(o["op"], last["len"] + o["len"])))
        around = F.concat(F.slice(acc, 1, F.greatest(n - 2, F.lit(0))), F.array(_op("N", other["len"] + o["len"]), last))
        return F.when(last["op"] == o["op"], longer).when((o["op"] == "N") & (last["op"] == "I") & (other["op"] == "N"), around).otherwise(F.concat(acc, F.array(o)))

    return F.aggregate(ops, F.array().cast(_OPS), step)


def without_last_gap(ops: Column) -> Column:
    """Without an N at the end or before a last soft clip."""
    n = F.size(ops)
    last, other = F.try_element_at(ops, F.lit(-1)), F.try_element_at(ops, F.lit(-2))
    clipped = F.concat(F.slice(ops, 1, F.greatest(n - 2, F.lit(0))), F.array(last))
    return F.when(last["op"] == "N", F.slice(ops, 1, F.greatest(n - 1, F.lit(0)))).when((last["op"] == "S") & (other["op"] == "N"), clipped).otherwise(ops)


def short_head(ops: Column, overhang: int) -> Column:
    """How many operations stand before the M behind the first N, if fewer than ``overhang`` bases match before that N; else 0."""
    kinds = F.transform(ops, lambda o: o["op"])
    gap = F.array_position(kinds, "N").cast("int")
    behind = F.array_position(F.slice(kinds, gap + 1, F.size(ops)), "M").cast("int")
    short = (gap > 1) & (behind > 0) & (length_of(F.slice(ops, 1, F.greatest(gap - 1, F.lit(0))), "M") < overhang)
    return F.when(short, gap + behind - 1).otherwise(0)


def clipped_head(ops: Column, k: Column) -> Column:
    """The first k operations as one soft clip."""
    head = F.slice(ops, 1, k)
    return F.when(k > 0, F.concat(F.array(_op("S", length_of(head, "M", "I", "S"))), F.slice(ops, k + 1, F.size(ops)))).otherwise(ops)
