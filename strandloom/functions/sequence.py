"""Sequence expressions on STRING and 2-bit LONG columns; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nucleotide codes (IUPAC) and their complements.
CODES, COMPLEMENTS = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
MOTIFS = (("GT", "AG", 1), ("CT", "AC", 2), ("GC", "AG", 3), ("CT", "GC", 4), ("AT", "AC", 5), ("GT", "AT", 6))
_EVEN = 0x5555555555555555


def complement(seq: Column) -> Column:
    return F.translate(seq, CODES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def to_digits(seq: Column) -> Column:
    """A, C, G, T, anything else as 0, 1, 2, 3, 4."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGTN", "01234")


def encode(seq: Column) -> Column:
    """The 2-bit code of up to 31 nucleotides; null if the string holds another letter."""
    return F.when(seq.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long"))


def decode(code: Column, length: int) -> Column:
    """The string of a 2-bit code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def unknown_position(seq: Column) -> Column:
    """0-based place of the only N; -1 without N, -2 with more."""
    count = F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))
    return F.when(count == 0, -1).when(count == 1, F.instr(seq, "N") - 1).otherwise(-2)


def mismatches(a: Column, b: Column) -> Column:
    """Number of different nucleotides of two 2-bit codes of one length."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(_EVEN))).cast("int")


def neighbours(code: Column, length: int) -> Column:
    """The 3 * length codes at one mismatch."""
    return F.array(*(code.bitwiseXOR(F.lit(d << (2 * i)).cast("long")) for i in range(length) for d in (1, 2, 3)))


def valid_umi(seq: Column) -> Column:
    """No N and not one nucleotide repeated."""
    return ~seq.contains("N") & ~seq.rlike("^(A+|C+|G+|T+)$")


def motif(donor: Column, acceptor: Column) -> Column:
    """1..6 for the canonical motifs of an intron's first and last two bases, else 0."""
    out = F.lit(0)
    for left, right, code in reversed(MOTIFS):
        out = F.when((donor == left) & (acceptor == right), code).otherwise(out)
    return out


def motif_strand(code: Column) -> Column:
    """0 undefined, 1 plus (odd motifs), 2 minus."""
    return F.when(code == 0, 0).otherwise(F.lit(2) - code % 2).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Number of different characters in the first of two strings' common length."""
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda acc, i: acc + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))


def local_hamming(text: Column, query: Column) -> Column:
    """struct(distance, position): the least distance of the query along the text, leftmost; N of the query is free."""
    n, m = F.length(text), F.length(query)
    at = F.sequence(F.lit(0), n - m)

    def one(p):
        part = F.substring(text, p + 1, m)
        bad = F.aggregate(F.sequence(F.lit(1), m), F.lit(0), lambda acc, i: acc + ((F.substring(query, i, F.lit(1)) != "N") & (F.substring(part, i, F.lit(1)) != F.substring(query, i, F.lit(1)))).cast("int"))
        return F.struct(bad.alias("distance"), p.alias("position"))

    return F.when(n >= m, F.array_min(F.transform(at, one)))


def clamp_quality(qual: Column, low: int = 33, high: int = 126, shift: int = 0) -> Column:
    """Each quality character moved by ``shift`` and kept in the printable range."""
    moved = F.transform(F.split(qual, ""), lambda c: F.char(F.least(F.greatest(F.ascii(c) + shift, F.lit(low)), F.lit(high))))
    return F.when(F.length(qual) == 0, qual).otherwise(F.array_join(moved, ""))


def region_bin(begin: Column, end: Column) -> Column:
    """The BAM index bin of [begin, end)."""
    last = end - 1
    out = F.lit(0)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(begin, shift) == F.shiftright(last, shift), F.lit(offset) + F.shiftright(begin, shift)).otherwise(out)
    return out


def mapq(nh: Column) -> Column:
    """255 for one locus, 3 for two, 1 for three or four, else 0."""
    return F.when(nh == 1, 255).when(nh == 2, 3).when(nh <= 4, 1).otherwise(0)


def length_bonus(span: Column, scale: float = -0.25) -> Column:
    """The score's part for the genomic length of an alignment."""
    return F.ceil(F.log2(F.greatest(span, F.lit(1)).cast("double")) * scale - 0.5).cast("int")
