"""Clipping expressions: adapters, poly-A tails, mate overlap, repeats around junctions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode(), np.uint8)]


def _search(x: np.ndarray, y: np.ndarray, most: float, unknown_differs: bool) -> int:
    """The offset in x at which y's start matches best: most matches, then fewest mismatches, then leftmost."""
    n, m = len(x), len(y)
    if not n or not m:
        return n
    at = np.lib.stride_tricks.sliding_window_view(np.concatenate((x, np.full(m - 1, 9, np.uint8))), m)
    inside = at != 9
    same = (at == y) & (at < 4)
    counts = same.sum(axis=1)
    bad = (inside & ~same & (unknown_differs | (at < 4))).sum(axis=1)
    good = np.flatnonzero((counts > 0) & (bad <= most * counts))
    return int(good[np.lexsort((good, bad[good], -counts[good]))[0]]) if len(good) else n


def adapter_start(seq: Column, adapter: str, mismatch_part: float = 0.1) -> Column:
    """Where an adapter begins in a read, the read's length if it isn't there; unknown bases of the read are ignored."""
    y = _codes(adapter)

    @F.pandas_udf("int")
    def run(reads: pd.Series) -> pd.Series:
        return reads.map(lambda r: _search(_codes(r), y, mismatch_part, False), na_action="ignore")

    return run(seq)


def mate_overlap(left: Column, right_reversed: Column, mismatch_part: float = 0.01) -> Column:
    """Where the reverse complement of mate 2 begins in mate 1; unknown bases count as mismatches; null without a mate."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _search(_codes(x), _codes(y), mismatch_part, True) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(left, right_reversed)


def poly_a_length(seq: Column) -> Column:
    """Bases of a poly-A tail to clip: +1 a match, -2 a mismatch, up to the tenth mismatch; the longest tail scoring 70 %, if that is 20 or more."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("bad"), F.lit(0).alias("length"), F.lit(0).alias("score"))

    def step(acc, base):
        i = acc["i"] + 1
        bad = acc["bad"] + (base != "A").cast("int")
        score = i - 3 * bad
        better = (acc["bad"] < 10) & (base == "A") & (score * 10 >= i * 7)
        return F.struct(i.alias("i"), bad.alias("bad"), F.when(better, i).otherwise(acc["length"]).alias("length"), F.when(better, score).otherwise(acc["score"]).alias("score"))

    bases = F.filter(F.split(F.reverse(seq), ""), lambda b: b != "")
    return F.when(F.length(seq) < 20, 0).otherwise(F.aggregate(bases, start, step, lambda acc: F.when(acc["score"] >= 20, acc["length"]).otherwise(0)))


def repeat_shifts(before_left: Column, before_right: Column, after_left: Column, after_right: Column) -> tuple[Column, Column]:
    """How far a junction can slide left and right, at most 255, from the sequences on both sides of its ends.

    before_* end just before the intron's first base and just at its last; after_*
    begin at the intron's first base and just after its last.
    """

    def common(a: Column, b: Column) -> Column:
        state = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))

        def step(acc, i):
            x, y = F.substring(a, i, F.lit(1)), F.substring(b, i, F.lit(1))
            on = acc["on"] & (x == y) & x.isin("A", "C", "G", "T")
            return F.struct(on.alias("on"), (acc["n"] + on.cast("int")).alias("n"))

        n = F.least(F.length(a), F.length(b), F.lit(255))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), state, step, lambda acc: acc["n"])).otherwise(0)

    return common(F.reverse(before_left), F.reverse(before_right)), common(after_left, after_right)


#: The first bases of a read in which the oligo is looked for (fixed value).
OLIGO_BASES = 91


def oligo_length(seq: Column, oligo: str) -> Column:
    """Bases to clip where a template-switching oligo overlaps the read's start.

    The best overlap alignment within the first bases: a match 1, a mismatch or a gap's base -2, ends free on both sides. It is clipped up
    to its end if it scores 22, or 21 ending within 30 bases, or 20 within 26. All reads of a batch are aligned together, a row of the
    oligo at a time; a row's gaps along the read are a running maximum.
    """
    y = _codes(oligo)

    @F.pandas_udf("int")
    def run(reads: pd.Series) -> pd.Series:
        known = reads.notna()
        x = np.full((int(known.sum()), OLIGO_BASES), 4, np.uint8)
        for i, r in enumerate(reads[known]):
            codes = _codes(r[:OLIGO_BASES])
            x[i, : len(codes)] = codes
        slope = 2 * np.arange(OLIGO_BASES + 1)
        row = np.zeros((len(x), OLIGO_BASES + 1), np.int32)
        side = row[:, -1].copy()  # the read's end may fall within the oligo
        for base in y:
            sign = np.where((x == base) & (base < 4), 1, np.where((x == 4) & (base == 4), 0, -2))
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(row[:, :-1] + sign, row[:, 1:] - 2)
            row = np.maximum.accumulate(new + slope, axis=1) - slope
            side = np.maximum(side, row[:, -1])
        end, score = row.argmax(axis=1), row.max(axis=1)
        end = np.where(side > score, OLIGO_BASES, end)
        score = np.maximum(score, side)
        good = (score >= 22) | ((score == 21) & (end <= 30)) | ((score == 20) & (end <= 26))
        out = pd.Series([None] * len(reads), dtype="Int32", index=reads.index)
        out[known] = np.where(good, end, 0)
        return out

    return run(seq)
