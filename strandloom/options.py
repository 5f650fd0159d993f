"""Parameter groups with the defaults that users of the command-line tool know."""

from __future__ import annotations

from dataclasses import dataclass

# Default thresholds, one per motif class (non-canonical, GT/AG, GC/AG, AT/AC).


@dataclass(frozen=True)
class JunctionFilter:
    """Filters of the collapsed junction table; a negative threshold rejects all of its class."""

    count_unique_min: tuple[int, ...] = (3, 1, 1, 1)
    count_total_min: tuple[int, ...] = (3, 1, 1, 1)
    overhang_min: tuple[int, ...] = (30, 12, 12, 12)
    distance_min: tuple[int, ...] = (10, 0, 5, 10)
    intron_max_by_reads: tuple[int, ...] = (50_000, 100_000, 200_000)


@dataclass(frozen=True)
class ReadFilter:
    """Filters of a read's alignments."""

    score_min: int = 0
    score_min_over_read: float = 0.66
    match_min: int = 0
    match_min_over_read: float = 0.66
    mismatch_max: int = 10
    mismatch_over_mapped: float = 0.3
    mismatch_over_read: float = 1.0
    multimap_max: int = 10
    score_range: int = 1


@dataclass(frozen=True)
class BarcodeMatch:
    """Barcode correction: least posterior, highest quality used, phred offset, pseudocount added to each prior."""

    min_posterior: float = 0.975
    max_quality: int = 33
    phred: int = 33
    pseudocount: int = 0
    need_exact: bool = True


@dataclass(frozen=True)
class KneeFilter:
    """Cell calling by the knee: expected cells, percentile of the robust maximum, ratio of maximum to minimum."""

    expected: int = 3000
    percentile: float = 0.99
    ratio: float = 10.0


@dataclass(frozen=True)
class EmptyDrops:
    """Cell calling against the ambient profile."""

    ambient_from: int = 45_000
    ambient_to: int = 90_000
    umi_min: int = 500
    umi_min_over_median: float = 0.01
    candidates_max: int = 20_000
    fdr: float = 0.01
    simulations: int = 10_000
    seed: int = 19760110


@dataclass(frozen=True)
class ExpectationMaximisation:
    """Multi-gene counts: counts under ``floor`` are zeroed, stop under ``change`` or after ``rounds``."""

    floor: float = 0.01
    change: float = 0.01
    rounds: int = 100
