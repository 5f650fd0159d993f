"""Vectorised text primitives shared by the Arrow-batched operators.

Every helper works on the contiguous UTF-8 buffer of an Arrow string column, in
chunks of a few hundred kilobytes, so that the cost per document is a handful of
NumPy calls and the memory per task is bounded by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 256 * 1024

_MULT = np.uint64(0x9E6C63D0876A9A47)
_U = np.uint64

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Byte -> byte with A-Z lowered; other bytes (also of multi-byte letters) unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER_PLUS = LOWER.astype(np.uint64) + _U(1)
_PLUS = np.arange(256, dtype=np.uint64) + _U(1)

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        inverse = pow(int(_MULT), -1, 1 << 64)
        for name, value in (("up", int(_MULT)), ("down", inverse)):
            p = np.full(size, _U(value), dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (in place on a copy)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of runs of whole documents."""
    data, bounds = text_buffer(column)
    n, lo = len(bounds) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 4096)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def prefix_hash(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(H, D): the hash of data[i:j] is (H[j] - H[i]) * D[i]."""
    up, down = _power(len(data))
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum((_LOWER_PLUS if lower else _PLUS)[data] * up[: len(data)], out=h[1:])
    return h, down


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of non-whitespace bytes; runs end with their document."""
    inside = ~WHITESPACE[data]
    if not inside.size:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = inside[begins]
    closes = bounds[1:][bounds[1:] > 0] - 1
    last[closes] = inside[closes]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the lower-cased word, document of the word, first word of each document and the end)."""
    starts, ends, doc = words(data, bounds)
    h, down = prefix_hash(data, lower=True)
    value = mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return value, doc, np.searchsorted(doc, np.arange(len(bounds)))


_STEP = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its word shingles.

    Fewer than ``width`` words make one shingle of them all; no words make none.
    """
    value, doc, first = word_hashes(data, bounds)
    n = len(value)
    steps = [_STEP[j % 5] * _U(2 * (j // 5) + 1) for j in range(width)]
    m = max(n - width + 1, 0)
    rolled = np.zeros(m, np.uint64)
    for j in range(width):
        rolled += value[j : j + m] * steps[j]
    rolled = mix(rolled)
    for d in range(len(bounds) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            few = np.zeros(1, np.uint64)
            for j in range(b - a):
                few += value[a + j : a + j + 1] * steps[j]
            yield mix(few + _U(0x2545F4914F6CDD1D) * _U(int(b - a)))
        else:
            yield np.empty(0, np.uint64)
