"""Sorted 64-bit keys: compact blocks for exchanges, exact counts by ranges, lookups in held arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
#: Keys that a task sorts together before they leave it.
FLUSH = 1 << 21
#: Bytes of text for each range of keys; a range is merged in one task.
RANGE_BYTES = 1 << 23


def range_bits(docs: DataFrame, text_col: str = "text") -> int:
    """Leading bits of a key that name its range; the number of ranges follows the size of the texts."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(6, math.ceil(math.log2(max(1, size) / RANGE_BYTES)))


def encode(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the gaps between them, in as many bytes as the widest gap needs."""
    gaps = keys[1:] - keys[:-1]
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode(block: bytes) -> np.ndarray:
    data = np.frombuffer(block, np.uint8)
    width = int(data[0])
    body = data[9:].reshape(-1, width)
    out = np.zeros((len(body) + 1, 8), np.uint8)
    out[0] = data[1:9]
    out[1:, :width] = body
    return np.cumsum(out.view(_U).ravel(), dtype=_U)


def sparse(counts: np.ndarray) -> bytes:
    """The counts over 1 with their places."""
    at = np.flatnonzero(counts > 1)
    return at.astype(np.uint32).tobytes() + counts[at].astype(np.uint32).tobytes()


def dense(block: bytes, n: int) -> np.ndarray:
    both = np.frombuffer(block, np.uint32).reshape(2, -1)
    out = np.ones(n, np.int64)
    out[both[0]] = both[1]
    return out


def starts(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbours begin."""
    if not len(values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def pieces(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of the runs of a sorted array of ranges."""
    edges = [*starts(part).tolist(), len(part)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield int(part[lo]), lo, hi


def key_counts(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, size: int = 64, least: int = 1) -> DataFrame:
    """(key, c) for the keys of ``size`` bits that keys_of yields and that occur at least so often.

    A task counts a few million keys at a time; what leaves it is a block of distinct
    keys for each range, some bytes a key, so a key of any frequency is one entry of
    a block. A range's blocks are merged in one task; its size does not grow with the input.
    """

    def fill(batches):
        held: list[np.ndarray] = []
        many = 0

        def flush():
            keys = np.sort(np.concatenate(held))
            first = starts(keys)
            count = np.diff(np.concatenate((first, [len(keys)])))
            keys = keys[first]
            cut = list(pieces((keys >> _U(size - bits)).astype(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in cut], pa.int64()), pa.array([encode(keys[a:b]) for _, a, b in cut], pa.binary()), pa.array([sparse(count[a:b]) for _, a, b in cut], pa.binary())], ["part", "keys", "many"])

        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                many += len(keys)
                if many >= FLUSH:
                    yield flush()
                    held, many = [], 0
        if many:
            yield flush()

    def merge(key, group):
        found = [decode(x.as_buffer()) for x in group.column("keys")]
        count = np.concatenate([dense(x.as_buffer(), len(k)) for x, k in zip(group.column("many"), found, strict=True)])
        keys = np.concatenate(found)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = starts(keys)
        total = np.add.reduceat(count[order], first)
        good = total >= least
        return pa.table({"key": keys[first][good].view(np.int64), "c": total[good]})

    return rows.mapInArrow(fill, "part long, keys binary, many binary").groupBy("part").applyInArrow(merge, "key long, c long")


class Held:
    """Values of sorted distinct keys that every task holds, found by the keys' leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = _U(64 - max(8, math.ceil(math.log2(max(1, len(keys))))))
        edges = np.arange((1 << int(64 - self.shift)) + 1, dtype=np.float64)
        self.at = np.searchsorted((self.keys >> self.shift).astype(np.float64), edges).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the held keys, whether it is there)."""
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.at[bucket], self.at[bucket + 1]
        found = np.zeros(len(keys), bool)
        live = np.flatnonzero(at < end)
        while live.size:
            here, want = self.keys[at[live]], keys[live]
            found[live[here == want]] = True
            live = live[here < want]
            at[live] += 1
            live = live[at[live] < end[live]]
        return at, found


def least_count(counted: DataFrame, most: int) -> int:
    """The smallest count, in steps of an eighth of a doubling, that at most ``most`` rows reach."""
    steps = counted.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62
    for row in steps:
        total += row["n"]
        if total > most:
            break
        least = row["c"]
    return least


def columns(rows: DataFrame, *names: str) -> list[np.ndarray]:
    """Rows of bounded number as arrays; the first column as unsigned keys."""
    table = rows.select(*names).toArrow()
    key, *rest = (table.column(n).to_numpy() for n in names)
    return [key.astype(np.int64).view(_U), *rest]
