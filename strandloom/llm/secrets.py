"""Secret scans: patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns and least lengths of the base (fixed values), in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "entropy")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join((*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")))
ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: What the entropy scan looks at: runs long enough to hold a key.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharacterClass:
    """A window of ``width`` characters that are all in ``members`` is random if its entropy, in bits, reaches ``least``."""

    name: str
    members: frozenset[str]
    width: int
    least: float


_DIGITS, _LOWERS, _UPPERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("hex", frozenset(_DIGITS + "abcdefABCDEF"), 20, 3.0),
    CharacterClass("base32", frozenset(_UPPERS + "234567"), 20, 3.6),
    CharacterClass("base36", frozenset(_DIGITS + _LOWERS), 20, 3.5),
    CharacterClass("base64", frozenset(_DIGITS + _LOWERS + _UPPERS + "+/_=-"), 20, 3.9),
)

#: Candidates that are never reported by the entropy scan, wherever they match.
ALLOWED = (
    re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    re.compile(r"^[A-Za-z]+$"),
    re.compile(r"^[A-Za-z]+(?:[-_/][A-Za-z]+)+$"),
    re.compile(r"^(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/](?:[A-Za-z]+|[0-9]{1,4}))+$"),
    re.compile(r"(?i)example|placeholder|changeme|your[-_]"),
    re.compile(r"^(.)\1*$"),
)


def window_entropy(text: str, kind: CharacterClass) -> float:
    """The highest entropy of a window of the class in a string; -1 if no window lies in the class.

    Counts are kept as the window slides: a step changes two of them, and the sum
    of c log2 c with them.
    """
    best, run, total = -1.0, 0, 0.0
    counts: dict[str, int] = {}
    terms = [0.0, 0.0, *(c * math.log2(c) for c in range(2, kind.width + 1))]
    for i, c in enumerate(text):
        if c not in kind.members:
            run, total = 0, 0.0
            counts.clear()
            continue
        if run == kind.width:
            gone = text[i - kind.width]
            k = counts[gone]
            total += terms[k - 1] - terms[k]
            counts[gone] = k - 1
        else:
            run += 1
        k = counts.get(c, 0)
        total += terms[k + 1] - terms[k]
        counts[c] = k + 1
        if run == kind.width:
            best = max(best, math.log2(kind.width) - total / kind.width)
    return best


def is_random(text: str) -> bool:
    """Whether a candidate looks like a key: random in some class, of mixed kinds, and on no allow-list."""
    if any(p.search(text) for p in ALLOWED):
        return False
    if not (any(c.isdigit() for c in text) and any(c.isalpha() for c in text)):
        return False
    return any(window_entropy(text, k) >= k.least for k in CLASSES)


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by start, then kind as listed; offsets in code points, end exclusive.

    The base's matches always stay; a candidate that one of them covers is the same secret and adds nothing.
    """
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e in found)
    starts, reach = [s for s, _ in base], list(itertools.accumulate((e for _, e in base), max))
    for m in CANDIDATE.finditer(text):
        before = bisect.bisect_right(starts, m.start())
        if not (before and reach[before - 1] >= m.end()) and is_random(m[0]):
            found.append(("entropy", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings): for each row the findings as an array of (kind, start, end).

    Null and empty texts have none. Rows are scanned each on its own, whole, in
    Arrow batches and without a shuffle, so repeated rows each get their result;
    a long text takes time in proportion to its length. Extra columns are ignored, null ids stay,
    and an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], [id_col, "findings"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, findings array<struct<kind:string,start:long,end:long>>")
