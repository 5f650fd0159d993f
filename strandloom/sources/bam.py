"""BAM files as rows like those of SAM, and rows as BAM part files."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: nucleotide nibbles, CIGAR operations, tag types, the block that ends a file.
NIBBLES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TYPES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_PAIRS = [a + b for a in NIBBLES for b in NIBBLES]
COLUMNS = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags array<string>"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]


def _tags(data: bytes, at: int, end: int) -> list[str]:
    out = []
    while at < end:
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in TYPES:
            size = struct.calcsize("<" + TYPES[kind])
            value = struct.unpack_from("<" + TYPES[kind], data, at)[0]
            at += size
            out.append(f"{name}:f:{value:g}" if kind == "f" else f"{name}:i:{value}")
        elif kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind == "B":
            inner, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{TYPES[inner]}", data, at + 5)
            at += 5 + n * struct.calcsize("<" + TYPES[inner])
            out.append(f"{name}:B:{inner}," + ",".join(f"{v:g}" if inner == "f" else str(v) for v in values))
        else:
            stop = data.index(0, at)
            out.append(f"{name}:{kind}:{data[at:stop].decode()}")
            at = stop + 1
    return out


def records(data: bytes) -> Iterator[tuple]:
    """The alignment rows of an uncompressed BAM file, positions 1-based as in SAM."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    count, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
    for _ in range(count):
        n = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + n].decode())
        at += 8 + n
    while at < len(data):
        size, ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
        end, at = at + 4 + size, at + 36
        name = data[at : at + n_name - 1].decode()
        at += n_name
        cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", data, at))
        at += 4 * n_ops
        seq = "".join(_PAIRS[b] for b in data[at : at + (n_seq + 1) // 2])[:n_seq]
        at += (n_seq + 1) // 2
        qual = data[at : at + n_seq]
        at += n_seq
        text = "*" if not n_seq or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
        mate_name = "*" if mate < 0 else "=" if mate == ref else names[mate]
        yield name, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar or "*", mate_name, mate_pos + 1, tlen, seq or "*", text, _tags(data, at, end)
        at = end


def bam(spark: SparkSession, path) -> DataFrame:
    """(file, line, then the columns of sam()) of BAM files; a file is read by one task, so files are what parallel reading divides."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, line = [], 0
                for row in records(gzip.decompress(content.as_buffer())):
                    rows.append((file.as_py(), line, *row))
                    line += 1
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), *_KINDS], strict=True)], ["file", "line", *_NAMES])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, line long, {COLUMNS}")


def _encoded_tag(tag: str) -> bytes:
    name, kind, value = tag.split(":", 2)
    if kind == "i":
        return name.encode() + b"i" + struct.pack("<i", int(value))
    if kind == "f":
        return name.encode() + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return name.encode() + b"A" + value.encode()
    if kind == "B":
        inner, *values = value.split(",")
        parsed = [float(v) if inner == "f" else int(v) for v in values]
        return name.encode() + b"B" + inner.encode() + struct.pack(f"<i{len(parsed)}{TYPES[inner]}", len(parsed), *parsed)
    return name.encode() + kind.encode() + value.encode() + b"\0"


def region_bin(begin: int, end: int) -> int:
    last = end - 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == last >> shift:
            return offset + (begin >> shift)
    return 0


def record(row: dict, numbers: dict[str, int]) -> bytes:
    """One row of sam() as a BAM record."""
    cigar = [] if row["cigar"] in (None, "*") else _operations(row["cigar"])
    span = sum(n for n, op in cigar if op in "MDN=X") or 1
    ref = numbers.get(row["rname"], -1)
    mate = ref if row["rnext"] == "=" else numbers.get(row["rnext"], -1)
    seq = "" if row["seq"] in (None, "*") else row["seq"].upper()
    nibbles = [NIBBLES.find(c) if c in NIBBLES else 15 for c in seq] + [0] * (len(seq) % 2)
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(ord(c) - 33 for c in row["qual"])
    pos = (row["pos"] or 0) - 1
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(row["qname"]) + 1, row["mapq"] or 0, region_bin(max(pos, 0), max(pos, 0) + span), len(cigar), row["flag"], len(seq), mate, (row["pnext"] or 0) - 1, row["tlen"] or 0)
    body += row["qname"].encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | OPERATIONS.index(op)) for n, op in cigar)
    body += bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True)) + qual + b"".join(_encoded_tag(t) for t in row["tags"] or [])
    return struct.pack("<i", len(body)) + body


def _operations(cigar: str) -> list[tuple[int, str]]:
    out, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), c))
            n = ""
    return out


def block(data: bytes, level: int = 6) -> bytes:
    """One compressed block of at most 65,280 bytes of data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header(lines: list[str], chromosomes: list[tuple[str, int]]) -> bytes:
    text = "".join(f"{x}\n" for x in lines).encode()
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in chromosomes)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(chromosomes)) + refs


def write_bam(rows: DataFrame, path: str, lines: list[str], chromosomes: list[tuple[str, int]], level: int = 6) -> int:
    """Writes each partition of rows like sam()'s as a BAM part file of its own in a folder that all executors share; returns the number of rows.

    Order rows with coordinate_sort first: parts in their order are then one sorted file. A task run again writes the same file again.
    """
    numbers = {n: i for i, (n, _) in enumerate(chromosomes)}
    start = header(lines, chromosomes)

    def run(batches):
        system, folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        system.create_dir(folder, recursive=True)
        count, held = 0, bytearray(start)
        with system.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId():05d}.bam", compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    held += record(row, numbers)
                    count += 1
                    while len(held) >= 65_280:
                        out.write(block(bytes(held[:65_280]), level))
                        del held[:65_280]
            while held:
                out.write(block(bytes(held[:65_280]), level))
                del held[:65_280]
            out.write(END)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    return rows.select(*_NAMES).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
