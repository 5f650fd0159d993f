"""Repeated byte strings by a depth-limited radix order of suffixes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bloom, settle, slices, store
from ._text import chunks, mix, prefix_hash

_U = np.uint64
_TOP = _U(0xFFFFFFFFF0000000)
_LOW = _U(0x000000000FFFFFFF)


@dataclass(frozen=True)
class RepeatOptions:
    """length: bytes of a repeated string, the depth of the order; gram: bytes of the first digit;
    digit: bytes of a later digit; hot: suffixes in a first-digit group that one task may order;
    salts: parts of a larger group; piece: bytes of a document that are held as arrays at once."""

    length: int = 200
    gram: int = 72
    digit: int = 100
    hot: int = 50_000
    salts: int = 64
    piece: int = 1 << 26


def _segments(data: np.ndarray, bounds: np.ndarray, o: RepeatOptions):
    """(first digit, document, first start, last start) of each run of suffix starts that share an anchor.

    The anchor of a window of ``length`` bytes is the smallest hash of the grams
    in it, leftmost of equals: equal windows have it at the same place, so the gram
    is a first digit that equal windows share, and a run of neighbouring suffixes
    needs one row instead of one each.
    """
    n, span = len(data), o.length - o.gram + 1
    none = np.empty(0, np.int64)
    if n < o.length:
        return np.empty(0, np.uint64), none, none, none, None, None
    h, down = prefix_hash(data)
    m = n - o.gram + 1
    gram = mix((h[o.gram :] - h[: -o.gram]) * down[:m])
    blocks = -(-m // span)
    padded = np.full(blocks * span, _U(0xFFFFFFFFFFFFFFFF))
    padded[:m] = (gram & _TOP) | np.arange(m, dtype=np.uint64)
    square = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = m - span + 1
    anchor = (np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & _LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:starts]
    at = np.flatnonzero(np.arange(starts) + o.length <= bounds[1:][doc])
    if not at.size:
        return np.empty(0, np.uint64), none, none, none, None, None
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return gram[anchor[new]], doc[at[new]], at[new], at[last], h, down


def _pieces(column: pa.Array, o: RepeatOptions):
    """As chunks(), but a document longer than a piece comes as overlapping pieces: (row, data, bounds, offset)."""
    for lo, _, data, bounds in chunks(column):
        if len(data) <= o.piece:
            yield lo, data, bounds, 0
        else:
            for begin in range(0, len(data) - o.length + 1, o.piece):
                part = data[begin : begin + o.piece + o.length - 1]
                yield lo, part, np.array([0, len(part)]), begin


def _first_digits(o: RepeatOptions):
    def run(batches):
        done: set[int] = set()
        for batch in batches:
            of = batch.column(0).to_numpy()
            for row, data, bounds, offset in _pieces(batch.column(1), o):
                key, doc, lo, _, _, _ = _segments(data, bounds, o)
                text = of[row + doc]
                if len(key):
                    fresh = _fresh(of[row : row + len(bounds) - 1], done, offset)
                    keep = fresh[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(text[keep]), pa.array(lo[keep] - bounds[doc[keep]] + offset)], ["key", "text_id", "at"])

    return run


def _fresh(ids: np.ndarray, done: set[int], offset: int) -> np.ndarray:
    """Which of these texts a task has not seen; later pieces of a text go with its first."""
    if offset:
        return np.ones(len(ids), bool)
    out = np.zeros(len(ids), bool)
    for i, x in enumerate(ids.tolist()):
        if x not in done:
            done.add(x)
            out[i] = True
    return out


def _suffix_rows(o: RepeatOptions, wanted):
    """The suffix runs whose first digit may be shared, with their bytes, and with the salt that tells parts of a large group.

    Equal runs met in one chunk are settled there: each is reported as repeated,
    and one of them goes on for others to be compared with.
    """

    def run(batches):
        keep = wanted.value
        done: set[int] = set()
        for batch in batches:
            of = batch.column(0).to_numpy()
            for row, data, bounds, offset in _pieces(batch.column(1), o):
                key, doc, lo, hi, h, down = _segments(data, bounds, o)
                if not len(key):
                    continue
                fresh = _fresh(of[row : row + len(bounds) - 1], done, offset)
                pick = np.flatnonzero(keep.test(key) & fresh[doc])
                if not pick.size:
                    continue
                key, doc, lo, hi = key[pick], doc[pick], lo[pick], hi[pick]
                whole = mix((h[hi + o.length] - h[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _U(0xD1B54A32D192ED03))
                _, first, inverse, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                twice = count[inverse] > 1
                sent = np.zeros(len(key), bool)
                sent[first] = True
                salt = whole % _U(o.salts)
                text, base = of[row + doc], offset - bounds[doc]
                size = np.where(sent, hi - lo + o.length, 0)
                ends = np.concatenate(([0], np.cumsum(size[sent])))
                body = data[np.repeat(lo[sent] - ends[:-1], size[sent]) + np.arange(ends[-1])]
                spans = pa.Array.from_buffers(pa.binary(), int(sent.sum()), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                names = ["key", "text_id", "lo", "hi", "span", "twice", "salt"]
                yield pa.RecordBatch.from_arrays([pa.array(key[sent].view(np.int64)), pa.array(text[sent]), pa.array((lo + base)[sent]), pa.array((hi + base)[sent]), spans, pa.array(twice[sent]), pa.array(salt[sent].astype(np.int64))], names)
                if twice.any():
                    told = int(twice.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(mix(text[twice].view(np.uint64)).view(np.int64)), pa.array(text[twice]), pa.array((lo + base)[twice]), pa.array((hi + base)[twice]), pa.nulls(told, pa.binary()), pa.array([True] * told), pa.array(np.zeros(told, np.int64))], names)

    return run


def _equal(h, down, at, o: RepeatOptions):
    """(windows that another equals, label of each window): passes over the digits, most significant first."""
    alive, label = np.arange(len(at)), np.zeros(len(at), np.uint64)
    for j in range(0, o.length, o.digit):
        a = at[alive] + j
        width = min(o.digit, o.length - j)
        digit = mix((h[a + width] - h[a]) * down[a] + mix(label[alive] + _U(j + 1)))
        label[alive] = digit
        order = np.argsort(digit)
        same = digit[order[1:]] == digit[order[:-1]]
        many = np.zeros(len(order), bool)
        many[1:] |= same
        many[:-1] |= same
        alive = alive[order[many]]  # groups of one are in order already
    return alive, label


def _order_groups(o: RepeatOptions):
    """Orders the suffixes of whole first-digit groups through ``length`` bytes; reports the starts in groups of two or more."""
    names = ["text_id", "lo", "hi", "window", "n"]

    def solve(table: pa.Table):
        table = table.combine_chunks()
        span = table.column("span").combine_chunks() if table.num_rows else None
        text, lo, hi, twice, hot = (table.column(c).to_numpy() for c in ("text_id", "lo", "hi", "twice", "hot"))
        bare = np.asarray(span.is_null())
        if bare.any():
            yield text[bare], lo[bare], hi[bare], None, None
        text, lo, hi, twice, hot, span = text[~bare], lo[~bare], hi[~bare], twice[~bare], hot[~bare], span.drop_null()
        if not len(text):
            return
        ends = np.frombuffer(span.buffers()[1], np.int32)[span.offset : span.offset + len(span) + 1].astype(np.int64)
        data = np.frombuffer(span.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        h, down = prefix_hash(data)
        each = hi - lo + 1
        begin = np.concatenate(([0], np.cumsum(each)))
        row = np.repeat(np.arange(len(each)), each)
        within = np.arange(begin[-1]) - begin[:-1][row]
        alive, label = _equal(h, down, ends[:-1][row] + within, o)
        found = np.zeros(len(row), bool)
        found[alive] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], found, [False])).astype(np.int8)))
        # runs of repeated starts, cut where a row ends
        cut = np.zeros(len(row) + 1, bool)
        cut[edge] = True
        cut[begin[1:-1]] |= found[begin[1:-1] - 1] & found[begin[1:-1]]
        marks = np.flatnonzero(cut)
        firsts = marks[(marks < len(row)) & found[np.minimum(marks, len(row) - 1)]]
        if firsts.size:
            closes = marks[np.searchsorted(marks, firsts, side="right")] - 1
            yield text[row[firsts]], (lo[row] + within)[firsts], (lo[row] + within)[closes], None, None
        large = hot[row]
        if large.any():
            a = ends[:-1][row] + within
            window = mix((h[a + o.length] - h[a]) * down[a] + _U(o.length))
            alone = large & ~found & ~twice[row]
            yield text[row[alone]], (lo[row] + within)[alone], (lo[row] + within)[alone], window[alone].view(np.int64), np.ones(int(alone.sum()), np.int64)
            many = np.unique(window[large & ~alone])
            none = np.zeros(len(many), np.int64)
            yield none, none, none, many.view(np.int64), np.full(len(many), 2, np.int64)

    def batch_of(text, lo, hi, window, n):
        w = pa.nulls(len(text), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(text), pa.array(lo), pa.array(hi), w if window is None else pa.array(window), w if n is None else pa.array(n)], names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 4000:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if whole:
                for x in solve(table.slice(0, whole)):
                    yield batch_of(*x)
                rest = table.slice(whole).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
        if held:
            for x in solve(pa.Table.from_batches(held)):
                yield batch_of(*x)

    return run


def repeated_starts(texts: DataFrame, options: RepeatOptions = RepeatOptions()) -> DataFrame:
    """(text_id, ranges of starts) where a string of ``length`` bytes begins that also begins elsewhere.

    texts has (text_id long, text string), one text per id; rows repeated with
    the same id and text count once. The suffixes are ordered by most significant
    digits first: the first pass groups them by the gram at their anchor and keeps
    the groups of two or more; the rest of each is ordered through ``length`` bytes
    in the tasks, and equal groups are the repeated strings. A group larger than
    ``hot`` is split by content into salted parts, and what is single in its part
    is counted again by the hash of the whole string. Equality is that of two
    64-bit digits of 100 bytes under a 64-bit gram.
    """
    spark = texts.sparkSession
    texts = texts.select("text_id", "text").where(F.octet_length("text") >= options.length)
    digits = texts.mapInArrow(_first_digits(options), "key long, text_id long, at long")
    place = F.struct("text_id", "at")
    groups = digits.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi")
    groups = store(groups.select("key", "n"))
    size = groups.count()
    keep = spark.sparkContext.broadcast(bloom(groups, "key", size))
    rows = texts.mapInArrow(_suffix_rows(options, keep), "key long, text_id long, lo long, hi long, span binary, twice boolean, salt long")
    # few keys lead large groups, at most one for each ``hot`` rows; Spark broadcasts them if they are small and joins them by key if not
    large = store(groups.where(F.col("n") > options.hot).select("key", F.lit(True).alias("hot")))
    rows = rows.join(large, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("hot"), F.xxhash64("key", "salt")).otherwise(F.col("key"))).drop("salt")
    ordered = rows.repartition("key").sortWithinPartitions("key")
    found = store(ordered.mapInArrow(_order_groups(options), "text_id long, lo long, hi long, window long, n long"))
    windows = found.where("window is not null")
    many = windows.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").select("window")
    more = windows.where("n = 1").join(many, "window")
    plain = found.where("window is null")
    return plain.unionByName(more.select(*plain.columns)).groupBy("text_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _cut(o: RepeatOptions):
    def run(batches):
        for batch in slices(batches):
            texts, ranges, copied = (batch.column(c) for c in ("text", "ranges", "copied"))
            size, gone, spans, kept = [], [], [], []
            for text, at, copy in zip(texts, ranges, copied, strict=True):
                data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                n = len(data)
                size.append(n)
                if copy.as_py() and n >= o.length:
                    gone.append(n), spans.append(1), kept.append(b"")
                elif at.is_valid:
                    lo, hi = (at.values.field(f).to_numpy() for f in ("lo", "hi"))
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, lo, 1)
                    np.add.at(step, hi + o.length, -1)
                    drop = np.cumsum(step[:-1]) > 0
                    gone.append(int(drop.sum()))
                    spans.append(int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum()))
                    kept.append(np.frombuffer(data, np.uint8)[~drop].tobytes())
                else:
                    gone.append(0), spans.append(0), kept.append(data.to_pybytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())], ["key", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def drop_repeats(docs: DataFrame, text_col: str = "text", options: RepeatOptions = RepeatOptions()) -> DataFrame:
    """(key, kept, n_bytes, n_removed, n_spans): each text's UTF-8 bytes without those in repeated strings.

    key is a struct of all other columns of the input. A byte goes if a string of
    ``length`` bytes that covers it begins anywhere else too, in the same text or
    another; all occurrences go, judged on the input. n_spans counts maximal
    removed runs. Null texts are empty. Texts with an equal in the table (rows
    repeated too) go whole if they have ``length`` bytes; shorter texts stay whole.
    kept is binary, since a cut may split a character. Texts of any length are searched whole, in overlapping pieces.
    """
    others = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_id", F.xxhash64("text")).withColumn("row_key", F.xxhash64("key", "text_id"))
    ids = settle(rows.select("row_key", "text_id"))
    starts = repeated_starts(rows.select("text_id", "text"), options)
    per = ids.groupBy("text_id").agg(F.count("*").alias("n"), F.first("row_key").alias("row_key"))
    alone = per.where("n = 1").join(starts, "text_id").select("row_key", "ranges", F.lit(False).alias("copied"))
    copies = ids.join(per.where("n > 1").select("text_id"), "text_id", "left_semi").select("row_key").distinct()
    marks = alone.unionByName(copies.select("row_key", F.lit(None).cast(alone.schema["ranges"].dataType).alias("ranges"), F.lit(True).alias("copied")))
    joined = rows.join(marks, "row_key", "left").select("key", "text", "ranges", F.coalesce("copied", F.lit(False)).alias("copied"))
    kind = joined.schema["key"].dataType.simpleString()
    return joined.mapInArrow(_cut(options), f"key {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
