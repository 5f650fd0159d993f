"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import slices, store, word_array


@dataclass(frozen=True)
class LineOptions:
    """min_run: lines of the shortest run that counts as repeated; also the winnowing window;
    long_line: words from which one line is a run of its own, also in a text of one line (none if not given)."""

    min_run: int = 2
    long_line: int | None = None


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: LineOptions = LineOptions()) -> DataFrame:
    """(row_key, starts, lone): for each document the first lines of the windows, and the long lines, that occur earlier.

    row_key is xxhash64(id, text). A window is min_run consecutive lines; it is
    repeated if an equal one starts earlier, in the order of (id, line number).
    Every window holds the fingerprint that winnowing selects in it (its smallest
    line hash, the leftmost of equals), so equal windows share one: positions are
    joined on fingerprints, and only matches of a repeated fingerprint are extended
    both ways, to all windows through it. Their first occurrence stays. A long
    line is a fingerprint and a window of its own.
    """
    t = options.min_run
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts, rows = rows, rows.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("hs")).where(F.size("hs") >= t)
    rows = store(rows.groupBy("row_key", "doc_id").agg(F.first("hs").alias("hs")))
    n = F.size("hs")

    def pick(s):
        window = F.slice("hs", s + 1, t)
        return (s + F.array_position(window, F.array_min(window)).cast("int") - 1).cast("int")

    marks = rows.select("row_key", "hs", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), n - t), pick))).alias("at")).select("row_key", "at", F.col("hs")[F.col("at")].alias("mark"))
    again = marks.groupBy("mark").agg(F.min(F.struct("row_key", "at")).alias("lo"), F.max(F.struct("row_key", "at")).alias("hi")).where("lo != hi").select("mark")
    at = marks.join(again, "mark").groupBy("row_key").agg(F.collect_list("at").alias("ats"))
    around = F.array_distinct(F.flatten(F.transform("ats", lambda p: F.sequence(F.greatest(p - t + 1, F.lit(0)), F.least(p, n - t)))))
    windows = rows.join(at, "row_key").select("row_key", "doc_id", "hs", F.explode(around).alias("s"))
    windows = store(windows.select("row_key", "doc_id", "s", F.xxhash64(F.slice("hs", F.col("s") + 1, t)).alias("w")))
    place = F.struct("doc_id", "row_key", "s")

    def later(windows: DataFrame, width: int) -> DataFrame:
        first = windows.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first")
        return windows.join(first, "w").where(place != F.col("first")).select("row_key", F.when(F.lit(width > 1), F.col("s")).alias("s"), F.when(F.lit(width == 1), F.col("s")).alias("one"))

    found = later(windows, t)
    if options.long_line is not None:
        found = found.unionAll(later(_long_lines(texts, options.long_line), 1))
    return found.groupBy("row_key").agg(F.collect_list("s").alias("starts"), F.collect_list("one").alias("lone"))


def _long_lines(texts: DataFrame, least: int) -> DataFrame:
    """(row_key, doc_id, s, w): the lines of at least so many words, with their hash."""

    def of(line, s):
        # so many words need a separator between each two
        long = (F.length(line) >= 2 * least - 1) & (F.size(word_array(line)) >= least)
        return F.when(long, F.struct(s.cast("int").alias("s"), F.xxhash64(line).alias("w")))

    lines = texts.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", F.explode(F.filter(F.transform(F.split("text", "\n"), of), lambda x: x.isNotNull())).alias("x"))
    return store(lines.select("row_key", "doc_id", "x.s", "x.w").distinct())


def _cut(width: int):
    def run(batches):
        for batch in slices(batches):
            texts, starts, lone = batch.column("text"), batch.column("starts"), batch.column("lone")
            kept, lines, gone, runs = [], [], [], []
            for text, *found in zip(texts, starts, lone, strict=True):
                text = text.as_py()
                if text is None:
                    for out, x in ((kept, None), (lines, 0), (gone, 0), (runs, 0)):
                        out.append(x)
                    continue
                parts = text.split("\n")
                drop = np.zeros(len(parts) + 1, np.int64)
                for at, lines_of in zip(found, (width, 1), strict=True):
                    if not at.is_valid:
                        continue
                    s = np.asarray(at.values.to_numpy(zero_copy_only=False))
                    np.add.at(drop, s, 1)
                    np.add.at(drop, np.minimum(s + lines_of, len(parts)), -1)
                drop = np.cumsum(drop)[:-1] > 0
                lines.append(len(parts))
                gone.append(int(drop.sum()))
                runs.append(int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum()))
                kept.append("\n".join(p for p, d in zip(parts, drop, strict=True) if not d) if drop.any() else text)
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name not in ("text", "starts", "lone")]
            names = [name for name in batch.schema.names if name not in ("text", "starts", "lone")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], [*names, "text", "n_lines", "n_removed", "n_runs"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: LineOptions = LineOptions()) -> DataFrame:
    """(key, text, n_lines, n_removed, n_runs): each document without the lines of runs that occur earlier.

    key is a struct of all other columns of the input, whatever their names. A
    run of at least min_run lines, or a line of at least long_line words, that also occurs earlier (in the order of id and
    line number; in the same document too, overlaps counted) goes; n_removed lines
    in n_runs maximal runs. A text of which all lines go becomes empty. Null texts
    stay null with 0 lines. Rows with the same id and text are one document for
    the search and each keep their row; null ids come first in the order. Texts of any length are taken
    whole; a task holds one document's lines at a time.
    """
    found = repeated_lines(docs, id_col, text_col, options)
    others = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row_key"), F.struct(*others).alias("key"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(found, "row_key", "left").select("key", "text", "starts", "lone")
    kind = joined.schema["key"].dataType.simpleString()
    return joined.mapInArrow(_cut(options.min_run), f"key {kind}, text string, n_lines long, n_removed long, n_runs long")
