"""Small Spark helpers of this subpackage."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Largest side, in bytes as measured, that is broadcast.
BROADCAST_BYTES = 64 << 20


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a temporary one only where it names none and runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandloom-checkpoint-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large table: compressed columns in the shared folder, dropped by discard() or when the program ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/strandloom-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Drops the files of stored tables that nothing needs any more: what was made of them is stored or settled."""
    for x in tables:
        _drop(x.sparkSession, x._stored_at)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 256):
    """Batches of fewer rows, so that what is made of their texts is small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def lowered(text):
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def blanked(text):
    """Every separator as one space, none at the ends."""
    out = F.coalesce(text, F.lit(""))
    for separator in "\t\n\x0b\f\r":
        out = F.replace(out, F.lit(separator), F.lit(" "))
    return F.trim(out)


def word_array(text):
    """The words of a text as an array; empty for null and blank texts."""
    clean = blanked(text)
    parts = F.split(clean, " ")
    return F.when(clean == "", F.array().cast("array<string>")).when(F.contains(clean, F.lit("  ")), F.filter(parts, lambda x: x != "")).otherwise(parts)


def with_word_count(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the number of words of a text, counted by its separators without building the words."""
    clean = F.col("_clean")
    tight = F.when(F.contains(clean, F.lit("  ")), F.regexp_replace(clean, " +", " ")).otherwise(clean)
    spaces = F.octet_length("_tight") - F.octet_length(F.replace("_tight", F.lit(" "), F.lit("")))
    counted = df.withColumn("_clean", blanked(F.col(text_col))).withColumn("_tight", tight)
    return counted.withColumn(out, F.when(F.col("_tight") == "", F.lit(0)).otherwise(spaces + 1).cast("long")).drop("_clean", "_tight")


# --- a membership filter of bounded size ---------------------------------------------------------------------------

_SLICE = 1 << 16  # bytes of the bit array in one row while it is merged
BLOOM_BITS_MOST = 1 << 28


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    x = keys.view(np.uint64) if keys.dtype == np.int64 else keys
    a = x * np.uint64(0x9FB21C651E98DF25)
    a ^= a >> np.uint64(29)
    b = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    b ^= b >> np.uint64(31)
    mask = np.uint64(bits - 1)
    return [((a + np.uint64(i) * b) >> np.uint64(7)) & mask for i in range(3)]


class Bloom:
    """Says of a 64-bit key whether it may be in a set. Never larger than BLOOM_BITS_MOST bits."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], np.int64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for s in _slots(keys, self.bits):
            found &= (self.data[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def bloom(keys: DataFrame, column: str, count: int) -> Bloom:
    """The filter over a column of longs of which about ``count`` differ.

    Bits are set in the tasks and merged slice by slice on the executors, so that
    the driver gets one array of a size fixed in advance: 10 bits a key, and
    BLOOM_BITS_MOST at most (beyond that more keys pass than should; whoever uses
    it drops those by an exact join or comparison).
    """
    bits = min(BLOOM_BITS_MOST, 1 << max(13, math.ceil(math.log2(max(1, count) * 10))))

    def fill(batches):
        data = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for s in _slots(np.ascontiguousarray(keys), bits):
                np.bitwise_or.at(data, (s >> np.uint64(3)).astype(np.int64), np.uint8(1) << (s & np.uint64(7)).astype(np.uint8))
        parts = [(i, data[i : i + _SLICE].tobytes()) for i in range(0, len(data), _SLICE) if data[i : i + _SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([b for _, b in parts], pa.binary())], ["at", "bits"])

    def merge(key, group):
        data = np.frombuffer(group.column("bits")[0].as_py(), np.uint8).copy()
        for part in group.column("bits")[1:]:
            data |= np.frombuffer(part.as_py(), np.uint8)
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([data.tobytes()], pa.binary())})

    made = keys.select(F.col(column).cast("long")).mapInArrow(fill, "at long, bits binary")
    rows = made.groupBy("at").applyInArrow(merge, "at long, bits binary").collect()
    data = np.zeros(bits // 8, np.uint8)
    for row in rows:
        data[row["at"] : row["at"] + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return Bloom(bits, data)
