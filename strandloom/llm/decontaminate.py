"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import BROADCAST_BYTES, lowered, settle, word_array


@dataclass(frozen=True)
class ContainmentOptions:
    """width: words of a shingle; threshold: part of an item's distinct shingles that a document must hold."""

    width: int = 5
    threshold: Fraction = Fraction(3, 4)


def _shingled(rows: DataFrame, id_name: str, text_name: str, width: int) -> DataFrame:
    """A row for each position of a shingle: the id, its hash, and its words as one string (made only where it is used)."""
    words = rows.select(id_name, word_array(lowered(F.col(text_name))).alias("ws")).where(F.size("ws") >= width)
    at = words.select(id_name, "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - width)).alias("i"))
    each = [F.col("ws")[F.col("i") + j] for j in range(width)]
    return at.select(id_name, F.xxhash64(*each).alias("h"), F.concat_ws(" ", *each).alias("shingle"))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", options: ContainmentOptions = ContainmentOptions()) -> DataFrame:
    """(item_id, n_item, h, shingle, sketched, need): the distinct shingles of each item.

    Items are partitioned by size, in powers of two. The MinHash sketch of an item
    holds the floor((1 - t) m) + 1 smallest of its hashes, m being the largest size of
    its partition. A document that holds a part t of the item lacks floor((1 - t) n) of its
    shingles at most, so it holds at least ``need`` of the sketch, the sketch's size less
    that number: one or more, and the search loses nothing.
    """
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    each = _shingled(rows, "item_id", "text", options.width).distinct()
    of_item = Window.partitionBy("item_id")
    each = each.withColumn("n_item", F.count("*").over(of_item)).withColumn("rank", F.row_number().over(of_item.orderBy("h", "shingle")))
    miss = 1 - options.threshold

    def lacking(n):
        return F.floor(n * miss.numerator / miss.denominator)

    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item").cast("double")))).cast("long")
    held = F.least(lacking(largest) + 1, F.col("n_item"))
    return each.select("item_id", "n_item", "h", "shingle", (F.col("rank") <= held).alias("sketched"), (held - lacking(F.col("n_item"))).alias("need"))


def _small(rows: DataFrame, size: int) -> DataFrame:
    """To be broadcast if its measured size allows, else left to a shuffle."""
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def candidates(rows: DataFrame, shingles: DataFrame, options: ContainmentOptions = ContainmentOptions()) -> DataFrame:
    """(d, item_id): pairs of documents, from (d, text), and items of which a document holds ``need`` sketched shingles or more.

    All shingles of all documents are looked up by hash, in the sketches alone.
    """
    sketch = shingles.where("sketched").select("h", "item_id", "need").distinct()
    size = sketch.count() * 48
    # two shingles of an item with one hash are one sketched hash
    found = _shingled(rows, "d", "text", options.width).select("d", "h").join(_small(sketch, size), "h").groupBy("d", "item_id", "need", "h").agg(F.lit(1).alias("one"))
    return found.groupBy("d", "item_id", "need").agg(F.count("*").alias("n")).where("n >= need").select("d", "item_id")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", options: ContainmentOptions = ContainmentOptions()) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment, row_key) of documents that hold a benchmark item.

    containment is the part of the item's distinct word shingles that the document
    holds, n_shared of n_item; rows have at least the threshold. The items' MinHash
    sketches give the candidates; only for these the documents' shingles are compared as text
    with all of the item's, so the count is exact. Documents are read twice, all for
    their hashes and the candidates among them for their words; sketches and candidates are
    broadcast if their measured sizes allow, else shuffled.

    Texts of fewer than ``width`` words, blank or null, hold and are nothing: an item
    that short gives no evidence. Texts are taken whole, however long; a document's shingles are
    rows. Repeated items of one id are one item; rows of
    the same id and text are one document, of the same id and other text another.
    Extra columns are ignored.
    """
    shingles = settle(item_shingles(items, item_col, item_text_col, options))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("row_key")).alias("d"), "text")
    pairs = settle(candidates(rows, shingles, options))
    held = pairs.select("d").distinct()
    few = rows.join(_small(held.select(F.col("d.row_key").alias("k")), held.count() * 32), F.col("d.row_key") == F.col("k"), "left_semi")
    hashes = shingles.select(F.col("h").alias("own_h")).distinct()
    own = _shingled(few, "d", "text", options.width).select(F.col("d.row_key").alias("k"), F.col("h").alias("own_h"), F.col("shingle").alias("own"))
    own = own.join(_small(hashes, hashes.count() * 24), "own_h", "left_semi")
    whole = shingles.select(F.col("item_id").alias("i"), "n_item", "h", "shingle")
    want = pairs.join(whole, F.col("item_id").eqNullSafe(F.col("i"))).select("d", "item_id", "n_item", "h", "shingle")
    found = want.join(own, (F.col("d.row_key") == F.col("k")) & (F.col("h") == F.col("own_h")) & (F.col("own") == F.col("shingle"))).groupBy("d", "item_id", "n_item", "h", "shingle").agg(F.lit(1).alias("one"))
    counted = found.groupBy("d", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    least = f"n_shared * {options.threshold.denominator} >= n_item * {options.threshold.numerator}"
    return counted.where(least).select("d.doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"), "d.row_key")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: ContainmentOptions = ContainmentOptions()) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever their names."""
    bad = settle(contaminated(docs, items, id_col, text_col, options=options).select(F.col("row_key").alias("k")).distinct())
    keyed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("k"))
    return keyed.join(_small(bad, bad.count() * 32), "k", "left_anti").select("row.*")
