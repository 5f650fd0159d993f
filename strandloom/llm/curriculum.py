"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import settle, store, with_word_count

Schedule = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class MixOptions:
    """weights: of the sources in their order, repeating; share: of all words, how many the mix takes;
    most: times that a document may be taken; schedules: for each of the weights, the knots
    (time, weight) of a line whose integral says how the source's words spread over the training run."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: Fraction = Fraction(3, 2)
    most: int = 2
    schedules: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def _time_of(part: Column, schedule: Schedule) -> Column:
    """The time at which this part of the schedule's integral is reached."""
    area, rows = 0.0, []
    for (t0, v0), (t1, v1) in zip(schedule, schedule[1:], strict=False):
        rows.append((area, t0, v0, (v1 - v0) / (t1 - t0)))
        area += (t1 - t0) * (v0 + v1) / 2
    y, found = part * F.lit(area), None
    for begin, t0, v0, slope in reversed(rows):
        rest = F.greatest(y - F.lit(begin), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(v0 * v0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        at = F.lit(t0) + F.lit(2.0) * rest / F.greatest(F.lit(v0) + root, F.lit(1e-300))
        found = at if found is None else F.when(y < F.lit(rows[rows.index((begin, t0, v0, slope)) + 1][0]), at).otherwise(found)
    return F.least(found, F.lit(1.0))


def source_targets(sizes: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(src, source_size, w, target) from (src, unnamed, source, size): one row per source.

    Water filling in closed form: sources sorted by the level at which they are
    full; the first that is not full at the level which the rest would share
    gives the level of all after it. One row per distinct source goes through one
    task, since the weights follow the rank of the source among all.
    """
    per = sizes.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = per.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*(F.lit(x) for x in options.weights)), (F.col("i") % len(options.weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("w", w).withColumn("cls", (F.col("i") % len(options.weights)).cast("int")).withColumn("cap", F.col("source_size") * options.most)
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "i")
    num, den = options.share.numerator, options.share.denominator
    filled = (
        ranked.withColumn("below", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("all") * num - F.col("below") * den)
        .withColumn("full", F.col("w") * F.col("rest") >= F.col("cap") * F.col("left") * den)
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("c"), "i", "rest", "left"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("level.rest")).cast("double") / (F.col("level.left") * den).cast("double"))
    return filled.select("src", "source_size", "cls", target.alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep_text: bool) -> DataFrame:
    """(key, id, source, src, mark, mix_size): each row packed with its size and its place in the order."""
    kept = [F.col(c) for c in docs.columns if keep_text or c != text_col]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("key"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    mark = F.md5(F.coalesce(F.col("id").cast("string"), F.col("text"), F.lit("")))
    return with_word_count(packed, "text", "mix_size").select("key", "id", "source", src.alias("src"), mark.alias("mark"), "mix_size")


def allocate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", options: MixOptions = MixOptions(), keep_text: bool = True) -> DataFrame:
    """(key, id, mix_size, mix_source_size, mix_target, mix_from, mix_taken, mix_class) of every row: mix_from words of
    the source come before it, mix_taken are taken, repeats counted.

    key is a struct of all columns of the input, whatever their names; without
    keep_text it lacks the text, and texts are read once. Documents of a source
    stand in the order of the MD5 of their id (of the text, where the id is null), then id,
    then size, so the result does not depend on how rows are stored. A source's
    target is taken from its start, going round again at its end, so the words
    taken of a source are exactly its target rounded down; the last document may be
    taken in part. Running sums go by (source, leading digits of the MD5): one
    small table of sums per part, and a window within each part, so that a source
    holding most rows is spread like all others; rows that repeat one id are one part. Null and blank
    texts have size 0 and are taken with 0 words; null sources are one source, the
    last. Repeated rows count as documents of their own; very long texts are rows like others.
    """
    n = docs.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / 2000 + 1, 16)))
    named = _sized(docs, id_col, text_col, source_col, keep_text)
    if not keep_text:
        named = store(named)
    named = named.withColumn("part", F.substring("mark", 1, digits))
    sums = named.groupBy("src", "part").agg(F.first("source").alias("source"), F.sum("mix_size").alias("size"))
    sums = settle(sums)
    targets = source_targets(sums, options)
    before = sums.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = before.join(targets, "src").select("src", "part", "before", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("cls").alias("mix_class"))
    within = Window.partitionBy("src", "part").orderBy("mark", "id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.join(parts, ["src", "part"]).withColumn("mix_from", F.col("before") + F.coalesce(F.sum("mix_size").over(within), F.lit(0)))
    budget = F.floor("mix_target").cast("long")
    taken = sum((_pass_words(budget, p) for p in range(1, options.most)), _pass_words(budget, 0))
    return placed.select("key", "id", "mix_size", "mix_source_size", "mix_target", "mix_from", taken.alias("mix_taken"), "mix_class")


def _pass_words(budget: Column, p: int) -> Column:
    """Words of a document that are taken when its source is gone through for the (p + 1)th time."""
    begin = F.col("mix_from") + F.lit(p) * F.col("mix_source_size")
    return F.greatest(F.least(F.col("mix_size"), budget - begin), F.lit(0)).cast("long")


def _position(begin: Column, options: MixOptions) -> Column:
    part = F.when(F.col("mix_target") > 0, F.least(begin.cast("double") / F.col("mix_target"), F.lit(1.0))).otherwise(F.lit(0.0))
    found = None
    for k, schedule in enumerate(options.schedules):
        at = _time_of(part, schedule)
        found = at if found is None else F.when(F.col("mix_class") == k, at).otherwise(found)
    return found


def with_first_position(allocated: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """Adds mix_position: the time, 0 to 1, at which a document is first due; null if it is not taken."""
    return allocated.withColumn("mix_position", F.when(F.col("mix_taken") > 0, _position(F.col("mix_from"), options)))


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Range-sorted: partitions hold consecutive ranges, each sorted."""
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", options: MixOptions = MixOptions()) -> DataFrame:
    """The mix in training order: the documents' columns, then pass (from 0), words, position.

    A row per time that a document is taken. Its position is the time at which the
    integral of its source's schedule, as a part of the whole, reaches the words of
    the source that come before it; rows are range-sorted by position. Where the
    documents have a column of one of the three names, the new one gets an underscore after its name.
    """
    allocated = allocate(docs, id_col, text_col, source_col, options)
    budget = F.floor("mix_target").cast("long")
    passes = F.array(*(F.struct(F.lit(p).alias("pass"), _pass_words(budget, p).alias("words"), _position(F.col("mix_from") + F.lit(p) * F.col("mix_source_size"), options).alias("position")) for p in range(options.most)))
    rows = allocated.where("mix_taken > 0").withColumn("mix_row", F.explode(F.filter(passes, lambda x: x["words"] > 0)))
    ordered = in_order(rows.select("key", "id", "mix_row", F.col("mix_row.position").alias("position")), "position", "id")
    names = {}
    for name in ("pass", "words", "position"):
        free = name
        while free in docs.columns or free in names.values():
            free += "_"
        names[name] = free
    return ordered.select(*(F.col(f"key.`{c}`") for c in docs.columns), *(F.col(f"mix_row.{name}").alias(free) for name, free in names.items()))
