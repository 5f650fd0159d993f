"""Cell-barcode matching against a whitelist."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import encode, neighbours, unknown_position
from ..options import BarcodeMatch


def whitelist(sequences: DataFrame, column: str = "cb") -> DataFrame:
    """Distinct barcodes without N."""
    return sequences.select(column).where(~F.col(column).contains("N")).distinct()


def exact_counts(reads: DataFrame, barcodes: DataFrame, code: str = "code", pseudocount: int = 0) -> DataFrame:
    """(code, n_exact): reads that equal each barcode, the prior of its correction."""
    counted = reads.join(barcodes.select(code), code).groupBy(code).agg(F.count("*").alias("_n"))
    return barcodes.select(code).join(counted, code, "left").select(code, (F.coalesce("_n", F.lit(0)) + pseudocount).alias("n_exact"))


def one_mismatch(reads: DataFrame, barcodes: DataFrame, bases: int, read: str = "read_id", code: str = "code", quality: str | None = None) -> DataFrame:
    """(read, match, kind, base): an exact barcode, else all barcodes at one mismatch.

    kind is 0 for exact. base is the 0-based place of the mismatch, from the 5' end.
    Neighbours are enumerated and joined by equality: 3 * bases rows for each read
    that has no exact match, never a pair of all.
    """
    known = barcodes.select(F.col(code).alias("match"))
    extra = [quality] if quality else []
    hit = reads.join(known, F.col(code) == F.col("match"), "left")
    exact = hit.where("match is not null").select(read, "match", F.lit(0).alias("kind"), F.lit(-1).alias("base"), *extra)
    spread = F.transform(F.sequence(F.lit(0), F.lit(3 * bases - 1)), lambda i: F.struct(i.alias("i"), F.element_at(neighbours(F.col(code), bases), i + 1).alias("match")))
    near = hit.where("match is null").drop("match").withColumn("_n", F.explode(spread)).select(read, F.col("_n.match").alias("match"), F.lit(1).alias("kind"), (F.lit(bases - 1) - F.expr("_n.i div 3")).cast("int").alias("base"), *extra)
    return exact.unionByName(near.join(known, "match").select(read, "match", "kind", "base", *extra))


def best_match(candidates: DataFrame, priors: DataFrame, options: BarcodeMatch = BarcodeMatch(), read: str = "read_id", quality: str = "quality") -> DataFrame:
    """(read, match, posterior): exact matches, and the candidate whose share of prior * error probability is large enough.

    quality is the phred code of the mismatched base; qualities over the maximum
    count as it. Barcodes without an exact read can't be corrected to unless
    pseudocounts are used.
    """
    joined = candidates.join(priors.withColumnRenamed("code", "match"), "match").withColumn("n_exact", F.col("n_exact") + options.pseudocount)
    q = F.least(F.col(quality) - options.phred, F.lit(options.max_quality)).cast("double")
    weight = F.when(F.col("kind") == 0, 1.0).otherwise(F.col("n_exact") * F.pow(F.lit(10.0), -q / 10))
    usable = joined.where("kind = 0 or n_exact > 0").withColumn("_w", weight)
    w = Window.partitionBy(read)
    ranked = usable.withColumn("posterior", F.col("_w") / F.sum("_w").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_w"), "match")))
    return ranked.where((F.col("_r") == 1) & (F.col("posterior") >= options.min_posterior)).select(read, "match", "posterior")


def unknown_base(reads: DataFrame, barcodes: DataFrame, bases: int, read: str = "read_id", seq: str = "cb", many: bool = False) -> DataFrame:
    """(read, match, kind, base): barcodes that a sequence with one N can stand for; kind 2, base the place of the N.

    Reads whose N fits several barcodes are left out unless ``many``. Sequences without N or with more than one have no rows.
    """
    at = unknown_position(F.col(seq))
    one = reads.where(at >= 0).select(read, seq, at.alias("base"))
    filled = one.withColumn("match", F.explode(F.transform(F.array(*(F.lit(c) for c in "ACGT")), lambda c: encode(F.replace(F.col(seq), F.lit("N"), c)))))
    hit = filled.join(barcodes.select(F.col("code").alias("match")), "match").select(read, "match", F.lit(2).alias("kind"), "base")
    return hit if many else hit.withColumn("_k", F.count("*").over(Window.partitionBy(read))).where("_k = 1").drop("_k")


#: Ways of matching barcodes (fixed values): what is tried, and whether several candidates are weighed against each other.
MATCH_MODES = ("Exact", "1MM", "1MM_multi", "1MM_multi_pseudocounts", "1MM_multi_Nbase_pseudocounts", "EditDist_2")


def match(reads: DataFrame, barcodes: DataFrame, bases: int, mode: str = "1MM_multi", options: BarcodeMatch = BarcodeMatch()) -> DataFrame:
    """(read_id, match) of reads (read_id, cb, qual) in a whitelist (code), in one of MATCH_MODES.

    A read's barcode is matched exactly first; only without such a match by one mismatch, or one N in the place of a base. Where
    several candidates may be weighed, the one with most of prior times error probability wins if its share is large enough.
    """
    if mode not in MATCH_MODES:
        raise ValueError(f"mode must be one of {', '.join(MATCH_MODES)}")
    coded = reads.select("read_id", "cb", "qual", encode(F.col("cb")).alias("code"))
    known = barcodes.select("code").distinct()
    if mode == "EditDist_2":
        near = edited_whitelist(known, bases, indels=True)
        return coded.join(near, F.col("code") == F.col("edited")).select("read_id", "match")
    whole = coded.where("code is not null")
    if mode == "Exact":
        return whole.join(known, "code").select("read_id", F.col("code").alias("match"))
    many = mode != "1MM"
    found = one_mismatch(whole.select("read_id", "code"), known, bases)
    found = found.unionByName(unknown_base(coded, known, bases, many="Nbase" in mode))
    if not many:
        alone = F.count("*").over(Window.partitionBy("read_id"))
        found = found.withColumn("_k", alone).where("_k = 1").drop("_k")
    pseudo = 1 if "pseudocounts" in mode else 0
    exact = exact_counts(whole.select("read_id", "code"), known)
    weighed = found.join(coded.select("read_id", "qual"), "read_id").withColumn("quality", F.ascii(F.substring("qual", F.col("base") + 1, F.lit(1))))
    return best_match(weighed, exact, replace(options, pseudocount=pseudo)).select("read_id", "match")


def _moved(code: Column, bases: int) -> Column:
    """The codes with one base dropped at any place and another put in at any place."""
    low = lambda k: (1 << (2 * k)) - 1
    dropped = [F.shiftleft(F.shiftright(code, 2 * d + 2), 2 * d).bitwiseOR(code.bitwiseAND(F.lit(low(d)).cast("long"))) for d in range(bases)]
    put = [F.shiftleft(F.shiftright(x, 2 * i), 2 * i + 2).bitwiseOR(x.bitwiseAND(F.lit(low(i)).cast("long"))) for x in dropped for i in range(bases)]
    places = F.array(*(F.struct(x.alias("x"), F.lit(2 * i).alias("at")) for x, i in zip(put, [i for _ in range(bases) for i in range(bases)], strict=True)))
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(*(p["x"].bitwiseOR(F.lit(b).cast("long") * F.pow(F.lit(2.0), p["at"]).cast("long")) for b in range(4))))))


def edited_whitelist(barcodes: DataFrame, bases: int, code: str = "code", most: int = 2, indels: bool = False) -> DataFrame:
    """(edited, match, distance): strings within ``most`` mismatches that have one nearest barcode, computed once per whitelist.

    With indels, one base lost and another gained count as distance two.
    """
    level = barcodes.select(F.col(code).alias("edited"), F.col(code).alias("match"), F.lit(0).alias("distance"))
    whole = level
    for d in range(1, most + 1):
        level = level.select(F.explode(neighbours(F.col("edited"), bases)).alias("edited"), "match").distinct().withColumn("distance", F.lit(d))
        whole = whole.unionByName(level)
    if indels and most >= 2:
        whole = whole.unionByName(barcodes.select(F.explode(_moved(F.col(code), bases)).alias("edited"), F.col(code).alias("match"), F.lit(2).alias("distance")))
    w = Window.partitionBy("edited")
    nearest = whole.groupBy("edited", "match").agg(F.min("distance").alias("distance")).withColumn("_low", F.min("distance").over(w)).where("distance = _low")
    return nearest.withColumn("_k", F.count("*").over(w)).where("_k = 1").select("edited", "match", "distance")


def extract(reads: DataFrame, start: int, length: int, name: str, seq: str = "seq", qual: str = "qual", anchor: str | None = None) -> DataFrame:
    """Adds the barcode and its qualities: ``length`` bases from ``start`` (0-based), counted from a column of anchor positions if one is named.

    Null where the read is too short or has no anchor.
    """
    at = F.lit(start) if anchor is None else F.col(anchor) + start
    fits = (at >= 0) & (at + length <= F.length(seq))
    cut = lambda c: F.when(fits, F.substring(F.col(c), (at + 1).cast("int"), F.lit(length)))
    return reads.withColumn(name, cut(seq)).withColumn(f"{name}_qual", cut(qual))


def combined_index(parts: DataFrame, sizes: list[int], columns: list[str]) -> DataFrame:
    """Adds cb, the mixed-radix number of a complex barcode from the numbers of its parts; the first part varies slowest.

    Names of combinations are made for those that occur, never for the whole product.
    """
    number = F.lit(0).cast("long")
    for size, column in zip(sizes, columns, strict=True):
        number = number * size + F.col(column)
    return parts.withColumn("cb", number)


def split_index(cells: DataFrame, sizes: list[int], columns: list[str]) -> DataFrame:
    """The parts' numbers of a combined index."""
    out, rest = cells, F.col("cb")
    for size, column in reversed(list(zip(sizes, columns, strict=True))):
        out = out.withColumn(column, rest % size)
        rest = F.floor(rest / size)
    return out


def by_barcode(records: DataFrame, partitions: int, column: str = "cb") -> DataFrame:
    """Records dealt by barcode and ordered within each part."""
    return records.repartition(partitions, column).sortWithinPartitions(column)


#: Kinds of single-cell reads (fixed values).
READ_KINDS = ("CB_UMI_Simple", "CB_UMI_Complex", "CB_samTagOut", "SmartSeq")


def cell_and_umi(reads: DataFrame, kind: str = "CB_UMI_Simple", cb: tuple[tuple[int, int], ...] = ((0, 16),), umi: tuple[int, int] | None = (16, 10), anchor: str | None = None) -> DataFrame:
    """Adds cb, cb_qual, umi and umi_qual to reads (seq, qual) by a kind of READ_KINDS.

    cb holds the start and length of each part of the barcode, joined by "_" if there are several (Complex), from
    an anchor's position if one is named. SmartSeq reads take the cell from their read_group and have no UMI.
    """
    if kind not in READ_KINDS:
        raise ValueError(f"kind must be one of {', '.join(READ_KINDS)}")
    if kind == "SmartSeq":
        none = F.lit(None).cast("string")
        return reads.withColumn("cb", F.col("read_group")).withColumn("cb_qual", none).withColumn("umi", none).withColumn("umi_qual", none)
    if kind != "CB_UMI_Complex" and len(cb) != 1:
        raise ValueError("only a complex barcode has several parts")
    out, names = reads, []
    for i, (start, length) in enumerate(cb):
        out = extract(out, start, length, f"_cb{i}", anchor=anchor)
        names.append(f"_cb{i}")
    whole = F.forall(F.array(*names), lambda x: x.isNotNull())
    out = out.withColumn("cb", F.when(whole, F.concat_ws("_", *names))).withColumn("cb_qual", F.when(whole, F.concat_ws("_", *(f"{n}_qual" for n in names))))
    out = out.drop(*names, *(f"{n}_qual" for n in names))
    return extract(out, *umi, "umi", anchor=anchor) if umi else out
