"""Cell calling and per-cell statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import EmptyDrops, KneeFilter


def totals(counts: DataFrame, value: str = "n_umis") -> DataFrame:
    """(cb, n, n_genes)."""
    return counts.groupBy("cb").agg(F.sum(value).alias("n"), F.count("*").alias("n_genes"))


def nth_value(values: DataFrame, column: str, rank, descending: bool = True) -> DataFrame:
    """One row (nth): the value at a 0-based rank, which is an expression of n_rows; the last for ranks beyond.

    Ranks come from the histogram of distinct values, a small table, not from a sort of all rows.
    """
    hist = values.groupBy(column).agg(F.count("*").alias("_c"))
    order = F.desc(column) if descending else F.asc(column)
    over = Window.orderBy(order)
    ranked = hist.withColumn("_upto", F.sum("_c").over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_rows", F.sum("_c").over(Window.partitionBy()))
    wanted = F.least(rank, F.col("n_rows") - 1)
    reached = ranked.where(F.col("_upto") > wanted)
    return reached.agg((F.max(column) if descending else F.min(column)).alias("nth"))


def top_cells(cells: DataFrame, n: int) -> DataFrame:
    """Cells with at least the count at rank n (0-based), so ties may give more than n."""
    least = nth_value(cells, "n", F.lit(n)).select(F.greatest("nth", F.lit(1)).alias("_least"))
    return cells.crossJoin(F.broadcast(least)).where("n >= _least").drop("_least")


def knee(cells: DataFrame, options: KneeFilter = KneeFilter()) -> DataFrame:
    """Cells with at least a tenth of the robust maximum."""
    at = math.floor(options.expected * (1.0 - options.percentile) + 0.5)
    least = nth_value(cells, "n", F.lit(at)).select(F.greatest(F.round(F.col("nth") / options.ratio).cast("long"), F.lit(1)).alias("_least"))
    return cells.crossJoin(F.broadcast(least)).where("n >= _least").drop("_least")


def summary(cells: DataFrame) -> DataFrame:
    """n_cells, means by integer division and medians at rank n/2 of called cells."""
    one = cells.agg(F.count("*").alias("n_cells"), F.sum("n").alias("umis"), F.sum("n_genes").alias("genes"))
    half = F.expr("n_rows div 2")
    umi = nth_value(cells, "n", half).withColumnRenamed("nth", "median_umis")
    gene = nth_value(cells, "n_genes", half, descending=False).withColumnRenamed("nth", "median_genes")
    return one.crossJoin(F.broadcast(umi)).crossJoin(F.broadcast(gene)).select("n_cells", "umis", F.expr("umis div n_cells").alias("mean_umis"), "median_umis", F.expr("genes div n_cells").alias("mean_genes"), "median_genes")


def saturation(counts: DataFrame) -> DataFrame:
    """1 - molecules / reads."""
    return counts.agg((F.lit(1.0) - F.sum("n_umis") / F.sum("n_reads")).alias("saturation"))


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds p_adjusted: p * m / rank, made monotone from the largest; ranks over all rows, one row per candidate cell."""
    m = F.count("*").over(Window.partitionBy())
    ranked = tests.withColumn("_r", F.row_number().over(Window.orderBy(p))).withColumn("_a", F.col(p) * m / F.col("_r"))
    back = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_adjusted", F.least(F.min("_a").over(back), F.lit(1.0))).drop("_r", "_a")


def good_turing(counts: np.ndarray) -> np.ndarray:
    """Simple Good-Turing probabilities of observed counts; what is left is the unseen genes' part."""
    r, n = np.unique(counts[counts > 0], return_counts=True)
    if len(r) < 2:
        return counts / max(counts.sum(), 1)
    total = (r * n).sum()
    unseen = n[0] / total if r[0] == 1 else 0.0
    before, after = np.concatenate(([0], r[:-1])), np.concatenate((r[1:], [2 * r[-1] - r[-2]]))
    z = 2.0 * n / (after - before)
    slope, level = np.polyfit(np.log(r), np.log(z), 1)
    smooth = np.exp(level + slope * np.log(r))
    linear = (r + 1) * np.exp(level + slope * np.log(r + 1)) / smooth
    index = {int(v): i for i, v in enumerate(r)}
    stars, turing = np.empty(len(r)), True
    for i, v in enumerate(r):
        j = index.get(int(v) + 1)
        if turing and j is not None:
            x = (v + 1) * n[j] / n[i]
            width = 1.96 * math.sqrt((v + 1.0) ** 2 * n[j] / n[i] ** 2 * (1 + n[j] / n[i]))
            if abs(x - linear[i]) > width:
                stars[i] = x
                continue
        turing = False
        stars[i] = linear[i]
    share = stars * (1 - unseen) / (n * stars).sum()
    out = np.zeros(len(counts))
    seen = counts > 0
    out[seen] = share[np.searchsorted(r, counts[seen])]
    return out


def _ranks_between(cells: DataFrame, low: int, high: int) -> DataFrame:
    """The cells of ranks low (excluded) to high by falling n, then cb; only cells tied with a bound are ranked among each other."""
    hist = cells.groupBy("n").agg(F.count("*").alias("_c"))
    over = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_c").over(over), F.lit(0))).where((F.col("_before") < high) & (F.col("_before") + F.col("_c") > low))
    near = cells.join(F.broadcast(hist), "n")
    whole = (F.col("_before") >= low) & (F.col("_before") + F.col("_c") <= high)
    tied = near.where(~whole).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("n").orderBy("cb"))).where((F.col("_r") > low) & (F.col("_r") <= high))
    return near.where(whole).select(*cells.columns).unionByName(tied.select(*cells.columns))


def empty_drops(counts: DataFrame, options: EmptyDrops = EmptyDrops(), knee_options: KneeFilter = KneeFilter()) -> DataFrame:
    """(cb, n, n_genes, p_adjusted): knee cells, and candidates that differ from the ambient profile.

    Ambient genes come from the cells in the given ranks; each candidate's multinomial
    log probability is compared with simulated cells of its total. A simulation draws one
    cell up to the largest total and is scored at all totals on the way; simulations are dealt to tasks, and each gives a
    count per candidate. At most candidates_max cells are tested, the largest (a parameter of the method). The simulation is
    seeded by its number, so reruns agree; its random numbers are not those of other programs.
    """
    spark = counts.sparkSession
    cells = totals(counts)
    called = knee(cells, knee_options)
    profile = counts.join(_ranks_between(cells, options.ambient_from, options.ambient_to).select("cb"), "cb").groupBy("gene").agg(F.sum("n_umis").alias("c")).toPandas()
    floor = nth_value(called, "n", F.expr("n_rows div 2")).first()["nth"] or 0
    least = max(options.umi_min, int(options.umi_min_over_median * floor))
    if profile.empty:
        return called.withColumn("p_adjusted", F.lit(None).cast("double"))
    tried = _ranks_between(cells.join(called.select("cb"), "cb", "left_anti").where(F.col("n") >= least), 0, options.candidates_max)
    genes = counts.select("gene").distinct().count()
    p = good_turing(profile["c"].to_numpy().astype(np.int64))
    unseen = max(1.0 - p.sum(), 1e-12) / max(genes - len(p), 1)
    table = spark.createDataFrame(pd.DataFrame({"gene": profile["gene"], "lp": np.log(np.maximum(p, 1e-300))}))
    lp = F.coalesce("lp", F.lit(math.log(unseen)))
    log_factorial = F.expr("aggregate(sequence(1, cast(n_umis as int)), cast(0 as double), (a, k) -> a + ln(k))")
    scored = counts.join(tried.select("cb", "n", "n_genes"), "cb").join(F.broadcast(table), "gene", "left").groupBy("cb", "n", "n_genes").agg(F.sum(F.col("n_umis") * lp - log_factorial).alias("score"))
    weights = np.concatenate((p, np.full(max(genes - len(p), 0), unseen)))
    weights /= weights.sum()
    asked = scored.toPandas()  # candidates_max rows at most
    if asked.empty:
        return called.withColumn("p_adjusted", F.lit(None).cast("double"))
    shared = spark.sparkContext.broadcast((np.cumsum(weights), np.log(np.maximum(weights, 1e-300)), asked["n"].to_numpy().astype(np.int64), asked["score"].to_numpy()))

    def simulate(frames):
        edges, logs, at, score = shared.value
        below, size = np.zeros(len(at), np.int64), int(at.max())
        for frame in frames:
            for i in frame["id"]:
                gene = np.minimum(np.searchsorted(edges, np.random.default_rng([options.seed, int(i)]).random(size), side="right"), len(logs) - 1)
                order = np.argsort(gene, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], gene[order][1:] != gene[order][:-1])))
                nth = np.empty(size, np.int64)
                nth[order] = np.arange(size) - np.repeat(first, np.diff(np.concatenate((first, [size])))) + 1
                below += np.cumsum(logs[gene] - np.log(nth))[at - 1] < score
        yield pd.DataFrame({"i": np.arange(len(at)), "below": below})

    counted = spark.range(options.simulations).mapInPandas(simulate, "i long, below long").groupBy("i").agg(F.sum("below").alias("below"))
    numbered = spark.createDataFrame(asked[["cb", "n", "n_genes"]].assign(i=np.arange(len(asked))))
    tested = numbered.join(counted, "i").select(*(F.col(c).cast(k).alias(c) for c, k in dict(scored.dtypes).items() if c != "score"), ((F.lit(1.0) + F.col("below")) / (options.simulations + 1.0)).alias("p"))
    passed = benjamini_hochberg(tested).where(F.col("p_adjusted") <= options.fdr).drop("p")
    return called.withColumn("p_adjusted", F.lit(None).cast("double")).unionByName(passed)


#: Ways of calling cells (fixed values).
CELL_FILTERS = ("None", "TopCells", "CellRanger2.2", "EmptyDrops_CR")


def call_cells(counts: DataFrame, method: str = "CellRanger2.2", top: int = 3000, knee_options: KneeFilter = KneeFilter(), drops: EmptyDrops = EmptyDrops()) -> DataFrame:
    """(cb, n, n_genes) of the cells that a method calls from (cb, gene, n_umis)."""
    if method not in CELL_FILTERS:
        raise ValueError(f"method must be one of {', '.join(CELL_FILTERS)}")
    if method == "EmptyDrops_CR":
        return empty_drops(counts, drops, knee_options).drop("p_adjusted")
    cells = totals(counts)
    return {"None": lambda: cells, "TopCells": lambda: top_cells(cells, top), "CellRanger2.2": lambda: knee(cells, knee_options)}[method]()
