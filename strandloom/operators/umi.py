"""Molecule counting: UMI correction, multi-gene UMIs, multi-gene count redistribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import neighbours
from ..options import ExpectationMaximisation
from ._groups import map_groups

CELL_GENE = ["cb", "gene"]


def molecules(records: DataFrame) -> DataFrame:
    """(cb, gene, umi, n): reads per molecule, from one row per read; partial sums per task."""
    return records.groupBy("cb", "gene", "umi").agg(F.count("*").alias("n"))


def count_exact(mols: DataFrame) -> DataFrame:
    """(cb, gene, n_reads, n_umis): no correction. mols has one row per molecule."""
    return mols.groupBy(*CELL_GENE).agg(F.sum("n").alias("n_reads"), F.count("*").alias("n_umis"))


def correct_cr(mols: DataFrame, bases: int) -> DataFrame:
    """Adds ``corrected``: the last, in the order of (count, UMI), of the later UMIs of the cell and gene at one mismatch.

    Not transitive. Neighbours are enumerated and joined by equality, 3 * bases rows per UMI.
    """
    near = mols.select(*CELL_GENE, F.col("umi").alias("_from"), F.col("n").alias("_n"), F.explode(neighbours(F.col("umi"), bases)).alias("umi"))
    later = near.join(mols.select(*CELL_GENE, "umi", "n"), [*CELL_GENE, "umi"]).where("n > _n or (n = _n and umi > _from)")
    best = later.groupBy(*CELL_GENE, F.col("_from").alias("umi")).agg(F.max_by("umi", F.struct("n", "umi")).alias("_to"))
    return mols.join(best, [*CELL_GENE, "umi"], "left").withColumn("corrected", F.coalesce("_to", "umi")).drop("_to")


def _frame(schema_of: pd.DataFrame, corrected: np.ndarray) -> pd.DataFrame:
    return schema_of[[*CELL_GENE, "umi", "n"]].assign(corrected=corrected)


def _out_schema(mols: DataFrame) -> str:
    kinds = dict(mols.select(*CELL_GENE, "umi", "n").dtypes)
    return ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", corrected {kinds['umi']}"


def _runs(frame: pd.DataFrame) -> list[tuple[int, int]]:
    key = frame[CELL_GENE]
    new = np.flatnonzero(np.concatenate(([True], (key.values[1:] != key.values[:-1]).any(axis=1))))
    return list(zip(new, [*new[1:], len(frame)], strict=True))


def correct_all(mols: DataFrame, bases: int) -> DataFrame:
    """Adds ``corrected``: the most frequent UMI (smallest of ties) of the connected component of the one-mismatch graph."""
    steps = [d << (2 * i) for i in range(bases) for d in (1, 2, 3)]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        umis, counts, out = frame["umi"].to_numpy(), frame["n"].to_numpy(), np.empty(len(frame), np.int64)
        for lo, hi in _runs(frame):
            at = {u: i for i, u in enumerate(umis[lo:hi].tolist())}
            root = list(range(hi - lo))

            def find(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for u, i in at.items():
                for s in steps:
                    j = at.get(u ^ s)
                    if j is not None and j > i:
                        root[find(j)] = find(i)
            best: dict[int, tuple[int, int]] = {}
            for u, i in at.items():
                r, mark = find(i), (-int(counts[lo + i]), u)
                best[r] = min(best.get(r, mark), mark)
            out[lo:hi] = [best[find(i)][1] for i in range(hi - lo)]
        return _frame(frame, out)

    return map_groups(mols.select(*CELL_GENE, "umi", "n"), CELL_GENE, solve, _out_schema(mols))


def correct_directional(mols: DataFrame, bases: int, add: int = 0) -> DataFrame:
    """Adds ``corrected``: by falling count, a UMI joins the first earlier one at one mismatch with at least 2 n + add reads.

    What that one was corrected to counts, so chains collapse. Equal counts go by
    UMI. add is -1 for the variant with 2 n - 1.
    """
    steps = [d << (2 * i) for i in range(bases) for d in (1, 2, 3)]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        umis, counts, out = frame["umi"].to_numpy(), frame["n"].to_numpy(), np.empty(len(frame), np.int64)
        for lo, hi in _runs(frame):
            order = np.lexsort((umis[lo:hi], -counts[lo:hi]))
            place = {int(umis[lo + i]): k for k, i in enumerate(order)}
            result: list[int] = []
            for k, i in enumerate(order):
                u, n = int(umis[lo + i]), int(counts[lo + i])
                before = (place.get(u ^ s, k) for s in steps)
                first = min((j for j in before if j < k and counts[lo + order[j]] >= 2 * n + add), default=None)
                result.append(u if first is None else result[first])
                out[lo + i] = result[-1]
        return _frame(frame, out)

    return map_groups(mols.select(*CELL_GENE, "umi", "n"), CELL_GENE, solve, _out_schema(mols))


def count_corrected(corrected: DataFrame) -> DataFrame:
    """(cb, gene, n_umis): distinct corrected UMIs."""
    return corrected.groupBy(*CELL_GENE).agg(F.countDistinct("corrected").alias("n_umis"))


def keep_top_gene(mols: DataFrame) -> DataFrame:
    """Of a UMI seen in several genes of a cell only genes with the most reads stay, none if that is one read."""
    w = Window.partitionBy("cb", "umi")
    marked = mols.withColumn("_genes", F.count("*").over(w)).withColumn("_top", F.max("n").over(w))
    return marked.where("_genes = 1 or (n = _top and _top > 1)").drop("_genes", "_top")


def drop_multi_gene(mols: DataFrame) -> DataFrame:
    """UMIs seen in several genes of a cell go."""
    w = Window.partitionBy("cb", "umi")
    return mols.withColumn("_genes", F.count("*").over(w)).where("_genes = 1").drop("_genes")


def count_cr_multi_gene(corrected: DataFrame) -> DataFrame:
    """(cb, gene, n_umis): after CR correction a UMI counts for its only gene with the most reads,

    if no gene had more reads of that UMI before correction.
    """
    after = corrected.groupBy("cb", "gene", F.col("corrected").alias("umi")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("cb", "umi")
    top = after.withColumn("_top", F.max("n").over(w)).where("n = _top").withColumn("_ties", F.count("*").over(w)).where("_ties = 1").select("cb", "umi", "gene")
    before = corrected.withColumn("_most", F.max("n").over(w)).select("cb", "umi", "gene", F.col("n").alias("_own"), "_most")
    most = before.groupBy("cb", "umi").agg(F.max("_most").alias("_most"))
    own = before.select("cb", "umi", "gene", "_own")
    kept = top.join(most, ["cb", "umi"], "left").join(own, ["cb", "umi", "gene"], "left").where("coalesce(_own, 0) >= coalesce(_most, 0)")
    return kept.groupBy("cb", "gene").agg(F.count("*").alias("n_umis"))


# --- reads that map to several genes ------------------------------------------------------------------------------


def multi_gene_umis(records: DataFrame, unique: DataFrame) -> DataFrame:
    """(cb, umi, gene): for UMIs of multi-gene reads the genes that all their reads share.

    records has a row per (cb, umi, read, gene). UMIs that unique-gene reads of the
    cell also have are skipped.
    """
    fresh = records.join(unique.select("cb", "umi").distinct(), ["cb", "umi"], "left_anti")
    per_gene = fresh.groupBy("cb", "umi", "gene").agg(F.countDistinct("read").alias("_k"))
    reads = fresh.groupBy("cb", "umi").agg(F.countDistinct("read").alias("_n"))
    return per_gene.join(reads, ["cb", "umi"]).where("_k = _n").select("cb", "umi", "gene")


def uniform(umi_genes: DataFrame) -> DataFrame:
    """(cb, gene, value): each UMI spread evenly over its genes."""
    w = Window.partitionBy("cb", "umi")
    return umi_genes.withColumn("_share", F.lit(1.0) / F.count("*").over(w)).groupBy(*CELL_GENE).agg(F.sum("_share").alias("value"))


def _in_proportion(umi_genes: DataFrame, weights: DataFrame, even_if_none: bool) -> DataFrame:
    w = Window.partitionBy("cb", "umi")
    joined = umi_genes.join(weights, CELL_GENE, "left").withColumn("_w", F.coalesce("weight", F.lit(0.0))).withColumn("_sum", F.sum("_w").over(w)).withColumn("_k", F.count("*").over(w))
    none = F.lit(1.0) / F.col("_k") if even_if_none else F.lit(0.0)
    return joined.withColumn("_share", F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum")).otherwise(none)).groupBy(*CELL_GENE).agg(F.sum("_share").alias("value"))


def prop_unique(umi_genes: DataFrame, unique: DataFrame) -> DataFrame:
    """Spread in proportion to the genes' unique counts (cb, gene, n_umis); evenly where they have none."""
    return _in_proportion(umi_genes, unique.select(*CELL_GENE, F.col("n_umis").cast("double").alias("weight")), True)


def rescue(umi_genes: DataFrame, unique: DataFrame) -> DataFrame:
    """Spread in proportion to unique plus evenly spread counts."""
    both = uniform(umi_genes).join(unique, CELL_GENE, "left").select(*CELL_GENE, (F.col("value") + F.coalesce(F.col("n_umis"), F.lit(0))).alias("weight"))
    return _in_proportion(umi_genes, both, False)


def expectation_maximisation(umi_genes: DataFrame, unique: DataFrame, options: ExpectationMaximisation = ExpectationMaximisation()) -> DataFrame:
    """(cb, gene, value): multi-gene counts of each cell by EM, unique counts held; cells are independent groups."""
    rows = umi_genes.join(unique, CELL_GENE, "left").select("cb", "umi", "gene", F.coalesce(F.col("n_umis"), F.lit(0)).cast("double").alias("u"))
    kinds = dict(rows.dtypes)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cb, cell in frame.groupby("cb", sort=False):
            genes, g = np.unique(cell["gene"].to_numpy(), return_inverse=True)
            _, m = np.unique(cell["umi"].to_numpy(), return_inverse=True)
            u = np.zeros(len(genes))
            u[g] = cell["u"].to_numpy()
            old = u + np.bincount(g, 1.0 / np.bincount(m)[m], len(genes))
            for _ in range(options.rounds + 1):
                old = np.where(old < options.floor, 0.0, old)
                total = np.bincount(m, old[g])
                new = u + np.bincount(g, np.divide(old[g], total[m], out=np.zeros(len(g)), where=total[m] > 0), len(genes))
                done = np.abs(new - old).max() < options.change
                old = new
                if done:
                    break
            out.append(pd.DataFrame({"cb": cb, "gene": genes, "value": old - u}))
        return pd.concat(out)

    return map_groups(rows, ["cb"], solve, f"cb {kinds['cb']}, gene {kinds['gene']}, value double")


def merge_matrices(unique: DataFrame, multi: DataFrame) -> DataFrame:
    """(cb, gene, value): unique counts plus redistributed ones, over the genes of either."""
    joined = unique.join(multi, CELL_GENE, "full_outer")
    return joined.select(*CELL_GENE, (F.coalesce(F.col("n_umis").cast("double"), F.lit(0.0)) + F.coalesce("value", F.lit(0.0))).alias("value"))
