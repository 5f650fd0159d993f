"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import settle
from ._text import LOWER, chunks, word_hashes, words

_KINDS = np.zeros((256, 6), dtype=bool)  # upper, lower, digit, closing mark, other ASCII sign, byte of a wider letter
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = (65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _c in ".,;:?", 33 <= _b < 127 and not _c.isalnum() and _c not in ".,;:?", _b >= 128)
_PARTS = ("upper", "digit", "close", "sign", "wide")
FEATURES = ("log_words", "log_word_bytes", "sd_word_bytes", "upper", "digit", "close", "sign", "wide", "distinct", "repeat", "top", "short", "long", "closed", "capital", "lines")


def _logit(part: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The log odds of k of n with half a case added to each side."""
    k = part
    return np.log((k + 0.5) / (np.maximum(n - k, 0) + 0.5))


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Transformed statistics of each document: a row per document, a column per name in FEATURES."""
    docs = len(bounds) - 1
    value, _, _ = word_hashes(data, bounds)
    starts, ends, doc = words(data, bounds)
    n = np.bincount(doc, minlength=docs).astype(float)
    size = (ends - starts).astype(float)
    total = np.bincount(doc, size, docs)
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, size * size, docs) / np.maximum(n, 1) - mean**2, 0))

    def per_doc(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[bounds[1:]] - c[bounds[:-1]]).astype(float)

    kinds = {name: per_doc(_KINDS[:, i][data]) for name, i in zip(("upper", "lower", "digit", "close", "sign", "wide"), range(6), strict=True)}
    lines = per_doc(data == 10) + 1

    def word_part(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=docs).astype(float)

    same = np.zeros(len(value), bool)
    same[1:] = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=docs).astype(float)
    first = np.flatnonzero(new)
    runs = np.diff(np.concatenate((first, [len(v)])))
    top = np.zeros(docs)
    np.maximum.at(top, d[first], runs)
    head = data[starts] if len(starts) else np.empty(0, np.uint8)
    tail = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    capital = (head != LOWER[head]) if len(head) else np.empty(0, bool)
    out = np.stack(
        [
            np.log1p(n), np.log1p(mean), np.log1p(spread),
            *(_logit(kinds[k], total) for k in _PARTS),
            _logit(distinct, n), _logit(word_part(same), n), _logit(top, n), _logit(word_part(size <= 3), n), _logit(word_part(size > 12), n),
            _logit(word_part(_KINDS[:, 3][tail]), n), _logit(word_part(capital), n), np.log(lines / (n + 1)),
        ],
        axis=1,
    )
    return out


@dataclass(frozen=True)
class DiscriminantOptions:
    """shrink: part of each class covariance that is replaced by the pooled one; floor: part of the pooled
    variances added to the diagonal; temper: factor of the log odds, below 1 since statistics of a text depend on each other;
    most_labelled: bound on the labelled rows that are fitted on (smallest hashes of the id)."""

    shrink: float = 0.3
    floor: float = 0.1
    temper: float = 0.5
    most_labelled: int = 200_000


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of two classes, computed once."""

    means: np.ndarray
    roots: np.ndarray
    shift: np.ndarray
    temper: float = field(default=0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        odds = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.roots[k].T
            odds.append(self.shift[k] - 0.5 * (z * z).sum(axis=1))
        return 1.0 / (1.0 + np.exp(-np.clip(self.temper * (odds[1] - odds[0]), -500, 500)))


def fit(count: np.ndarray, total: np.ndarray, product: np.ndarray, options: DiscriminantOptions = DiscriminantOptions()) -> Discriminant:
    """From each class's number, sum and sum of outer products of statistics.

    A class without rows gets the pooled mean and covariance, so that the score is
    then the other class's prior at most.
    """
    size = total.shape[1]
    n = np.maximum(count, 1e-9)
    means = total / n[:, None]
    pooled_mean = total.sum(axis=0) / max(count.sum(), 1)
    pooled = sum(product[k] - count[k] * np.outer(means[k], means[k]) for k in (0, 1)) / max(count.sum() - 2, 1)
    pooled = pooled + np.eye(size) * 1e-6
    roots, shift = np.zeros((2, size, size)), np.zeros(2)
    for k in (0, 1):
        if count[k] < 1:
            means[k] = pooled_mean
        own = (product[k] - count[k] * np.outer(means[k], means[k])) / max(count[k] - 1, 1)
        part = max(options.shrink, min(1.0, 2 * size / (count[k] + 1)))
        cov = (1 - part) * own + part * pooled + options.floor * np.diag(np.diag(pooled))
        low = np.linalg.cholesky((cov + cov.T) / 2)
        roots[k] = np.linalg.inv(low)
        shift[k] = math.log((count[k] + 1) / (count.sum() + 2)) / options.temper - np.log(np.diag(low)).sum()
    return Discriminant(means, roots, shift, options.temper)


def _sums(batches):
    """A task's number, sum and sum of outer products of each class's statistics, from (text, n0, n1)."""
    size = len(FEATURES)
    count, total, product = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
    for batch in batches:
        for lo, hi, data, bounds in chunks(batch.column(0)):
            x = statistics(data, bounds)
            for k in (0, 1):
                times = batch.column(1 + k).slice(lo, hi - lo).to_numpy().astype(float)
                count[k] += times.sum()
                total[k] += times @ x
                product[k] += (x * times[:, None]).T @ x
    if count.any():
        sums = np.concatenate((count, total.ravel(), product.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % _ADDED], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["part", "sums"])


#: Parts in which the tasks' sums are added before the driver gets them.
_ADDED = 64


def _add(rows: list) -> np.ndarray:
    """The sum, rounded once, so that the order of the rows doesn't matter."""
    return np.array([math.fsum(x) for x in np.asarray(rows).T])


def train(labelled: DataFrame, options: DiscriminantOptions = DiscriminantOptions()) -> Discriminant:
    """Fits on (text, n0, n1) rows, n0 and n1 being how often a text is labelled 0 and 1.

    Each task gives sums of a fixed size, which are added on the executors; the driver gets a fixed number of them.
    """
    size = len(FEATURES)

    def add(key, group):
        return pa.table({"sums": pa.array([_add(group.column("sums").to_pylist()).tolist()], pa.list_(pa.float64()))})

    sums = labelled.mapInArrow(_sums, "part long, sums array<double>").groupBy("part").applyInArrow(add, "sums array<double>").collect()
    parts = _add([r["sums"] for r in sums]) if sums else np.zeros(2 + 2 * size + 2 * size * size)
    return fit(parts[:2], parts[2 : 2 + 2 * size].reshape(2, size), parts[2 + 2 * size :].reshape(2, size, size), options)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, options: DiscriminantOptions = DiscriminantOptions(), cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    held_out is crc32(id as text) mod folds = 0; labels of such ids are not used. The
    score is the probability of quality 1, from statistics of the text alone.
    Null and empty texts are scored as texts without words, long ones whole; null ids are never
    learned from and held_out is false. Repeated rows each get their row. Of ids
    labelled twice all rows count; labels other than 0 and 1 don't. About
    most_labelled labelled ids are fitted on at most. Extra columns of either table are ignored.
    """
    model = fitted(docs, labels, id_col, text_col, folds, options)

    def run(batches):
        for batch in batches:
            score = np.concatenate([model.score(statistics(data, bounds)) for _, _, data, bounds in chunks(batch.column(1))] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_held_out("doc_id", folds), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _held_out(name: str, folds: int) -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % folds == 0


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, options: DiscriminantOptions = DiscriminantOptions()) -> Discriminant:
    """The model from the texts of ids that have a (doc_id, quality) label and are not held out.

    Labels are bounded by most_labelled, so they are broadcast, and only labelled texts are measured.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and key is not null").where(~_held_out("key", folds))
    known = settle(known.groupBy("key").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")))
    n = known.count()
    if n > options.most_labelled:
        known = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(int(1_000_000 * options.most_labelled / n)))
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return train(rows.join(F.broadcast(known), "key").select("text", "n0", "n1"), options)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, options: DiscriminantOptions = DiscriminantOptions(), cut: float = 0.3) -> DataFrame:
    """The rows whose text scores at least ``cut``, with all their columns: the labelled are read to learn, all to filter, without a shuffle of texts."""
    model = fitted(docs, labels, id_col, text_col, folds, options)

    def run(batches):
        for batch in batches:
            score = np.concatenate([model.score(statistics(data, bounds)) for _, _, data, bounds in chunks(batch.column(1))] or [np.empty(0)])
            yield batch.filter(pa.array(score >= cut))

    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(c) for c in docs.columns if c != text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    kept = rows.mapInArrow(run, rows.schema)
    return kept.select(*(F.col("text").alias(c) if c == text_col else F.col(f"key.`{c}`") for c in docs.columns))
