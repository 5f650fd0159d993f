"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm._spark import store, table
from strandloom.llm.curriculum import curriculum
from strandloom.llm.decontaminate import decontaminate
from strandloom.llm.jaccard_join import drop_near_copies
from strandloom.llm.line_dedup import LineOptions, dedup_lines
from strandloom.llm.quality import keep_quality


#: Rows of an Arrow batch: whole texts travel in them, so that they stay small.
BATCH_ROWS = "1000"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    _small_batches(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines, and lines of 50 words or more, that occur earlier go, and with them documents of which nothing is left; n_chars follows the text."""
    _small_batches(spark)
    cut = dedup_lines(docs, options=LineOptions(long_line=50)).where("n_removed = 0 or text != ''")
    columns = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("key.n_chars"))}
    return cut.select(*(columns.get(c, F.col(f"key.`{c}`")).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id."""
    _small_batches(spark)
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each time that a document is taken, range-sorted by position."""
    return curriculum(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mix),
]

#: SQL can't express the classifier; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; between stages rows are written as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
