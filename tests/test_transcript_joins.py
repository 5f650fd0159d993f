"""Reads against so many transcripts that a broadcast of them, exploded to bins, would not fit the driver."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals, quant, transcripts


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """(reads, exons): 24,000 transcripts of two exons; reads that are exonic across the junction, twice each, or reach into the intron."""
    path = str(tmp_path_factory.mktemp("many"))
    base = F.col("id") * 1000
    spark.range(24_000).write.parquet(f"{path}/t")
    each = spark.read.parquet(f"{path}/t").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    exons = each.select(F.lit("c").alias("chr"), (base + F.col("i") * 300).alias("start"), (base + F.col("i") * 300 + 100).alias("end"), F.col("id").alias("transcript"))
    block = lambda a, b: F.struct((base + a).alias("start"), (base + b).alias("end"))
    shape = F.when(F.col("id") % 2 == 0, F.array(block(50, 100), block(300, 320))).otherwise(F.array(block(80, 140)))
    reads = spark.read.parquet(f"{path}/t").select(F.col("id").alias("read_id"), F.lit("c").alias("chr"), shape.alias("blocks"))
    return reads.unionAll(reads), exons


def no_broadcast(df):
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    return df


def test_flank_concordance_of_many(many):
    reads, exons = many
    found = no_broadcast(transcripts.flank_concordance(reads, exons.withColumn("gene", F.col("transcript")), distinct=True))
    assert {tuple(r) for r in found.groupBy(F.col("read_id") % 2, "kind").count().collect()} == {(0, 1, 12_000), (1, 8, 12_000)}
    assert found.where("read_id <> transcript").count() == 0


def test_overlap_classes_of_many(many):
    reads, exons = many
    blocks = F.transform("blocks", lambda b, i: F.struct(i.alias("block"), b["start"].alias("start"), b["end"].alias("end"), (i > 0).alias("joined")))
    found = no_broadcast(quant.overlap_classes_of(reads.select("read_id", "chr", F.lit(1).alias("strand"), blocks.alias("blocks")), exons.withColumn("strand", F.lit(1)).withColumn("gene", F.col("transcript"))))
    assert {tuple(r) for r in found.groupBy(F.col("read_id") % 2, "class").count().collect()} == {(0, "exonic", 12_000), (1, "intronic", 12_000)}
    assert found.where("genes <> array(read_id)").count() == 0


def test_concordance_of_many(many):
    found = no_broadcast(transcripts.concordance_reads(*many, distinct=True))
    assert {tuple(r) for r in found.groupBy(F.col("read_id") % 2, "kind").count().collect()} == {(0, "exonic", 12_000), (1, "spanning", 12_000)}


def test_project_of_many(many):
    found = no_broadcast(transcripts.project_reads(*many, distinct=True))
    assert found.count() == found.where("read_id % 2 = 0 and read_id = transcript and t_start = 50 and t_end = 120").count() == 12_000


def test_reads_on_two_chromosomes_are_not_exonic(spark):
    exons = spark.createDataFrame([("c", 0, 100, "t")], "chr string, start long, end long, transcript string")
    blocks = spark.createDataFrame([(1, "c", 10, 20), (1, "d", 10, 20), (2, "c", 10, 20)], "read_id long, chr string, start long, end long")
    assert [r["read_id"] for r in transcripts.project(blocks, exons).collect()] == [2]
    assert {(r["read_id"], r["kind"]) for r in transcripts.concordance(blocks, exons).collect()} == {(1, "spanning"), (2, "exonic")}


def travelling(df):
    """Columns of the reads' side of the join: what is shuffled."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    return [f.split(":", 1) for f in plan.left().schema().simpleString()[7:-1].split(",")]


def test_blocks_travel_as_one_array(many):
    reads, exons = many
    blocks = F.transform("blocks", lambda b, i: F.struct(i.alias("block"), b["start"].alias("start"), b["end"].alias("end"), (i > 0).alias("joined")))
    classes = quant.overlap_classes_of(reads.select("read_id", "chr", F.lit(1).alias("strand"), blocks.alias("blocks")), exons.withColumn("strand", F.lit(1)).withColumn("gene", F.col("transcript")))
    for df in (classes, transcripts.concordance_reads(reads, exons, distinct=True), transcripts.project_reads(reads, exons, distinct=True)):
        assert [kind for _, kind in travelling(df) if "array" in kind] == ["array<bigint>"]
        assert {c for c, _ in travelling(df)} <= {"read_id", "chr", "_str", "_first", "_of"}


@pytest.mark.parametrize("tag", ["int", "boolean", "string"])
def test_within_join_gives_blocks_back(spark, tag):
    rows = [(1, "c", [(5, 9, 1), (20, 30, None)]), (2, "c", [(-300, -290, 0)]), (3, "c", []), (4, "c", None), (5, "d", [(5, 9, 1)]), (6, "c", [(99, 101, 1)])]
    alignments = spark.createDataFrame(rows, "id long, chr string, blocks array<struct<start: long, end: long, tag: int>>").withColumn("blocks", F.col("blocks").cast(f"array<struct<start: long, end: long, tag: {tag}>>"))
    models = spark.createDataFrame([("c", 0, 100, "m"), ("c", -400, 0, "n"), ("c", 5, 30, "o")], "chr string, start long, end long, model string")
    found = intervals.within_join(alignments, models)
    assert found.schema["blocks"].dataType.simpleString() == f"array<struct<start:bigint,end:bigint,tag:{tag}>>"
    assert sorted((r["id"], r["model"]) for r in found.collect()) == [(1, "m"), (1, "o"), (2, "n")]
    outer = intervals.within_join(alignments, models, outer=True)
    assert sorted((r["id"], r["model"] or "") for r in outer.collect()) == [(1, "m"), (1, "o"), (2, "n"), (3, ""), (4, ""), (5, ""), (6, "")]
    given = {r["id"]: r["blocks"] for r in alignments.collect()}
    assert all(r["blocks"] == given[r["id"]] for r in outer.collect())


def test_projection_finds_exons_once_a_pair(many):
    plan = transcripts.project_reads(*many, distinct=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(exons") == 1


def test_few_transcripts_of_many_exons_are_not_broadcast(spark, tmp_path):
    """300 transcripts of 1,000 exons: few rows, but 900,000 exons and more where each transcript stands in its bins."""
    spark.range(300_000).write.parquet(f"{tmp_path}/e")
    base = F.expr("id div 1000 * 100000 + id % 1000 * 100")
    exons = spark.read.parquet(f"{tmp_path}/e").select(F.lit("c").alias("chr"), base.alias("start"), (base + 60).alias("end"), F.expr("id div 1000").alias("transcript"))
    block = F.struct(base.alias("start"), (base + 50).alias("end"))
    reads = spark.read.parquet(f"{tmp_path}/e").where("id % 100 = 7").select(F.col("id").alias("read_id"), F.lit("c").alias("chr"), F.array(block).alias("blocks"))
    for of in (transcripts.concordance_reads, transcripts.project_reads):
        found = no_broadcast(of(reads, exons, distinct=True))
        assert found.count() == found.where("read_id div 1000 = transcript").count() == 3_000
