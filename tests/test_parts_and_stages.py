"""Split parts with their manifest, genotypes by header, stage counts in one job, ordinal ranks, match quality."""

import pytest
from pyspark.sql import functions as F

from splicelake.operators import curves as C
from splicelake.operators import matching as G
from splicelake.operators import windows as W
from splicelake.operators.stages import StageCounts
from splicelake.session import scratch_dir
from splicelake.sources import lines as L


@pytest.fixture
def parts(spark):
    path = scratch_dir(spark, "parts")
    W.write_parts(W.even_parts(spark.range(25).withColumn("v", F.col("id") * 2).repartition(4), "id", 4), path)
    return path


def test_parts_come_back_whole_and_in_order(spark, parts):
    rows = W.combine_parts(spark, parts).orderBy("row_index").collect()
    assert [(r.row_index, r.id, r.v) for r in rows] == [(i, i, 2 * i) for i in range(25)]


def rewritten(spark, parts, keep):
    path = scratch_dir(spark, "parts")
    spark.read.parquet(f"{parts}/rows").filter(keep).write.partitionBy("part").parquet(f"{path}/rows")
    return path


@pytest.mark.parametrize("keep", ["part <> 2", "row_index <> 24", "row_index <> 3"])
def test_missing_rows_are_refused(spark, parts, keep):
    path = rewritten(spark, parts, keep)
    spark.read.parquet(f"{parts}/manifest").write.parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        W.combine_parts(spark, path)


def test_gaps_between_parts_are_refused(spark, parts):
    path = rewritten(spark, parts, "part <> 1")
    spark.read.parquet(f"{parts}/manifest").filter("part <> 1").write.parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="row 6"):
        W.combine_parts(spark, path)


def test_genotypes_follow_header_and_format(spark):
    text = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB", "1\t5\tv\tA\tC,G\t.\t.\t.\tDP:GT\t3:0|1\t4", "1\t6\tw\tA\tC\t.\t.\t.\tDP\t3\t4", "1\t7\tx\tA\tC\t.\t.\t.\tGT\t1/1\t./.\t0/0"]
    got = [(r.pos, r.donor, r.gt) for r in L.parse_genotypes(spark.createDataFrame([(t,) for t in text], "value string")).orderBy("pos", "donor").collect()]
    assert got == [(5, "A", "0|1"), (5, "B", None), (6, "A", None), (6, "B", None), (7, "A", "1/1"), (7, "B", "./.")]


def test_stages_are_counted_by_one_job(spark):
    seen = StageCounts()
    d = seen.watch(spark.range(0, 100, 1, 4), "all", odd=F.col("id") % 2 == 1).filter("id % 2 = 0")
    d = seen.watch(d, "even").filter("id > 1000")
    spark.sparkContext.setJobGroup("stages", "stages")
    seen.watch(d, "none").write.format("noop").mode("overwrite").save()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("stages")
    got = {(r.stage, r.measure): r.n for r in seen.rows(spark).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {("all", "n"): 100, ("all", "odd"): 50, ("even", "n"): 50, ("none", "n"): 0} and len(jobs) == 1


@pytest.mark.parametrize("chunks", [1, 3])
def test_ordinal_ranks_number_ties(spark, chunks):
    rows = [("g", 1.0, 5.0, "b"), ("g", 1.0, 4.0, "a"), ("g", 2.0, 4.0, "c"), ("g", 3.0, None, "d")]
    got = C.ordinal_spearman(spark.createDataFrame(rows, "g string, a double, b double, k string"), ["g"], "a", "b", "k", chunks).collect()
    # a: k=a 1, k=b 2, k=c 3; b: k=a 1, k=c 2, k=b 3
    assert got[0].n == 3 and abs(got[0].spearman - 0.5) < 1e-12


def test_median_of_differences(spark):
    rows = [("t", "n1", "n1", 10, 13), ("t", "n2", "n3", 10, 11), ("u", "n4", "n4", 0, 600), ("u", None, None, 5, None)]
    pairs = spark.createDataFrame(rows, "tissue string, neg_var_key string, neg_var_key_ideal string, pos_dist long, neg_dist long")
    whole = G.match_quality(pairs).collect()
    assert [(r.n, r.n_not_ideal, r.median_diff) for r in whole] == [(3, 1, 3.0)]
    assert {(r.tissue, r.median_diff) for r in G.match_quality(pairs, ["tissue"]).collect()} == {("t", 2.0), ("u", 600.0)}
