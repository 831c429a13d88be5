"""Lines and CIGAR strings are taken apart once."""

from pyspark.sql import functions as F

from splicelake.operators import evidence as E
from splicelake.sources import lines as L


def test_alignment_lines_are_split_once(spark):
    row = "\t".join(["r1", "16", "chr1", "5", "255", "3M", "*", "0", "0", "*", "*"])
    texts = ["@HD\tVN:1.6", "", "short\t1", row, row + "\tNH:i:1\tvW:i:2\tCO:Z:a:b\tbad", row + "\t"]
    got = L.parse_sam(spark.createDataFrame([(t,) for t in texts] + [(None,)], "value string"))
    assert [(r.qname, r.flag, r.pos, r.cigar, r.tags) for r in got.collect()] == [("r1", 16, 5, "3M", t) for t in ({}, {"NH": "1", "vW": "2", "CO": "a:b"}, {})]
    made = spark.range(3).select(F.concat_ws("\t", *[F.col("id").cast("string")] * 11, F.lit("NH:i:1")).alias("value"))
    plan = L.parse_sam(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 1


def test_every_cigar_is_walked_once(spark):
    rows = [(i, "S", "chr1", 10 * i, 0, c) for i, c in enumerate(["3M2N4M", "3M2N4M", "2S5M1I3M", None, "*", "3M2N4M"])]
    reads = spark.createDataFrame(rows, "n_reads long, sample string, region string, pos int, flag int, cigar string")
    assert E.cigar_shapes(reads).count() == 4 - 1
    want = {r.n_reads: r.w for r in reads.select("n_reads", E.cigar_walk(F.col("pos"), F.col("cigar")).alias("w")).collect()}
    assert {r.n_reads: r.walk for r in E.with_walk(reads).collect()} == want


def test_genotypes_are_not_shuffled_by_file(spark):
    head = lambda f, *names: (f, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names]))
    record = lambda f, *cells: (f, "\t".join(["chr1", "5", "v", "A", "C", ".", ".", ".", "DP:GT", *cells]))
    lines = spark.createDataFrame([head("x", "D1", "D2"), record("x", "9:0|1", "9:1|1"), head("y", "D3"), record("y", "9:./.")], "file string, value string")
    got = L.parse_genotypes(lines, "file")
    assert sorted((r.file, r.donor, r.gt) for r in got.collect()) == [("x", "D1", "0|1"), ("x", "D2", "1|1"), ("y", "D3", "./.")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in L.parse_genotypes(lines, "file")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
