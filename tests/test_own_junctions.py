"""Sites made of the reads' own gaps need no lists of competitors, and no list is shuffled for them."""

import random

import pytest
from pyspark.sql import functions as F

from splicelake.operators import evidence as E
from splicelake.operators import usage as U
from splicelake.plans import QUERIES

BY = ["sample", "region"]
READS = "sample string, region string, pos int, flag int, cigar string"


def with_lists(reads):
    """The classes by ``classify``, with the lists of all partners and competitors."""
    d = reads.select(*BY, F.lit(".").alias("strand"), "n_reads", F.inline(E.gaps(F.col("walk")))).withColumnsRenamed({"left": "jleft", "right": "jright", "n_reads": "n"})
    e, key = U.edges(d), [*BY, "strand", "site"]
    pa = e.groupBy(*key).agg(F.array_sort(F.collect_set("partner")).alias("partners"))
    co = U.competitors(e).groupBy(*key).agg(F.collect_set("competitor").alias("competitors"))
    return E.classify(reads, pa.join(co, key, "left").withColumn("competitors", F.coalesce("competitors", F.array().cast("array<int>"))), bin_width=32), e


def rows_of(classes):
    return sorted((r.sample, r.region, r.strand, r.site, r.cls, r.doubled or [], r.n_reads) for r in classes.collect())


def some_reads(own, n, most):
    def cigar():
        parts = [f"{own.choice([1, 2, 5])}M"]
        for _ in range(own.randint(0, most)):
            parts += [f"{own.choice([3, 5, 8, 13])}N"] + [f"{own.choice([1, 2, 4])}{own.choice('MM=D')}"] * (own.random() < 0.9)
        return "".join([*parts, own.choice(["3M", "3M2S", "1I4M"])])

    return [("s", own.choice("ab"), own.randint(1, 25), 0, cigar()) for _ in range(n)] + [("s", "a", 5, 0, None), ("s", "a", 5, 0, "9M")]


@pytest.mark.parametrize("most,masked", [(3, 31), (3, 1), (40, 31)])
def test_own_junctions_give_the_classes_of_lists(spark, monkeypatch, most, masked):
    monkeypatch.setattr(E, "MASKED_GAPS", masked)
    reads = E.collapse_reads(spark.createDataFrame(some_reads(random.Random(most), 60 if most < 9 else 12, most), READS)).localCheckpoint()
    laid, shapes = E.laid_out(reads)
    want, edges = with_lists(E.with_walk(reads))
    got = rows_of(E.classify_own(laid, shapes, bin_width=32))
    assert got == rows_of(want) and {r[4] for r in got} == {"alpha_comp", "flank", "mutex", "beta1_comp", "beta1"}
    cols = ["sample", "region", "site", "partner", "n"]
    assert sorted(E.own_junctions(laid, shapes).select(*cols).collect()) == sorted(edges.select(*cols).collect())


@pytest.mark.parametrize("name", ["read_evidence", "read_double_counts", "strength_with_cryptic"])
def test_queries_need_no_lists(spark, monkeypatch, name):
    monkeypatch.setattr(U, "competitors", None)
    monkeypatch.setattr(E, "competing_reads", None)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 1000
