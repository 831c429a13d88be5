"""Measured counts, the grid of sites and samples and the reads over them meet in one sum by position."""

from splicelake.operators import evidence as E
from splicelake.operators import usage as U
from splicelake.plans import QUERIES


def test_sites_of_one_sample_are_filled_in_the_others(spark):
    reads = [("s", "c", 10, 0, "5M20N5M", 3), ("t", "c", 12, 0, "30M", 2), ("t", "c", 9, 0, "4M9N9M", 5), ("u", "d", 10, 0, "5M20N5M", 1)]
    laid, shapes = E.laid_out(spark.createDataFrame(reads, "sample string, region string, pos int, flag int, cigar string, n_reads long"))
    measured = spark.createDataFrame([("s", "c", 14, 3), ("t", "c", 12, 5), ("u", "d", 14, 1)], "sample string, region string, site int, alpha int")
    got = {(r.sample, r.region, r.site): (r.measured, r.alpha, r.beta1, r.beta2, r.sse) for r in E.fill_samples(laid, shapes, measured, laid.select("sample").distinct(), bin_width=8).collect()}
    empty = (False, 0, 0, 0, 0.0)
    want = {("s", "c", 14): (True, 3, 0, 0, 1.0), ("t", "c", 14): (False, 0, 2, 5, 0.0), ("t", "c", 12): (True, 5, 0, 0, 1.0), ("s", "c", 12): (False, 0, 3, 0, 0.0), ("u", "d", 14): (True, 1, 0, 0, 1.0)}
    assert got == want | {k: empty for k in [("u", "c", 14), ("u", "c", 12), ("s", "d", 14), ("t", "d", 14)]}


def test_the_grid_is_joined_with_nothing(spark, monkeypatch):
    for module, name in ((E, "classify"), (E, "lookup"), (U, "lookup"), (U, "sample_grid")):
        monkeypatch.setattr(module, name, None)
    assert QUERIES["filled_samples"](spark, "/root/testdata/sf0.001").count() > 1000
