"""The site catalogue needs no summed edges and one shuffle."""

from splicelake.operators import usage as U

JUNCTIONS = [("s", "c", "+", 10, 30, 2), ("s", "c", "+", 10, 30, 5), ("s", "c", "+", 5, 10, 1), ("t", "c", "+", 10, 40, 1), ("u", "c", "+", 20, 30, 1)]


def test_unsummed_edges_give_the_catalogue_in_one_shuffle(spark):
    j = spark.createDataFrame(JUNCTIONS, "sample string, region string, strand string, jleft int, jright int, n long")
    sites = spark.createDataFrame([("s", "c", "+", 10), ("t", "c", "+", 99)], "sample string, region string, strand string, site int")
    cat = U.site_catalogue(sites, U.directions(j))
    assert {r.site: r.site_type for r in cat.collect()} == {5: "exon_end", 10: "exon_end,both", 20: "exon_end", 30: "exon_start", 40: "exon_start", 99: "unknown"}
    assert sorted(cat.collect()) == sorted(U.site_catalogue(sites, U.edges(j)).collect())
    plan = U.site_catalogue(sites, U.directions(j))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
