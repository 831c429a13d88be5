"""Genes meet the sites of their own samples only, and holders need one pass over the filled rows."""

from splicelake.operators import haplotypes as H


def rows(spark):
    return spark.createDataFrame([(f"G{g}", "c", "+", 10 * g, 10 * g + 9, f"S{g % 3}") for g in range(6)], "gene_id string, region string, strand string, gstart int, gend int, sample string")


def usage(spark):
    data = [("c", "+", p, "exon_end" if p % 2 else "exon_start", f"S{s}", None if p % 7 == 0 else p / 100) for p in range(70) for s in range(3)]
    return spark.createDataFrame(data, "region string, strand string, site int, site_type string, sample string, ssu double")


def test_sites_of_other_samples_are_not_paired(spark, monkeypatch):
    seen, join = [], H.points_in_intervals
    monkeypatch.setattr(H, "points_in_intervals", lambda *a, **kw: seen.append(join(*a, **kw)) or seen[-1])
    got = {r.gene_id: r for r in H.attach_sites(rows(spark), usage(spark), 4).collect()}
    assert len(got) == 6 and all(got[f"G{g}"].exon_ends == [p for p in range(10 * g, 10 * g + 10) if p % 2] for g in range(6))
    assert got["G0"].exon_start_ssus[0] == 777.0 and got["G1"].exon_end_ssus[0] == 0.11
    assert [d.count() for d in seen] == [60] and "sample" in seen[0].columns


def test_holders_read_the_filled_rows_once(spark):
    a = spark.createDataFrame([("G0", [1, 99], [8, 98]), ("G1", [11], [500]), ("G2", None, [7]), (None, [5], [6])], "gene_id string, starts array<int>, ends array<int>")
    filled = H.fill_from_annotation(H.attach_sites(rows(spark), usage(spark), 4), a)
    h = H.holder_rows(filled, a)
    assert [tuple(r) for r in h.select("gene_id", "starts", "ends", "uid").collect()] == [("G0", [99], [98], H.HOLDER_ID)]
    plan = h._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(CASE WHEN (site_type") == 2  # one aggregation with its two lists
