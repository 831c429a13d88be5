"""Plan shape of the position joins and grids: equi joins only."""

import pytest

from splicelake.plans import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [
    "intron_gene", "site_gene", "nearest_boundary", "flanking_introns", "sites_per_haplotype", "variants_in_genes", "read_evidence", "gene_read_counts", "sample_grid", "filled_samples", "metrics_by_distance",
    "metrics_by_pip", "effect_labels", "ratio_negatives", "range_fetch", "overlap_islands", "annotation_fill",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_product_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
