"""Wall-clock of the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each query runs once to
warm up and then BENCH_RUNS times (default 1); the best time counts. Results are fully produced but not collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from splicelake.plans import QUERIES  # noqa: E402
from splicelake.session import build_session  # noqa: E402

HEADLINE = [
    "read_quality_counts", "site_alpha", "partner_evidence", "site_catalogue", "shifted_unique_sites", "usage_matrix", "wide_usage", "site_statistics", "sample_grid", "read_evidence",
    "gene_read_counts", "sites_per_haplotype", "phased_haplotypes", "intron_gene", "nearest_boundary", "flanking_introns", "overlap_islands", "ranking_metrics_by_head", "top_k_accuracy",
    "regression_by_subset", "spearman_by_sample", "metrics_by_subset", "binned_regression", "ratio_binned_classification", "pooled_metrics", "calibration", "credible_set_statistics",
    "tissue_medians", "tiered_matches", "optimal_matches", "site_tissue_stats", "tissue_specificity", "residuals_by_quantile", "expression_tpm", "size_factors", "transcript_splits",
    "labelled_windows", "variant_windows", "delta_scores", "attribution_spread", "metrics_by_location", "effect_threshold_sweep",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # local files are small: without this the whole of a small shuffle would run in one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    times = {}
    for name in names:
        best = None
        for i in range(runs + 1):
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                best = min(best or 1e9, time.perf_counter() - t)
        times[name] = round(best, 3)
        print(f"{best:8.3f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
