"""Matching groups are taken whole by their size, not by the bytes of the input; the cut gives the same."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicelake.operators import matching as M


def tables(spark, scanned):
    d = spark.range(scanned).filter("id < 120 OR id < 0")
    cols = [
        F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("tissue"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("var_key"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("gene_id"), F.when(F.col("id") % 7 != 0, "A").alias("ref"), F.lit("C").alias("alt"),
        (F.col("id") * 37 % 50).alias("splice_dist"), F.when(F.col("id") % 5 != 1, F.lit(1)).alias("bin"), (F.col("id") % 9 / 9).alias("pip"),
    ]
    v = d.select("id", *cols)
    return v.filter("id % 3 = 0").drop("id"), v.filter("id % 3 <> 0").drop("id", "pip")


def test_small_groups_of_a_large_input_are_not_cut(spark):
    plan = M.tiered_matches(*tables(spark, 20_000_000), 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5


def test_groups_beyond_the_limit_are_cut(spark, monkeypatch):
    want = sorted(M.tiered_matches(*tables(spark, 200), 20).collect(), key=str)
    assert len(want) == 40 and {r.tier for r in want} >= {2, 4} and any(r.neg_var_key != r.neg_var_key_ideal for r in want)
    monkeypatch.setattr(M, "GROUP_ROWS", 3)
    assert sorted(M.tiered_matches(*tables(spark, 200), 20).collect(), key=str) == want


@pytest.mark.parametrize("cap", [None, 3, 40])
def test_stretches_cost_what_the_whole_table_costs(cap):
    g = np.random.default_rng(8)
    for n in range(150):
        span = (20, 300, 5000)[n % 3]
        a, b = (np.sort(g.integers(0, span, g.integers(0, 60))).astype(float) for _ in range(2))
        cost = []
        for pairs in (M.line_assignment(a, b, cap), M.table_assignment(a, b, cap)):
            i, j = [p[0] for p in pairs], [p[1] for p in pairs]
            assert len(set(i)) == len(i) and len(set(j)) == len(j) and (cap is None or all(abs(a[x] - b[y]) <= cap for x, y in pairs))
            cost.append((len(pairs), float(np.abs(np.log10(a[i] + 1) - np.log10(b[j] + 1)).sum())))
        assert cost[0][0] == cost[1][0] and cost[0][1] == pytest.approx(cost[1][1], abs=1e-7)


def test_long_lines_do_not_take_the_product_of_the_lists():
    g = np.random.default_rng(9)
    a, b = np.sort(g.random(20_000) * 1e6), np.sort(g.random(120_000) * 1e6)
    start = time.time()
    assert len(M.line_assignment(a, b, 100_000)) == 20_000
    assert time.time() - start < 20  # the table of both lists has 2.4 billion cells
