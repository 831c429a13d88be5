"""Metrics of heads by group: whole groups in a task, and groups cut into chunks."""

import random

import pytest

from splicelake.operators import reporter as R


def rows():
    own, out = random.Random(5), []
    for g in range(12):
        for _ in range(3 + 7 * g):
            y = own.choice([None, float("nan"), 0.5, -0.5, own.random()])
            out.append((f"e{g}", y if g != 4 else 0.25, int(g != 5 and own.random() < 0.4), own.choice([None, 0.1, -0.1, 0.3]), own.choice([float("nan"), own.random() - 0.5])))
    return out


@pytest.mark.parametrize("empty", [False, True])
def test_whole_groups_give_the_metrics_of_chunks(spark, empty):
    df = spark.createDataFrame([] if empty else rows(), "exon string, y double, label int, a double, b double")
    small, cut = (R.head_metrics(df, ["exon"], "y", "label", ["a", "b"], group_rows=n) for n in (1 << 20, -1))
    assert small.dtypes == cut.dtypes
    got, want = ({(r.exon, r.head): r for r in d.collect()} for d in (small, cut))
    assert set(got) == set(want) and bool(got) != empty
    for k, r in got.items():
        for c in small.columns:
            x, y = r[c], want[k][c]
            assert x == y or abs(x - y) < 1e-9, (k, c, x, y)


def test_small_groups_are_shuffled_once(spark):
    df = spark.createDataFrame(rows(), "exon string, y double, label int, a double, b double")
    plan = R.head_metrics(df, ["exon"], "y", "label", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
