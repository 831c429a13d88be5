"""Threshold sweeps against counting by hand, in one chunk and in many."""

import random

import numpy as np
import pytest

from splicelake.operators import reporter as R


def brute(rows, thresholds):
    out = {}
    for g in {r[0] for r in rows}:
        own = [(abs(s), y) for h, y, s in rows if h == g and s is not None]
        size = np.array([s for s, _ in own])
        for t in thresholds:
            hit = np.array([y is not None and abs(y) > t for _, y in own])
            gain = sum(hit[size >= s].sum() / (size >= s).sum() for s in size[hit])
            out[g, t] = (int(hit.sum()), int((~hit).sum()), gain / hit.sum() if hit.any() else None)
    return out


@pytest.mark.parametrize("chunks", [None, 4])
@pytest.mark.parametrize("slice_rows", [3, 1 << 14])
def test_sweep(spark, monkeypatch, chunks, slice_rows):
    monkeypatch.setattr(R, "SLICE", slice_rows)
    own = random.Random(5)
    rows = [(own.choice(["a", "b", None]), own.choice([None, 0.0, 0.25, -0.5, own.uniform(-1, 1)]), own.choice([None, 0.5, -0.5, own.uniform(-1, 1)])) for _ in range(300)]
    cuts = [0.0, 0.1, 0.25, 0.5, 0.9, 2.0]
    got = R.sweep_metrics(spark.createDataFrame(rows, "head string, y double, score double"), ["head"], "y", "score", cuts, chunks=chunks).collect()
    want = brute(rows, cuts)
    assert len(got) == len(want)
    for r in got:
        n_pos, n_neg, ap = want[r.head, r.threshold]
        assert (r.n_pos, r.n_neg) == (n_pos, n_neg) and (r.avg_precision is None if ap is None else abs(r.avg_precision - ap) < 1e-12)


def test_both_classes_and_no_groups(spark):
    d = spark.createDataFrame([(0.5, 1.0), (0.7, 2.0)], "y double, score double")
    got = {r.threshold: (r.n_pos, r.n_neg, r.avg_precision) for r in R.sweep_metrics(d, [], "y", "score", [0.1, 0.6, 1.0], both_classes=True).collect()}
    assert got == {0.1: (2, 0, None), 0.6: (1, 1, 1.0), 1.0: (0, 2, None)}
