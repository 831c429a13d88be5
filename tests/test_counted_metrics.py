"""Metrics of location classes: rows are counted before they are repeated, and counts weigh as rows do."""

import math
import random

import pytest
from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators import curves as C
from splicelake.operators import reporter as R


def rows():
    own = random.Random(8)
    return [(own.randrange(-20, 60), 0, own.choice([1, 4, 30]), own.choice([None, float("nan"), 0.5, -0.5, 1e6]), int(own.random() < 0.4), own.choice([None, 0.1, 0.3, 1e6 + 1e-3]), 0.25) for _ in range(400)]


def test_counts_give_the_metrics_of_repeated_rows(spark):
    df = spark.createDataFrame(rows(), "pos int, estart int, eend int, y double, label int, a double, b double")
    want = R.head_metrics(R.by_region(df), ["location"], "y", "label", ["a", "b"])
    counts = R.region_counts(df, "y", "label", ["a", "b"])
    got = R.counted_metrics(counts, ["location"])
    g, w = ({(r.location, r.head): r for r in d.collect()} for d in (got, want))
    assert set(g) == set(w) and len(g) > 10
    for k in g:
        for c in want.columns:
            x, y = g[k][c], w[k][c]
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (k, c, x, y)


def test_rows_are_counted_by_their_set_of_classes(spark):
    df = spark.createDataFrame([(10, 0, 40, 0.5, 1, 0.1)] * 50, "pos int, estart int, eend int, y double, label int, a double")
    c = R.region_counts(df, "y", "label", ["a"])
    assert c.groupBy("location").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect() and {(r.location, r.n) for r in c.collect()} == {("all", 50), ("exon", 50), ("exon_acc", 50)}


@pytest.mark.parametrize("constant", [0.1, 1e9 + 0.1])
def test_weights_count_as_rows(spark, constant):
    data = [("g", i * 0.1, i * i * 0.3, 1 + i % 3) for i in range(9)] + [("c", constant, i * 0.1, 7) for i in range(5)]
    d = spark.createDataFrame(data, "k string, t double, p double, w long")
    flat = d.select("k", "t", "p", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int"))))
    got, want = ({r.k: r for r in C.regression_metrics(x, ["k"], "t", "p", **kw).collect()} for x, kw in ((d, {"weight": "w"}), (flat, {})))
    for k, r in want.items():
        for c in ("n", "pearson", "r2", "mse", "mae"):
            assert got[k][c] == r[c] or math.isclose(got[k][c], r[c], rel_tol=1e-9), (k, c)
    assert got["c"].pearson is None and got["c"].r2 is None


def test_locations_of_all_offsets(spark):
    """Names, sites before regions, against the rule written out."""
    d = spark.range(-12, 60).selectExpr("CAST(id AS INT) AS p").crossJoin(spark.createDataFrame([(e,) for e in (0, 1, 2, 3, 5, 8, 30)], "e int"))

    def named(p, e):
        cls = lambda o: "splice_site" if 1 <= o <= 2 else "splice_region" if -2 <= o <= 8 else None
        acc, don = cls(0 - p), cls(p - e)
        body = "exon" if 0 <= p <= e else "intron"
        best = "splice_site" if "splice_site" in (acc, don) else acc or don
        left = abs(p) <= abs(p - e) if body == "exon" else p < 0
        sides = [f"{c}_{s}" for c, s in ((acc, "acc"), (don, "don")) if c] or [f"{body}_{'acc' if left else 'don'}"]
        return ["all", best or body, *sorted(sides, key=lambda x: "site" not in x)]

    for r in d.select("p", "e", S.locations(F.col("p"), F.lit(0), F.col("e")).alias("l")).collect():
        assert r.l == named(r.p, r.e), r


def test_numbers_of_location_sets_give_their_names(spark):
    """Sets are counted by a number: no names are built or hashed for a row."""
    d = spark.range(-12, 60).selectExpr("IF(id = 59, NULL, CAST(id AS INT)) AS p").crossJoin(spark.createDataFrame([(e,) for e in (0, 1, 2, 3, 5, 8, 30, None)], "e int"))
    at = (F.col("p"), F.lit(0), F.col("e"))
    for r in d.select("p", "e", S.locations(*at).alias("want"), S.locations_of(S.location_code(*at)).alias("got")).collect():
        assert r.got == r.want, r


def test_rows_are_counted_by_a_number(spark, monkeypatch):
    seen, inner = [], R.head_counts
    monkeypatch.setattr(R, "head_counts", lambda d, *a: seen.append(dict(d.dtypes)["_set"]) or inner(d, *a))
    df = spark.createDataFrame([(10, 0, 40, 0.5, 1, 0.1)] * 5, "pos int, estart int, eend int, y double, label int, a double")
    assert R.region_counts(df, "y", "label", ["a"]).count() == 3 and seen == ["int"]
