import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicelake.operators import curves, ordered


@pytest.fixture(scope="module")
def scores(spark):
    r = random.Random(3)
    # one group holds most rows, scores tie often
    rows = [("hot" if r.random() < 0.7 else f"g{r.randrange(4)}", round(r.random(), 2), int(r.random() < 0.3), i) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, score double, label int, id long").cache()


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_running_is_the_same_in_one_and_many_chunks(scores):
    g = scores.groupBy("g", "score").agg(F.count("*").alias("n"))
    one = ordered.running(g, ["g"], "score", {"c": F.col("n")}, chunks=1, totals=True)
    many = ordered.running(g, ["g"], "score", {"c": F.col("n")}, chunks=7, totals=True)
    cols = ["g", "score", "n", "c", "c_total"]
    assert _rows(one.select(cols)) == _rows(many.select(cols))


@pytest.mark.parametrize("agg", [F.max, F.min])
def test_running_extremes(scores, agg):
    g = scores.groupBy("g", "score").agg(F.max("id").alias("n"))
    a = ordered.running(g, ["g"], "score", {"c": F.col("n")}, chunks=1, agg=agg, descending=True)
    b = ordered.running(g, ["g"], "score", {"c": F.col("n")}, chunks=5, agg=agg, descending=True)
    cols = ["g", "score", "c"]
    assert _rows(a.select(cols)) == _rows(b.select(cols))


def test_percentiles_equal_numpy(scores):
    got = {r.g: (r.q1, r.q2) for r in ordered.exact_percentiles(scores, ["g"], "score", {"q1": 0.25, "q2": 0.9}, chunks=6).collect()}
    pdf = scores.toPandas()
    for g, d in pdf.groupby("g"):
        assert got[g] == pytest.approx(tuple(np.percentile(d.score, [25, 90])))


def test_hash_rank_is_a_permutation_and_repeatable(scores):
    a = ordered.hash_rank(scores, ["g"], ["id"], 5)
    n = {r.g: (r.lo, r.hi, r.n, r.d) for r in a.groupBy("g").agg(F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.count("*").alias("n"), F.count_distinct("rn").alias("d")).collect()}
    assert all(lo == 1 and hi == k == d for lo, hi, k, d in n.values())
    b = ordered.hash_rank(scores.repartition(11), ["g"], ["id"], 5)
    assert _rows(a.select("id", "rn")) == _rows(b.select("id", "rn"))


def test_curve_metrics_by_brute_force(scores):
    got = {r.g: r for r in curves.ranking_metrics(scores, ["g"], chunks=5).collect()}
    for g, d in scores.toPandas().groupby("g"):
        pos, neg = d.score[d.label == 1].to_numpy(), d.score[d.label == 0].to_numpy()
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert got[g].auroc == pytest.approx(wins / (len(pos) * len(neg)))
        ap, best = 0.0, 0.0
        for s in sorted(set(d.score), reverse=True):
            tp, n = (pos >= s).sum(), (d.score >= s).sum()
            ap += (pos == s).sum() / len(pos) * tp / n
            best = max(best, 2 * tp / (len(pos) + n))
        assert got[g].avg_precision == pytest.approx(ap)
        assert got[g].f1_max == pytest.approx(best)


def test_one_class_gives_null(spark):
    d = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 1), ("b", 0.1, 0), ("b", float("nan"), 1)], "g string, score double, label int")
    got = {r.g: r for r in curves.ranking_metrics(d, ["g"]).collect()}
    assert got["a"].auroc is None and got["a"].avg_precision == 1.0
    assert got["b"].auroc is None and got["b"].avg_precision is None


def test_top_k_breaks_ties_by_key(spark):
    d = spark.createDataFrame([("g", 0.9, 1, 1), ("g", 0.5, 0, 2), ("g", 0.5, 1, 3), ("g", 0.5, 1, 4), ("g", 0.1, 0, 5)], "g string, score double, label int, id int")
    r = curves.top_k(d, ["g"], ["id"], chunks=2).collect()[0]
    assert (r.k, r.hits, r.threshold) == (3, 2, 0.5)


def test_constant_groups_have_no_correlation(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0)], "g string, t double, p double")
    got = {r.g: r for r in curves.regression_metrics(d, ["g"], "t", "p").collect()}
    assert got["a"].pearson is None and got["b"].r2 is None and got["b"].mse == 0.0
