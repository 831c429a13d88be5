"""Ranking metrics from threshold curves: one row per (group, score), running counts, sums over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions.stats import correlation
from splicelake.operators.ordered import average_ranks, hash_rank, lookup, running


def curve(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None, chunks: int | None = None) -> DataFrame:
    """Counts per distinct score with cumulative positives/negatives from the highest score down.

    Columns: pos, neg (at the score), tp, fp (at or above it), n_pos, n_neg (whole group). Null and NaN scores are
    left out; ties share a row, so the shuffle carries distinct scores only.
    """
    s = F.col(score).cast("double")
    w = F.lit(1) if weight is None else F.col(weight)
    d = df.filter(s.isNotNull() & ~F.isnan(s))
    g = d.groupBy(*by, s.alias("score")).agg(
        F.sum(F.when(F.col(label) > 0, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) > 0, 0).otherwise(w)).alias("neg")
    )
    c = running(g, by, "score", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, chunks=chunks, totals=True)
    return c.withColumnsRenamed({"tp_total": "n_pos", "fp_total": "n_neg"})


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def summarise(c: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC area, average precision, trapezoid PR area, best F1 and Youden threshold per group."""
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    p, n = F.max("n_pos"), F.max("n_neg")
    tp0, fp0 = tp - pos, fp - neg
    precision = tp / (tp + fp)
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    f1 = 2 * tp / (F.col("n_pos") + tp + fp)
    youden = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), tp / F.col("n_pos") - fp / F.col("n_neg"))
    return c.groupBy(*by).agg(
        p.cast("long").alias("n_pos"), n.cast("long").alias("n_neg"),
        F.when((p > 0) & (n > 0), F.sum(neg * (tp0 + tp) / 2) / (p * n)).alias("auroc"),
        F.when(p > 0, F.sum(pos * precision) / p).alias("avg_precision"),
        F.when(p > 0, F.sum(pos * (precision + before) / 2) / p).alias("pr_area"),
        F.when(p > 0, F.max(f1)).alias("f1_max"),
        F.when((p > 0) & (n > 0), F.max_by("score", F.struct(youden, "score"))).alias("youden_threshold"),
    )


def ranking_metrics(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None, chunks: int | None = None) -> DataFrame:
    return summarise(curve(df, by, score, label, weight, chunks), by)


#: Seed of the hash that orders ties.
TIE_SEED = 0


def top_k(df: DataFrame, by: Sequence[str], keys: Sequence[str], factors: Sequence[float] = (1.0,), score: str = "score", label: str = "label", chunks: int | None = None) -> DataFrame:
    """Hits among the k best rows over min(k, positives), k = floor(factor × positives), and the threshold score.

    Scores above the threshold come from the curve; only the rows tied at the threshold are ranked, by a hash of the whole key, so
    the choice depends neither on partitions nor on the form of the keys, and ties spread over all tasks.
    """
    by = list(by)
    c = curve(df, by, score, label, chunks=chunks)
    fac = F.explode(F.array(*[F.lit(float(f)) for f in factors])).alias("factor")
    c = c.select("*", fac).withColumn("k", F.least(F.floor(F.col("factor") * F.col("n_pos")), F.col("n_pos") + F.col("n_neg")))
    above, at = F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg"), F.col("pos") + F.col("neg")
    edge = c.filter((above < F.col("k")) & (F.col("k") <= above + at)).select(
        *by, "factor", "k", F.col("score").alias("threshold"), (F.col("tp") - F.col("pos")).alias("hits_above"), (F.col("k") - above).alias("need"), F.col("n_pos").alias("_p"),
    )
    wide = edge.select(*by, "factor", F.col("threshold").alias("_s"), "need")
    tied = lookup(df.withColumn("_s", F.col(score).cast("double")), wide.select(*by, "_s").distinct().withColumn("_e", F.lit(1)), [*by, "_s"])
    ranked = hash_rank(tied, [*by, "_s"], keys, TIE_SEED, "_rn")
    ranked = ranked.select(*by, "_s", "_rn", F.col(label).alias("_y"))
    hits = wide.join(ranked, [*by, "_s"]).filter("_rn <= need").groupBy(*by, "factor").agg(F.sum(F.when(F.col("_y") > 0, 1).otherwise(0)).alias("_h"))
    out = lookup(edge, hits, [*by, "factor"], "left")
    total = F.col("hits_above") + F.coalesce("_h", F.lit(0))
    return out.select(*by, "factor", F.col("k").cast("long").alias("k"), total.cast("long").alias("hits"), (total / F.least("k", "_p")).alias("accuracy"), "threshold")


def on_grid(c: DataFrame, by: Sequence[str], grid: int, kind: str) -> DataFrame:
    """Curve values at ``grid`` even points of [0, 1] by linear interpolation: ``roc`` (tpr at fpr) or ``pr`` (precision at recall).

    Each curve row knows its own predecessor from its counts, so every segment expands the grid points inside it on
    its own; no ordering and no join is needed.
    """
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    if kind == "roc":
        x0, x1, y0, y1 = fp0 / F.col("n_neg"), fp / F.col("n_neg"), tp0 / F.col("n_pos"), tp / F.col("n_pos")
    elif kind == "pr":
        x0, x1 = tp0 / F.col("n_pos"), tp / F.col("n_pos")
        y0, y1 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0), tp / (tp + fp)
    else:
        raise ValueError("kind must be roc or pr")
    last = grid - 1
    d = c.filter("n_pos > 0 AND n_neg > 0").select(*by, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    # half-open segments (x0, x1]; the point 0 belongs to the first segment with x0 = 0 < x1
    lo = F.when(F.col("x0") == 0, F.lit(0)).otherwise((F.floor(F.col("x0") * last) + 1))
    hi = F.floor(F.col("x1") * last)
    d = d.filter(F.col("x1") > F.col("x0")).filter(lo <= hi).withColumn("i", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    x = F.col("i") / last
    y = F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return d.select(*by, "i", y.alias("y"))


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str, chunks: int | None = None, weight: str | None = None) -> DataFrame:
    """Spearman correlation with average ranks; repeated (a, b) pairs are counted (or their weights added) first."""
    by = list(by)
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double"))
    n_of = F.sum(weight) if weight else F.count("*")
    g = df.filter(ok).groupBy(*by, a, b).agg(n_of.cast("long").alias("_n"))
    ra = average_ranks(g, by, a, "_ra", count="_n", chunks=chunks).drop("_ra_ties")
    rb = average_ranks(g, by, b, "_rb", count="_n", chunks=chunks).drop("_rb_ties")
    j = lookup(lookup(g, ra, [*by, a]), rb, [*by, b])
    n = F.col("_n")
    m = j.groupBy(*by).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("_ra") * F.col("_ra")).alias("aa"), F.sum(n * F.col("_rb") * F.col("_rb")).alias("bb"),
        F.sum(n * F.col("_ra") * F.col("_rb")).alias("ab"),
    )
    # both rank means are (n + 1) / 2
    mean = (F.col("n") + 1) / 2
    cov, va, vb = F.col("ab") - F.col("n") * mean * mean, F.col("aa") - F.col("n") * mean * mean, F.col("bb") - F.col("n") * mean * mean
    return m.select(*by, F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("spearman"))


def ordinal_spearman(df: DataFrame, by: Sequence[str], a: str, b: str, tie: str, chunks: int | None = None) -> DataFrame:
    """Correlation of ordinal ranks: equal values are numbered one after the other, in the order of ``tie`` (a string per row, such as a hash; unique)."""
    by = list(by)
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranked(d: DataFrame, value: str, out: str) -> DataFrame:
        below = d.groupBy(*by, value).agg(F.count("*").alias("_n"))
        below = running(below, by, value, {"_upto": F.col("_n")}, chunks=chunks).select(*by, value, (F.col("_upto") - F.col("_n")).alias("_below"))
        place = running(d, [*by, value], tie, {"_place": F.lit(1).cast("long")}, chunk_expr=F.substring(tie, 1, 2))
        return lookup(place, below, [*by, value]).withColumn(out, F.col("_below") + F.col("_place")).drop("_below", "_place")

    r = ranked(ranked(d, a, "_ra"), b, "_rb")
    return r.groupBy(*by).agg(F.count("*").alias("n"), correlation("_ra", "_rb").alias("spearman"))


def regression_metrics(df: DataFrame, by: Sequence[str], truth: str, pred: str, weight: str | None = None) -> DataFrame:
    """n, Pearson, R², MSE, MAE over rows where both values are finite: one aggregation, no ordering.

    ``weight`` is the number of rows that a row stands for; sums are then centred on the means of a first aggregation.
    """
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    ok = t.isNotNull() & p.isNotNull() & ~F.isnan(t) & ~F.isnan(p)
    d = df.filter(ok).withColumns({"_t": t, "_p": p})
    err = F.col("_t") - F.col("_p")
    if weight is not None:
        return _weighted_regression(d.select(*by, "_t", "_p", F.col(weight).alias("_n")), list(by))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), correlation("_t", "_p").alias("pearson"),
        F.when(F.var_pop("_t") > 0, 1 - F.sum(err * err) / (F.var_pop("_t") * F.count("*"))).alias("r2"),
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
    )


def _weighted_regression(d: DataFrame, by: list[str]) -> DataFrame:
    n, t, p = F.col("_n"), F.col("_t"), F.col("_p")
    size = F.sum(n)
    means = d.groupBy(*by).agg(
        size.alias("n"), (F.sum(n * t) / size).alias("_mt"), (F.sum(n * p) / size).alias("_mp"), (F.min(t) < F.max(t)).alias("_vt"), (F.min(p) < F.max(p)).alias("_vp"),
        (F.sum(n * (t - p) * (t - p)) / size).alias("mse"), (F.sum(n * F.abs(t - p)) / size).alias("mae"),
    )
    dt, dp = t - F.col("_mt"), p - F.col("_mp")
    c = lookup(d, means.select(*by, "_mt", "_mp"), by).groupBy(*by).agg(F.sum(n * dt * dt).alias("_tt"), F.sum(n * dp * dp).alias("_pp"), F.sum(n * dt * dp).alias("_tp"))
    pearson = F.when(F.col("_vt") & F.col("_vp"), F.col("_tp") / F.sqrt(F.col("_tt") * F.col("_pp")))
    r2 = F.when(F.col("_vt"), 1 - F.col("mse") * F.col("n") / F.col("_tt"))
    return lookup(means, c, by).select(*by, "n", pearson.alias("pearson"), r2.alias("r2"), "mse", "mae")
