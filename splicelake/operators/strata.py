"""Metrics over tissues, thresholds, distances and heads of labelled variant pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.operators.curves import ranking_metrics, spearman
from splicelake.operators.ordered import exact_percentiles, lookup

# Smallest group sizes for a metric.
MIN_PAIRS = 10
WIN_MARGIN = 0.02


def per_tissue(labelled: DataFrame, by: Sequence[str] = ("tissue", "head"), min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Ranking metrics of groups with enough pairs (one positive row per pair)."""
    return ranking_metrics(labelled, by).filter(F.col("n_pos") >= min_pairs)


def tissue_medians(metrics: DataFrame, by: Sequence[str] = ("head",)) -> DataFrame:
    """Median over tissues (as many values as tissues)."""
    m = lambda c: F.percentile(c, F.lit(0.5))
    return metrics.groupBy(*by).agg(
        m("pr_area").alias("median_pr_area"), m("auroc").alias("median_auroc"), m("youden_threshold").alias("median_threshold"), F.count("*").alias("n_tissues"),
    )


def tissue_counts(pairs: DataFrame) -> DataFrame:
    """Distinct positives and negatives per tissue, split into those seen in one or in several tissues."""
    out = None
    for side in ("pos", "neg"):
        k = f"{side}_var_key"
        d = pairs.select("tissue", k).distinct()
        n = d.groupBy(k).agg(F.count("*").alias("_n"))
        g = lookup(d, n, [k]).groupBy("tissue").agg(
            F.count("*").alias(f"n_{side}"), F.count_if(F.col("_n") > 1).alias(f"n_{side}_shared"), F.count_if(F.col("_n") == 1).alias(f"n_{side}_unique"),
        )
        out = g if out is None else lookup(out, g, ["tissue"])
    return out


def cumulative(df: DataFrame, value: Column, thresholds: Sequence[float], out: str = "threshold", at_least: bool = False) -> DataFrame:
    """Repeat a row for every threshold it satisfies (a short fixed list)."""
    lits = F.array(*[F.lit(float(t)) for t in thresholds])
    test = (lambda t: value >= t) if at_least else (lambda t: value <= t)
    return df.withColumn(out, F.explode(F.filter(lits, test)))


def cumulative_metrics(labelled: DataFrame, value: Column, thresholds: Sequence[float], by: Sequence[str] = ("head",), at_least: bool = False, min_pairs: int = MIN_PAIRS) -> DataFrame:
    return per_tissue(cumulative(labelled, value, thresholds, at_least=at_least), [*by, "threshold"], min_pairs)


def independent_cumulative(pairs: DataFrame, scores: DataFrame, distances: DataFrame, thresholds: Sequence[float], min_side: int = MIN_PAIRS) -> DataFrame:
    """Metrics by tissue, head and distance threshold when positives and negatives are cut each by their own distance.

    Every variant of a side counts once per tissue; ``distances`` has var_key and splice_dist. Both sides need ``min_side`` variants.
    """
    side = lambda k, label: pairs.select("tissue", F.col(k).alias("var_key"), F.lit(label).alias("label")).distinct()
    rows = side("pos_var_key", 1).unionByName(side("neg_var_key", 0)).join(scores.filter("score IS NOT NULL").select("var_key", "head", "score"), "var_key")
    rows = rows.join(distances.select("var_key", "splice_dist"), "var_key")
    m = ranking_metrics(cumulative(rows, F.col("splice_dist"), thresholds), ["tissue", "head", "threshold"])
    return m.filter((F.col("n_pos") >= min_side) & (F.col("n_neg") >= min_side))


def tissue_fraction(positives: DataFrame, tested: DataFrame) -> DataFrame:
    """Share of tested tissues in which a variant is positive."""
    p = positives.groupBy("var_key").agg(F.count_distinct("tissue").alias("n_pos_tissues"))
    t = tested.groupBy("var_key").agg(F.count_distinct("tissue").alias("n_tested"))
    return lookup(p, t, ["var_key"]).withColumn("fraction", F.col("n_pos_tissues") / F.col("n_tested"))


def offset_summary(offsets: DataFrame, near: int = 10, chunks: int | None = None) -> DataFrame:
    """Median absolute offset and share within ``near`` bases per head."""
    d = offsets.withColumn("_a", F.abs("offset"))
    med = exact_percentiles(d, ["head"], "_a", {"median_offset": 0.5}, chunks)
    return lookup(d.groupBy("head").agg(F.avg((F.col("_a") <= near).cast("int")).alias("share_near"), F.count("*").alias("n")), med, ["head"])


def offset_bin(offset: Column, edges: Sequence[int] = (1, 10, 100, 1000)) -> Column:
    a = F.abs(offset)
    out = F.when(a < edges[0], 0)
    for i, e in enumerate(edges[1:], 1):
        out = out.when(a < e, i)
    return out.otherwise(len(edges))


def head_pairs(df: DataFrame, key: Sequence[str], value: str, heads: Sequence[str]) -> DataFrame:
    """(key, head_a, head_b, a, b) for every pair of the given heads: one row per key is expanded by the head list."""
    g = df.groupBy(*key).agg(*[F.max(F.when(F.col("head") == h, F.col(value))).alias(f"_v{i}") for i, h in enumerate(heads)])
    pairs = [
        F.struct(F.lit(heads[i]).alias("head_a"), F.lit(heads[j]).alias("head_b"), F.col(f"_v{i}").alias("a"), F.col(f"_v{j}").alias("b"))
        for i in range(len(heads)) for j in range(i + 1, len(heads))
    ]
    return g.select(*key, F.inline(F.array(*pairs))).filter("a IS NOT NULL AND b IS NOT NULL")


def concordance(df: DataFrame, key: Sequence[str], value: str, heads: Sequence[str]) -> DataFrame:
    p = head_pairs(df, key, value, heads)
    by = ["head_a", "head_b"]
    return lookup(p.groupBy(*by).agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("equal_rate"), F.count("*").alias("n")), spearman(p, by, "a", "b"), by)


def matched_head(metrics: DataFrame, matches: Column, metric: str = "pr_area") -> DataFrame:
    """Per tissue: the tissue's own head against the best other head."""
    other = F.when(~matches, F.struct(F.col(metric).alias("v"), F.col("head").alias("h")))
    g = metrics.groupBy("tissue").agg(
        F.max(F.when(matches, F.col(metric))).alias("matched"), F.max(other)["v"].alias("best_other"), F.max(other)["h"].alias("best_head"),
    )
    return g.withColumn("matched_wins", F.col("matched") > F.col("best_other"))


def most_common(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def wins(metrics: DataFrame, metric: str = "pr_area", margin: float = WIN_MARGIN) -> DataFrame:
    """Tissues where a head is within the margin of the best one, and its mean deficit."""
    best = metrics.groupBy("tissue").agg(F.max(metric).alias("_b"))
    d = lookup(metrics, best, ["tissue"]).withColumn("deficit", F.col("_b") - F.col(metric))
    return d.groupBy("head").agg(F.count_if(F.col("deficit") <= margin).alias("n_wins"), F.avg("deficit").alias("mean_deficit"))


def margins(pairs: DataFrame, scores: DataFrame, head_a: str, head_b: str) -> DataFrame:
    """Positive minus negative score per pair for two heads, and which of them ranks the pair right."""
    s = scores.groupBy("var_key").agg(*[F.max(F.when(F.col("head") == h, F.col("score"))).alias(n) for h, n in ((head_a, "_a"), (head_b, "_b"))])
    side = lambda k, p: s.select(F.col("var_key").alias(k), F.col("_a").alias(f"{p}a"), F.col("_b").alias(f"{p}b"))
    j = pairs.join(side("pos_var_key", "p"), "pos_var_key").join(side("neg_var_key", "n"), "neg_var_key")
    j = j.withColumns({"margin_a": F.col("pa") - F.col("na"), "margin_b": F.col("pb") - F.col("nb")}).filter("margin_a IS NOT NULL AND margin_b IS NOT NULL")
    a, b = F.col("margin_a") > 0, F.col("margin_b") > 0
    return j.withColumn("quadrant", F.when(a & b, "both_win").when(a, "a_rescue").when(b, "b_rescue").otherwise("both_fail"))


def threshold_sweep(df: DataFrame, by: Sequence[str], n: int = 50, score: str = "score", label: str = "label", chunks: int | None = None) -> DataFrame:
    """Precision and recall at ``n`` even thresholds between the 5th and 95th percentile.

    Rows are first counted by the number of thresholds they reach, so nothing is repeated per threshold.
    """
    by = list(by)
    e = exact_percentiles(df, by, score, {"lo": 0.05, "hi": 0.95}, chunks)
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    d = lookup(df.filter(F.col(score).isNotNull()), e, by)
    s = F.col(score)
    i = F.when(s < F.col("lo"), 0).when(s >= F.col("hi"), n).otherwise(F.floor((s - F.col("lo")) / step) + 1)
    g = d.groupBy(*by, i.cast("int").alias("i")).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("p"), F.count("*").alias("c"))
    # at most n + 1 rows per group from here on
    g = g.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("i") - 1))) if n > 0 else g
    tot = d.groupBy(*by).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("n_pos"))
    g = g.filter("t >= 0 AND i > 0").groupBy(*by, "t").agg(F.sum("p").alias("tp"), F.sum("c").alias("called"))
    g = lookup(lookup(g, tot, by), e, by)
    return g.select(*by, "t", (F.col("lo") + F.col("t") * step).alias("threshold"), (F.col("tp") / F.col("called")).alias("precision"), F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).alias("recall"))


def best_heads(long_metrics: DataFrame, by: Sequence[str], family: str = "family", value: str = "value", higher: bool = True) -> DataFrame:
    """Best head overall and per model family for every metric row group (ties: smallest head name)."""
    order = F.struct((-F.col(value) if higher else F.col(value)).alias("v"), F.col("head").alias("h"))
    overall = long_metrics.groupBy(*by).agg(F.min_by("head", order).alias("head"), F.min(order)["v"].alias("_v")).withColumn(family, F.lit("all"))
    within = long_metrics.groupBy(*by, family).agg(F.min_by("head", order).alias("head"), F.min(order)["v"].alias("_v"))
    u = overall.select(*by, family, "head", "_v").unionByName(within)
    return u.withColumn("value", -F.col("_v") if higher else F.col("_v")).drop("_v")


def scheme_comparison(a: DataFrame, b: DataFrame, by: Sequence[str] = ("head",)) -> DataFrame:
    """Median PR area of two matching schemes side by side with the difference."""
    l = a.select(*by, F.col("median_pr_area").alias("first_area"))
    r = b.select(*by, F.col("median_pr_area").alias("second_area"))
    return lookup(l, r, list(by)).withColumn("delta", F.col("second_area") - F.col("first_area"))


def unmatched_positives(positives: DataFrame, pairs: DataFrame, negatives: DataFrame) -> DataFrame:
    """Per gene: positives without a pair, and whether the gene has any negative."""
    un = positives.join(pairs.select("tissue", F.col("pos_var_key").alias("var_key")).distinct(), ["tissue", "var_key"], "left_anti")
    g = un.groupBy("gene_id").agg(F.count("*").alias("n_unmatched"))
    has = negatives.select("gene_id").distinct().withColumn("has_negative", F.lit(True))
    return lookup(g, has, ["gene_id"], "left").withColumn("has_negative", F.coalesce("has_negative", F.lit(False)))
