"""Usage across tissues: site statistics, specificity, outliers, variability, residuals and allele differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.operators.curves import regression_metrics
from splicelake.operators.evaluation import medians
from splicelake.operators.ordered import exact_percentiles, lookup

# Specificity group limits, the usage that counts as active, and the shares reported for alleles.
TAU_LOW, TAU_HIGH = 0.1, 0.5
ACTIVE_USAGE = 0.1
ALLELE_CUTS = {"share_001": 0.01, "share_005": 0.05, "share_010": 0.10}


def site_tissue_stats(usage: DataFrame, site: Sequence[str], chunks: int | None = None) -> DataFrame:
    """n, mean, median, sample sd (0 for one row), min and max per site and tissue, with the tissues detected per site."""
    key = [*site, "tissue"]
    d = usage.filter("ssu IS NOT NULL")
    g = d.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("ssu").alias("mean"), F.coalesce(F.stddev_samp("ssu"), F.lit(0.0)).alias("sd"), F.min("ssu").alias("min"), F.max("ssu").alias("max"),
    )
    g = lookup(g, medians(d, key, "ssu", "median", chunks), key)
    nt = g.groupBy(*site).agg(F.count("*").alias("n_tissues"))
    return lookup(g, nt, list(site))


def specificity(stats: DataFrame, site: Sequence[str], min_tissues: int = 2) -> DataFrame:
    """Tau over the tissues where the site is detected, and the spread of the tissue means (one row per tissue and site)."""
    m = stats.select(*site, "tissue", "mean")
    g = m.groupBy(*site).agg(
        F.count("*").alias("n_tissues"), F.max("mean").alias("max_ssu"), F.sum("mean").alias("_s"), F.avg("mean").alias("mean_ssu"),
        F.stddev_pop("mean").alias("sd"), (F.max("mean") - F.min("mean")).alias("range"), F.count_if(F.col("mean") > ACTIVE_USAGE).alias("n_active"),
    ).filter(F.col("n_tissues") >= min_tissues)
    tau = F.when(F.col("max_ssu") > 0, (F.col("n_tissues") - F.col("_s") / F.col("max_ssu")) / (F.col("n_tissues") - 1)).otherwise(0.0)
    return g.withColumn("tau", tau).drop("_s")


def specificity_group(tau: Column) -> Column:
    return F.when(tau <= TAU_LOW, "constitutive").when(tau <= TAU_HIGH, "intermediate").otherwise("tissue-specific")


def tau_bin(tau: Column, n: int = 10) -> Column:
    return F.least(F.floor(tau * n), F.lit(n - 1)).cast("int")


def outlier_tissue(stats: DataFrame, site: Sequence[str], n_tissues: int) -> DataFrame:
    """Farthest tissue from the mean, its direction, and the ratios of first to second at both ends, on complete sites.

    Tissues are few, so the sorted means of a site are a short array.
    """
    item = F.struct("mean", "tissue")
    g = stats.groupBy(*site).agg(
        F.count("*").alias("_n"), F.avg("mean").alias("_m"), F.array_sort(F.collect_list("mean")).alias("_v"),
        F.max_by("tissue", F.struct(F.col("mean"), F.col("tissue"))).alias("max_tissue"), F.min(item)["tissue"].alias("min_tissue"),
    ).filter(F.col("_n") == n_tissues)
    v, k = F.col("_v"), F.size("_v")
    at = lambda i: F.get(v, i)
    top, low = at(k - 1), at(F.lit(0))
    up, down = top - F.col("_m"), F.col("_m") - low
    inc = up >= down
    ratio = lambda a, b: F.when(b > 0, a / b).when(a > 0, F.lit(float("inf")))  # 0 by 0 stays null
    return g.select(
        *site, "max_tissue", "min_tissue", F.when(inc, "inclusion").otherwise("exclusion").alias("direction"),
        F.when(inc, F.col("max_tissue")).otherwise(F.col("min_tissue")).alias("outlier"), ratio(top, at(k - 2)).alias("specificity_ratio"), ratio(at(F.lit(1)), low).alias("depletion_ratio"),
    )


def share_table(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts per (row, column) with the share inside the row, in long form."""
    g = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return lookup(g, g.groupBy(row).agg(F.sum("n").alias("_t")), [row]).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def variability(usage: DataFrame, site: Sequence[str], n_tissues: int) -> DataFrame:
    """Across-tissue mean, variance, sd and range on complete sites, with the mean within-tissue variance."""
    t = usage.filter("ssu IS NOT NULL").groupBy(*site, "tissue").agg(F.avg("ssu").alias("m"), F.var_samp("ssu").alias("v"))
    g = t.groupBy(*site).agg(
        F.count("*").alias("_n"), F.avg("m").alias("mean"), F.var_samp("m").alias("var"), F.stddev_samp("m").alias("sd"), (F.max("m") - F.min("m")).alias("range"), F.avg("v").alias("within_var"),
    )
    return g.filter(F.col("_n") == n_tissues).drop("_n")


def residuals(df: DataFrame, keep: Sequence[str], truth: str, heads: Sequence[str]) -> DataFrame:
    """Absolute errors in long form (keep…, head, abs_resid)."""
    long = df.filter(F.col(truth).isNotNull()).unpivot([*keep, truth], list(heads), "head", "score")
    return long.withColumn("abs_resid", F.abs(F.col("score") - F.col(truth))).drop("score")


def two_level_mean(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """Mean within (outer, inner) first, then over inner: every individual counts the same."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias("mean"), F.count("*").alias("n"))


def allele_differences(df: DataFrame, by: Sequence[str], site: Sequence[str], value: str, chunks: int | None = None) -> DataFrame:
    """Sites with exactly two rows: share of differences above each cut, median and mean."""
    g = df.groupBy(*by, *site).agg(F.count(value).alias("_n"), (F.max(value) - F.min(value)).alias("delta")).filter("_n = 2")
    out = g.groupBy(*by).agg(F.count("*").alias("n_pairs"), *[F.avg((F.col("delta") > c).cast("int")).alias(n) for n, c in ALLELE_CUTS.items()], F.avg("delta").alias("mean_delta"))
    return lookup(out, medians(g, by, "delta", "median_delta", chunks), list(by))


def shared_loss(usage: DataFrame, shared: DataFrame, site: Sequence[str], by: Sequence[str] = ("sample",)) -> DataFrame:
    """Valid and shared site counts per individual with the percentage lost."""
    d = lookup(usage.filter("ssu IS NOT NULL"), shared.select(*site).withColumn("_in", F.lit(1)), list(site), "left")
    g = d.groupBy(*by).agg(F.count("*").alias("n_valid"), F.count("_in").alias("n_shared"))
    return g.withColumn("pct_lost", 100 * (1 - F.col("n_shared") / F.col("n_valid")))


def individual_metrics(df: DataFrame, outer: Sequence[str], inner: Sequence[str], truth: str, pred: str, min_rows: int = 10) -> DataFrame:
    """R², Pearson, MSE and median absolute error of every (outer, inner) group with enough rows, then their means over inner.

    A metric that a group doesn't have (no variance) is left out of its mean.
    """
    key = [*outer, *inner]
    d = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).withColumn("_e", F.abs(F.col(truth) - F.col(pred)))
    m = lookup(regression_metrics(d, key, truth, pred).filter(F.col("n") >= min_rows), exact_percentiles(d, key, "_e", {"median_ae": 0.5}), key)
    return m.groupBy(*outer).agg(F.count("*").alias("n_groups"), *[F.avg(c).alias(c) for c in ("r2", "pearson", "mse", "median_ae")])
