"""Prediction metrics by subset, target, head and bin, and the sampling rules for negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators.curves import ranking_metrics, regression_metrics
from splicelake.operators.ordered import exact_percentiles, hash_rank, lookup

# The pooled negative-to-positive ratio.
NEGATIVES_PER_POSITIVE = 20


def unpivot_heads(df: DataFrame, heads: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keep), list(heads), "head", "score")


def subset_names(ssu: Column, shared: Column | None = None, include_all: bool = True) -> Column:
    """Array of the evaluation subsets a row belongs to; ``ssu`` is null when not measured."""
    valid = ssu.isNotNull()
    nonzero = valid & (ssu > 0)
    names = [F.when(valid, "ssu_valid"), F.when(nonzero, "ssu_valid_nonzero")]
    if include_all:
        names.insert(0, F.lit("all"))
    if shared is not None:
        names += [F.when(shared, "ssu_shared"), F.when(shared & nonzero, "ssu_shared_nonzero")]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def classification_rows(df: DataFrame, heads: Sequence[str], targets: dict[str, str], own: dict[str, str] | None = None, shared: str | None = None) -> DataFrame:
    """(subset, target, head, label, score): positives of the target in the subset against all rows of no target.

    ``targets`` maps target name to its 0/1 column. ``own`` maps a head to the only target it is scored on.
    """
    own = own or {}
    valid = F.col("ssu").isNotNull()
    nonzero = F.coalesce(F.col("ssu") > 0, F.lit(False))
    member = {"all": F.lit(True), "ssu_valid": valid, "ssu_valid_nonzero": nonzero}
    if shared:
        member |= {"ssu_shared": F.col(shared), "ssu_shared_nonzero": F.col(shared) & nonzero}
    neither = sum((F.col(c) for c in targets.values()), F.lit(0)) == 0
    mask = sum((F.when(neither | m, 1 << i).otherwise(0) for i, m in enumerate(member.values())), F.lit(0))
    rows = [
        F.struct(((F.col(c) == 1) | neither).alias("use"), F.lit(t).alias("target"), F.lit(h).alias("head"), F.col(c).alias("label"), F.col(h).cast("double").alias("score"))
        for t, c in targets.items() for h in heads if own.get(h, t) == t
    ]
    x = df.select(mask.alias("mask"), F.inline(F.array(*rows))).filter("use")
    # equal scores are counted first; rows repeat over the fixed subsets only after that
    g = x.groupBy("mask", "target", "head", "label", "score").agg(F.count("*").alias("w"))
    names = F.array(*[F.struct(F.lit(n).alias("subset"), F.lit(1 << i).alias("bit")) for i, n in enumerate(member)])
    g = g.select("mask", "target", "head", "label", "score", "w", F.inline(names)).filter(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    return g.groupBy("subset", "target", "head", "label", "score").agg(F.sum("w").alias("w"))


def classification_metrics(df: DataFrame, heads: Sequence[str], targets: dict[str, str], own: dict[str, str] | None = None, shared: str | None = None) -> DataFrame:
    rows = classification_rows(df, heads, targets, own, shared)
    return ranking_metrics(rows, ["subset", "target", "head"], weight="w")


def site_rows(df: DataFrame, heads: Sequence[str], shared: str | None = None) -> DataFrame:
    """Measured splice sites repeated over regression subsets and heads."""
    d = df.filter("(y_acceptor = 1 OR y_donor = 1) AND ssu IS NOT NULL")
    sh = F.col(shared) if shared else None
    d = d.withColumn("subset", F.explode(subset_names(F.col("ssu"), sh, include_all=False)))
    keep = [c for c in d.columns if c not in heads]
    return d.unpivot(keep, list(heads), "head", "score")


def binned_counts(df: DataFrame) -> DataFrame:
    d = df.filter("ssu IS NOT NULL AND (y_acceptor = 1 OR y_donor = 1)")
    return d.groupBy(S.usage_bin(F.col("ssu")).alias("bin")).agg(F.sum("y_acceptor").alias("n_acc"), F.sum("y_donor").alias("n_don"))


def calibration(df: DataFrame, by: Sequence[str], truth: str, pred: str, bins: int = 20) -> DataFrame:
    b = F.least(F.floor(F.col(pred) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(truth).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.avg(pred).alias("mean_pred"), F.avg(truth).alias("mean_true"), F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    b = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    d = df.filter(F.col(x).between(0, 1) & F.col(y).between(0, 1))
    return d.groupBy(b(x).alias("bx"), b(y).alias("by")).agg(F.count("*").alias("n"))


def quota_by_bin(positives: DataFrame, bins: Sequence[str], n_negatives: Column) -> DataFrame:
    """Negatives per bin: the largest bin takes all, the others keep its ratio (floored)."""
    g = positives.groupBy(*bins).agg(F.count("*").alias("n_pos"))
    return g.withColumn("_n", n_negatives).withColumn("_max", g.agg(F.max("n_pos")).scalar()).select(
        *bins, "n_pos", F.when(F.col("n_pos") == F.col("_max"), F.col("_n")).otherwise(F.floor(F.col("n_pos") * (F.col("_n") / F.col("_max")))).cast("long").alias("quota")
    )


def ratio_negatives(positives: DataFrame, negatives: DataFrame, bin_col: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Negatives labelled with every bin whose quota reaches their place in one seeded shuffle.

    Bins sorted by quota are a short array (one entry per bin), so a negative is expanded, not joined.
    """
    total = negatives.agg(F.count("*").alias("n")).scalar()
    quota = quota_by_bin(positives, [bin_col], total)
    listed = quota.agg(F.array_sort(F.collect_list(F.struct(F.col(bin_col).alias("b"), "quota"))).alias("q")).scalar()
    n = hash_rank(negatives, [], keys, seed, "_rn").withColumn("_q", listed)
    mine = F.filter("_q", lambda q: q["quota"] >= F.col("_rn"))
    return n.select(*negatives.columns, F.explode(F.transform(mine, lambda q: q["b"])).alias(bin_col))


def kept_rows(df: DataFrame, by: Sequence[str], keys: Sequence[str], is_site: Column, always: Column | None = None, per_positive: int = NEGATIVES_PER_POSITIVE, seed: int = 0) -> DataFrame:
    """All sites, all rows under ``always``, and the first ``per_positive`` × sites negatives of a seeded shuffle per group."""
    by = list(by)
    keep = is_site if always is None else is_site | always
    d = df.withColumn("_keep", keep).withColumn("_site", is_site)
    quota = d.groupBy(*by).agg((F.count_if("_site") * per_positive).alias("_quota"))
    neg = lookup(hash_rank(d.filter("NOT _keep"), by, keys, seed, "_rn"), quota, by).filter("_rn <= _quota")
    return d.filter("_keep").select(*df.columns).unionByName(neg.select(*df.columns))


def quantile_edges_bins(df: DataFrame, by: Sequence[str], value: str, n_bins: int, out: str = "bin", chunks: int | None = None) -> DataFrame:
    """Bin index by exact percentile edges of the group (last bin closed on the right)."""
    qs = {f"e{i}": i / n_bins for i in range(n_bins + 1)}
    edges = exact_percentiles(df, by, value, qs, chunks)
    inner = F.array(*[F.col(f"e{i}") for i in range(1, n_bins)])
    edges = edges.select(*by, inner.alias("_edges"))
    j = lookup(df, edges, list(by)) if by else df.withColumn("_edges", edges.scalar())
    return j.withColumn(out, F.size(F.filter("_edges", lambda e: e <= F.col(value))).cast("int")).drop("_edges")


def medians(df: DataFrame, by: Sequence[str], value: str, out: str, chunks: int | None = None) -> DataFrame:
    return exact_percentiles(df, by, value, {out: 0.5}, chunks)


def delta_subsets(df: DataFrame, pop: str, true_delta: str, pred_delta: str, is_site: Column, cut: float = 0.1) -> DataFrame:
    """Usage errors implied by predicted differences, on nested subsets: all, splice, changed, changed_used."""
    d = df.withColumns({"_t": F.col(pop) - F.col(true_delta), "_p": F.col(pop) - F.col(pred_delta)})
    ok, changed = F.col("_t").isNotNull(), F.abs(F.col(true_delta)) > cut
    names = F.filter(F.array(
        F.when(ok, "all"), F.when(ok & is_site, "splice"), F.when(ok & is_site & changed, "changed"),
        F.when(ok & is_site & changed & (F.abs("_t") > 0), "changed_used"),
    ), lambda x: x.isNotNull())
    e = d.withColumn("subset", F.explode(names))
    return lookup(regression_metrics(e, ["subset"], "_t", "_p"), e.groupBy("subset").agg(F.var_pop("_t").alias("variance")), ["subset"])
