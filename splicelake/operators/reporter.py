"""Reporter-assay comparisons: labels by effect size, regions, exons, profiles, and significance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators.curves import ranking_metrics, regression_metrics, spearman
from splicelake.operators.evaluation import medians, quantile_edges_bins
from splicelake.operators.ordered import CHUNK, average_ranks, lookup, with_chunks
from splicelake.session import written

# Smallest groups for regions, exons and profile bins.
MIN_ROWS = 5
#: Rows of a group up to which a task takes it whole.
GROUP_ROWS = 1 << 20
#: Scores whose counts a sweep holds at once.
SLICE = 1 << 14

# Cumulative probabilities of a Poisson variable with mean 1 for counts 0–10.
POISSON_ONE = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(11)]


def oligo_exons(oligos: DataFrame) -> DataFrame:
    """Exon coordinates from part lengths, with the two consistency checks."""
    span = F.col("end") - F.col("start")
    e0 = F.col("start") + F.col("intron1_len")
    e1 = e0 + F.col("exon_len") - 1
    return oligos.withColumns({
        "exon_start": e0, "exon_end": e1, "span_ok": span == F.col("intron1_len") + F.col("exon_len") + F.col("intron2_len") - 1, "end_ok": e1 == F.col("end") - F.col("intron2_len"),
    })


def orientation(genome: Column, natural: Column) -> Column:
    from splicelake.functions.sequence import reverse_complement

    g, n = F.upper(genome), F.upper(natural)
    return F.when(g == n, "forward").when(g == reverse_complement(n), "revcomp").otherwise("mismatch")


def strand_from_orientation(orientation_col: Column) -> Column:
    return F.when(orientation_col == "forward", "+").when(orientation_col == "revcomp", "-")


def with_moments(df: DataFrame, value: str) -> DataFrame:
    """Mean and population sd of the whole table on every row, through one scalar subquery."""
    m = df.agg(F.struct(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd")).alias("m")).scalar()
    return df.withColumn("_m", m)


def large_effect(df: DataFrame, value: str, out: str = "label", threshold: float | None = None) -> DataFrame:
    """1 where |value| exceeds one population sd (or a fixed threshold)."""
    if threshold is not None:
        return df.withColumn(out, (F.abs(value) > threshold).cast("int"))
    return with_moments(df, value).withColumn(out, (F.abs(value) > F.col("_m.sd")).cast("int")).drop("_m")


def effect_zone(df: DataFrame, value: str, out: str = "zone") -> DataFrame:
    """increasing, decreasing or neutral by mean ± one sd."""
    d = with_moments(df, value)
    lo, hi = F.col("_m.mu") - F.col("_m.sd"), F.col("_m.mu") + F.col("_m.sd")
    return d.withColumn(out, F.when(F.col(value) > hi, "increasing").when(F.col(value) < lo, "decreasing").otherwise("neutral")).drop("_m")


def head_metrics(df: DataFrame, by: Sequence[str], truth: str, label: str, heads: Sequence[str], min_rows: int = MIN_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pearson, Spearman, R² and average precision of |score| per group and head.

    Where no group has more than ``group_rows`` rows, rows are shuffled once, by group, and a task orders a group at a time. Larger groups
    are counted by distinct values, once, and cut into chunks, one pass an order. The metrics are the same.
    """
    by = list(by)
    largest = df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    if (largest or 0) <= group_rows:
        return _small_groups(df, by, truth, label, heads, min_rows)
    return counted_metrics(head_counts(df, by, truth, label, heads), by, min_rows)


def head_counts(df: DataFrame, by: Sequence[str], truth: str, label: str | None, heads: Sequence[str]) -> DataFrame:
    """Number ``n`` of rows per group, head, truth, class (``label`` > 0) and score, stored for the passes over it."""
    positive = F.lit(False) if label is None else F.coalesce(F.col(label) > 0, F.lit(False))
    d = df.select(*by, F.col(truth).cast("double").alias("truth"), positive.alias("positive"), *[F.col(h).cast("double").alias(h) for h in heads])
    key = [*by, "truth", "positive"]
    return written(d.unpivot(key, list(heads), "head", "score").groupBy(*key, "head", "score").agg(F.count("*").alias("n")), "counts")


def counted_metrics(counts: DataFrame, by: Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """The metrics of ``head_counts`` rows: every pass weights distinct rows by their number."""
    key = [*by, "head"]
    c = counts.withColumnRenamed("n", "_w").withColumns({"_abs": F.abs("score"), "_y": F.col("positive").cast("int")})
    r = regression_metrics(c, key, "truth", "score", weight="_w").filter(F.col("n") >= min_rows)
    ap = ranking_metrics(c, key, "_abs", "_y", weight="_w").select(*key, "n_pos", "avg_precision", "auroc")
    return lookup(lookup(r, spearman(c, key, "truth", "score", weight="_w"), key), ap, key, "left")


def region_counts(df: DataFrame, truth: str, label: str | None, heads: Sequence[str], pos: str = "pos", start: str = "estart", end: str = "eend") -> DataFrame:
    """``head_counts`` by location class: rows are counted by the set of their classes, and only the counts are repeated over it."""
    sets = df.withColumn("_set", S.location_code(F.col(pos), F.col(start), F.col(end)))
    c = head_counts(sets, ["_set"], truth, label, heads)
    return c.select(F.explode(S.locations_of(F.col("_set"))).alias("location"), "head", "truth", "positive", "score", "n")


def _small_groups(df: DataFrame, by: Sequence[str], truth: str, label: str, heads: Sequence[str], min_rows: int) -> DataFrame:
    by, heads = list(by), list(heads)
    d = df.select(*by, F.col(truth).cast("double").alias("_t"), (F.coalesce(F.col(label), F.lit(0)) > 0).cast("int").alias("_y"), *[F.col(h).cast("double").alias(f"_{i}") for i, h in enumerate(heads)])
    names = ["pearson", "r2", "mse", "mae", "spearman", "n_pos", "avg_precision", "auroc"]
    types = {"n": pa.int64(), "n_pos": pa.int64()}

    def metrics(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        truth, label, out = column("_t"), column("_y"), []
        for i, h in enumerate(heads):
            score = column(f"_{i}")
            both = ~np.isnan(truth) & ~np.isnan(score)
            if both.sum() >= min_rows:
                ranked = ~np.isnan(score)
                out.append((h, int(both.sum()), *_agreement(truth[both], score[both]), *_precision(np.abs(score[ranked]), label[ranked])))
        keys = [pa.array([k.as_py()] * len(out), k.type) for k in key]
        cols = zip(*out) if out else [[] for _ in range(len(names) + 2)]
        rest = [pa.array(c, t) for c, t in zip(cols, [pa.string(), *[types.get(c, pa.float64()) for c in ["n", *names]]])]
        return pa.Table.from_arrays([*keys, *rest], names=[*by, "head", "n", *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields]
    fields += ["head string", "n long", *[f"{c} {'long' if c in types else 'double'}" for c in names]]
    return d.groupBy(*by).applyInArrow(metrics, ", ".join(fields))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of equal sorted values, and the place after its last."""
    low = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return low, np.append(low[1:], len(values))


def _mid_ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    low, high = _runs(values[order])
    out = np.empty(len(values))
    out[order] = np.repeat((low + high + 1) / 2, high - low)
    return out


def _correlated(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson correlation; null when either side is constant."""
    if x.min() == x.max() or y.min() == y.max():
        return None
    x, y = x - x.mean(), y - y.mean()
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


@np.errstate(invalid="ignore", divide="ignore")
def _agreement(t: np.ndarray, p: np.ndarray) -> tuple:
    """Pearson, R², MSE, MAE and Spearman of finite pairs."""
    e = t - p
    total = ((t - t.mean()) ** 2).sum()
    r2 = None if t.min() == t.max() else float(1 - (e @ e) / total)
    return _correlated(t, p), r2, float((e @ e) / len(e)), float(np.abs(e).mean()), _correlated(_mid_ranks(t), _mid_ranks(p))


def _precision(size: np.ndarray, label: np.ndarray) -> tuple:
    """Positives, average precision and ROC area from the largest score down; equal scores count together."""
    order = np.argsort(-size, kind="stable")
    low, high = _runs(size[order])
    seen = np.concatenate([[0], np.cumsum(label[order])])
    hits, own = seen[high], seen[high] - seen[low]
    other = (high - low) - own
    n_pos, n_neg = int(own.sum()), int(other.sum())
    ap = float((own * hits / high).sum() / n_pos) if n_pos else None
    return n_pos, ap, float((other * (hits - own / 2)).sum() / (n_pos * n_neg)) if n_pos and n_neg else None


def by_region(df: DataFrame, pos: str = "pos", start: str = "estart", end: str = "eend") -> DataFrame:
    """Repeat rows over the location classes they belong to (at most a handful each)."""
    return df.withColumn("location", F.explode(S.locations(F.col(pos), F.col(start), F.col(end))))


def sweep_metrics(df: DataFrame, by: Sequence[str], value: str, score: str, thresholds: Sequence[float], both_classes: bool = False, chunks: int | None = None, count: str | None = None) -> DataFrame:
    """Average precision and class counts for every effect threshold; a row is positive above the threshold.

    A row counts by the number of thresholds below its effect, so one pass over (|score|, count) serves all of them: chunks of the score
    order carry a column of positives per threshold, and start from the counts of the chunks before. ``both_classes`` leaves the precision
    null where one class is missing; ``count`` weights rows already grouped.
    """
    by, cuts = list(by), sorted(float(t) for t in thresholds)
    # a null effect is above no threshold
    n = F.lit(1) if count is None else F.col(count)
    d = df.filter(F.col(score).isNotNull()).select(*by, F.abs(F.col(score)).cast("double").alias("_s"), _count_below(F.abs(F.col(value)), cuts).alias("_b"), n.cast("long").alias("_n"))
    g, _ = with_chunks(d.groupBy(*by, "_s", "_b").agg(F.sum("_n").alias("_n")), "_s", chunks)
    g = written(g, "sweep")
    per = g.groupBy(*by, CHUNK, "_b").agg(F.sum("_n").alias("_n"))
    higher = Window.partitionBy(*by, "_b").orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    # every count of passed thresholds needs a row in every chunk of its group
    places, counts = per.select(*by, CHUNK).distinct(), per.select(*by, "_b").distinct()
    grid = lookup(places, counts, by) if by else places.crossJoin(counts)
    before = lookup(grid, per, [*by, CHUNK, "_b"], "left").withColumn("_n", F.coalesce(F.sum("_n").over(higher), F.lit(0)))
    rows = g.select(*by, CHUNK, "_s", "_b", "_n").unionByName(before.select(*by, CHUNK, F.lit(float("inf")).alias("_s"), "_b", "_n"))

    size = SLICE

    def gains(table: pa.Table) -> pa.Table:
        s, b, n = (table.column(c).to_numpy() for c in ("_s", "_b", "_n"))
        start = np.bincount(b[np.isinf(s)], n[np.isinf(s)], minlength=len(cuts) + 1)
        own = np.flatnonzero(~np.isinf(s))
        own = own[np.argsort(-s[own], kind="stable")]
        s, b, n = s[own], b[own], n[own]
        place = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]).astype(int) if len(s) else np.zeros(0, int)
        edges = np.searchsorted(place, np.arange(0, (place[-1] if len(s) else 0) + size + 1, size))
        gain, carried = np.zeros(len(cuts)), start.astype(float)
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            counts = np.zeros((place[hi - 1] - place[lo] + 1, len(cuts) + 1))
            np.add.at(counts, (place[lo:hi] - place[lo], b[lo:hi]), n[lo:hi])
            above = np.cumsum(counts, axis=0) + carried
            carried = above[-1]
            positives = lambda c: np.cumsum(c[:, ::-1], axis=1)[:, -2::-1]  # rows above each threshold
            gain += (positives(counts) * positives(above) / above.sum(axis=1, keepdims=True)).sum(axis=0)
        per_row = np.cumsum(np.bincount(b, n, minlength=len(cuts) + 1)[::-1])[::-1]
        keys = {c: pa.array([table.column(c)[0].as_py()] * len(cuts), table.schema.field(c).type) for c in by}
        return pa.table(keys | {"threshold": np.array(cuts), "gain": gain, "n_pos": per_row[1:].astype(np.int64), "n": np.full(len(cuts), int(per_row[0]))})

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields], "threshold double, gain double, n_pos long, n long"])
    m = rows.groupBy(*by, CHUNK).applyInArrow(gains, schema).groupBy(*by, "threshold").agg(F.sum("gain").alias("gain"), F.sum("n_pos").alias("n_pos"), F.sum("n").alias("n"))
    enough = (F.col("n_pos") > 0) & ((F.col("n") > F.col("n_pos")) | F.lit(not both_classes))
    return m.select(*by, "threshold", "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"), F.when(enough, F.col("gain") / F.col("n_pos")).alias("avg_precision"))


def _count_below(x: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts (sorted) below x, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(x > F.lit(cuts[mid]), mid + 1 + _count_below(x, cuts[mid + 1 :])).otherwise(_count_below(x, cuts[:mid]))


def position_profile(df: DataFrame, by: Sequence[str], pos: str, value: str, min_rows: int = MIN_ROWS, chunks: int | None = None) -> DataFrame:
    """Mean and median per position with enough rows."""
    key = [*by, pos]
    g = df.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).filter(F.col("n") >= min_rows)
    return lookup(g, medians(df, key, value, "median", chunks), key)


def disagreement(heads: Sequence[str]) -> Column:
    """Population sd of a row's head scores."""
    k = len(heads)
    mean = sum(F.col(h) for h in heads) / k
    return F.sqrt(sum((F.col(h) - mean) * (F.col(h) - mean) for h in heads) / k)


def percentile_trend(df: DataFrame, x: str, y: str, bins: int, min_rows: int = 3, by: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """Mean and median of y in percentile bins of x; the largest x is outside the last half-open bin."""
    by = list(by)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    top = d.groupBy(*by).agg(F.max(x).alias("_top"))
    b = quantile_edges_bins(d, by, x, bins, "bin", chunks)
    b = (lookup(b, top, by) if by else b.withColumn("_top", top.scalar())).filter(F.col(x) < F.col("_top"))
    key = [*by, "bin"]
    g = b.groupBy(*key).agg(F.count("*").alias("n"), F.avg(y).alias("mean")).filter(F.col("n") >= min_rows)
    return lookup(g, medians(b, key, y, "median", chunks), key)


def group_z(df: DataFrame, by: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(value − mean) / sample sd inside the group; 0 when the sd is 0 or undefined."""
    m = df.groupBy(*by).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    return lookup(df, m, list(by)).withColumn(out, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mu")) / F.col("_sd")).otherwise(0.0)).drop("_mu", "_sd")


def ranked_heads(metrics: DataFrame, by: Sequence[str], metric: str, smaller_is_better: bool = False) -> DataFrame:
    """Ordinal rank of the heads inside each group, best first (as many rows per group as heads)."""
    w = Window.partitionBy(*by).orderBy(F.asc(metric) if smaller_is_better else F.desc(metric), "head")
    return metrics.filter(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(w))


def rank_shares(ranks: DataFrame) -> DataFrame:
    n = F.count("*")
    return ranks.groupBy("head").agg(n.alias("n"), F.avg("rank").alias("mean_rank"), (F.count_if(F.col("rank") == 1) / n).alias("share_first"), (F.count_if(F.col("rank") == 2) / n).alias("share_second"))


def win_matrix(metrics: DataFrame, by: Sequence[str], metric: str, smaller_is_better: bool = False) -> DataFrame:
    """How often one head beats another on the same group; groups hold one row per head. Of errors the smaller one wins."""
    sign = -1 if smaller_is_better else 1
    l = metrics.select(*by, F.col("head").alias("head_a"), F.col(metric).alias("_a"))
    r = metrics.select(*by, F.col("head").alias("head_b"), F.col(metric).alias("_b"))
    j = l.join(r, list(by)).filter("head_a <> head_b")
    return j.groupBy("head_a", "head_b").agg(F.count_if(sign * F.col("_a") > sign * F.col("_b")).alias("wins"), F.count_if(sign * F.col("_a") < sign * F.col("_b")).alias("losses"), F.count("*").alias("n"))


# --- bootstrap ---------------------------------------------------------------------------------------------------


def poisson_weight(seed: int, replicate: int, key: Column) -> Column:
    """Poisson(1) count from a seeded hash: the resampling weight of a row (or cluster) in one replicate.

    One hash serves four replicates, eight hex digits each.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(replicate // 4)), key))
    u = F.conv(F.substring(h, replicate % 4 * 8 + 1, 8), 16, 10).cast("double") / float(1 << 32)
    out = F.lit(0)
    for p in POISSON_ONE:
        out = out + (u >= p).cast("int")
    return out


def bootstrap_compare(metrics: DataFrame, heads: Sequence[str], names: Sequence[str] = ("pearson", "spearman", "r2", "avg_precision")) -> DataFrame:
    """Pairwise differences over replicates: mean, 95 % interval and two-sided p (one row per replicate and head goes in)."""
    long = metrics.unpivot(["replicate", "head"], list(names), "metric", "value")
    g = long.groupBy("replicate", "metric").agg(*[F.max(F.when(F.col("head") == h, F.col("value"))).alias(f"_v{i}") for i, h in enumerate(heads)])
    pairs = [
        F.struct(F.lit(heads[i]).alias("head_a"), F.lit(heads[j]).alias("head_b"), (F.col(f"_v{i}") - F.col(f"_v{j}")).alias("d"))
        for i in range(len(heads)) for j in range(i + 1, len(heads))
    ]
    x = g.select("metric", F.inline(F.array(*pairs))).filter("d IS NOT NULL")
    left = F.avg((F.col("d") <= 0).cast("int"))
    return x.groupBy("head_a", "head_b", "metric").agg(
        F.avg("d").alias("diff_mean"), F.percentile("d", F.lit(0.025)).alias("ci_lo"), F.percentile("d", F.lit(0.975)).alias("ci_hi"), F.least(2 * F.least(left, 1 - left), F.lit(1.0)).alias("p"),
    )


def holm(tests: DataFrame, family: Sequence[str], tie: Sequence[str], p: str = "p", k: int | None = None) -> DataFrame:
    """Holm step-down inside each family (or with an explicit family size), with stars."""
    w = Window.partitionBy(*family).orderBy(p, *tie)
    size = F.lit(k) if k else F.count("*").over(Window.partitionBy(*family))
    raw = F.col(p) * (size - F.row_number().over(w) + 1)
    d = tests.withColumn("_raw", raw)
    adj = F.least(F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return d.withColumn("p_adj", adj).withColumn("stars", S.significance_stars(F.col("p_adj"))).drop("_raw")


def bonferroni(p: Column, k: int) -> Column:
    return F.least(p * k, F.lit(1.0))


# --- rank tests --------------------------------------------------------------------------------------------------


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (rational approximation, absolute error below 2e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def chi_square_tail(x: Column, df: int) -> Column:
    """Upper tail of chi-square with integer degrees of freedom as a finite sum."""
    h = x / 2
    if df % 2 == 0:
        terms = sum((h**i) / math.factorial(i) for i in range(1, df // 2)) if df > 2 else F.lit(0.0)
        return F.exp(-h) * (1 + terms)
    out = erfc(F.sqrt(h))
    for i in range((df - 1) // 2):
        out = out + F.exp(-h) * h ** (i + 0.5) / math.gamma(i + 1.5)
    return out


def rank_sums(df: DataFrame, group: str, value: str, chunks: int | None = None) -> DataFrame:
    """n and rank sum per group over average ranks of the whole table, plus N and the tie term."""
    d = df.filter(F.col(value).isNotNull())
    g = d.groupBy(group, value).agg(F.count("*").alias("_c"))
    r = average_ranks(g, [], value, "_rank", count="_c", chunks=chunks)
    j = lookup(g, r, [value])
    ties = r.agg(F.struct(F.sum("_rank_ties").cast("double").alias("total"), F.sum((F.col("_rank_ties").cast("double") ** 3) - F.col("_rank_ties")).alias("ties")).alias("t")).scalar()
    s = j.groupBy(group).agg(F.sum("_c").alias("n"), F.sum(F.col("_rank") * F.col("_c")).alias("rank_sum"))
    return s.withColumn("_t", ties).select(group, "n", "rank_sum", F.col("_t.total").alias("total"), F.col("_t.ties").alias("ties"))


def kruskal_wallis(df: DataFrame, group: str, value: str, n_groups: int, chunks: int | None = None) -> DataFrame:
    s = rank_sums(df, group, value, chunks)
    n = F.first("total")
    h = 12 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)
    ties = F.first("ties")
    return s.agg(F.when((n > 1) & (ties < n * n * n - n), h / (1 - ties / (n * n * n - n))).alias("h")).withColumn("p", chi_square_tail(F.col("h"), n_groups - 1))


def mann_whitney(df: DataFrame, group: str, value: str, first: str, second: str, chunks: int | None = None) -> DataFrame:
    """U of the first group, tie-corrected z with continuity correction, two-sided normal p."""
    s = rank_sums(df.filter(F.col(group).isin(first, second)), group, value, chunks)
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c))).cast("double")
    a = s.agg(pick("rank_sum", first).alias("r1"), pick("n", first).alias("n1"), pick("n", second).alias("n2"), F.first("ties").alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    mixed = F.col("ties") < n * n * n - n  # at least two different values
    z = F.when(mixed, (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))))
    return a.select(u.alias("u"), z.alias("z"), F.least(erfc(F.greatest(z, F.lit(0.0)) / math.sqrt(2.0)), F.lit(1.0)).alias("p"))
