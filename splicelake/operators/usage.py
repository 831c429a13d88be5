"""Site usage from junction and read counts: catalogues, evidence counts, usage tables and exports.

Everything starts from the edge table (site, partner, n), one row per distinct pair, so later groupings are bounded by
distinct coordinates and not by read depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators.ordered import lookup

PLACE = ["region", "strand"]


def read_qc(reads: DataFrame, by: Sequence[str]) -> DataFrame:
    """Raw, uniquely mapped, final and variant-tag-failed read counts."""
    mapped = S.quality_read(F.col("flag"), F.col("mapq"), F.lit(None).cast("string"))
    ok = S.quality_read(F.col("flag"), F.col("mapq"), F.col("vw"))
    return reads.groupBy(*by).agg(
        F.count("*").alias("n_raw"), F.count_if(mapped).alias("n_mapped"), F.count_if(ok).alias("n_final"),
        F.count_if(mapped & ~ok).alias("n_vw_failed"),
    )


def near_gene(junctions: DataFrame, region: str | None = None, gene_start: int | None = None, gene_end: int | None = None, max_intron: int = 0) -> DataFrame:
    """Keep junctions of one region, or with an end inside a gene widened by the longest intron."""
    d = junctions if region is None else junctions.filter(F.col("region") == region)
    if gene_start is not None:
        lo, hi = gene_start - max_intron, gene_end + max_intron
        d = d.filter((F.col("jright") >= lo) & (F.col("jleft") <= hi))
    return d


def directions(junctions: DataFrame, by: Sequence[str] = ("sample", *PLACE)) -> DataFrame:
    """Both directions of every junction row, not summed: (by, site, partner, n)."""
    ends = F.array(
        F.struct(F.col("jleft").alias("site"), F.col("jright").alias("partner")),
        F.struct(F.col("jright").alias("site"), F.col("jleft").alias("partner")),
    )
    return junctions.select(*by, "n", F.inline(ends)).select(*by, "site", "partner", "n")


def edges(junctions: DataFrame, by: Sequence[str] = ("sample", *PLACE)) -> DataFrame:
    """Both directions of every junction with summed counts: (by, site, partner, n)."""
    return directions(junctions.groupBy(*by, "jleft", "jright").agg(F.sum("n").alias("n")), by)


def alpha(edge_table: DataFrame, by: Sequence[str] = ("sample", *PLACE)) -> DataFrame:
    return edge_table.groupBy(*by, "site").agg(F.sum("n").alias("alpha"))


def partner_lists(edge_table: DataFrame, by: Sequence[str] = ("sample", *PLACE)) -> DataFrame:
    """Partner map per site, ordered by position (distinct positions, so bounded by intron length)."""
    pairs = F.array_sort(F.collect_list(F.struct("partner", "n")))
    return edge_table.groupBy(*by, "site").agg(F.map_from_entries(pairs).alias("partners"))


def competitors(edge_table: DataFrame, by: Sequence[str] = ("sample", *PLACE)) -> DataFrame:
    """Distinct (site, competitor): partners of partners other than the site itself."""
    a = edge_table.select(*by, "site", "partner")
    b = edge_table.select(*by, F.col("site").alias("partner"), F.col("partner").alias("competitor"))
    return a.join(b, [*by, "partner"]).filter("competitor <> site").select(*by, "site", "competitor").distinct()


def partner_evidence(edge_table: DataFrame, doubles: DataFrame | None = None, by: Sequence[str] = ("sample", *PLACE)) -> DataFrame:
    """Flanking, cryptic and weighted cryptic evidence per site.

    For partner ``p`` of ``x`` the flanking count is the sum of p's junctions that end beyond ``x`` on the far side: a
    running sum over p's ordered partners, so no pair of a hub's neighbours is ever formed.
    """
    by = list(by)
    hub = Window.partitionBy(*by, "site").orderBy("partner")
    before = F.sum("n").over(hub.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum("n").over(hub.rowsBetween(1, Window.unboundedFollowing))
    total = F.sum("n").over(Window.partitionBy(*by, "site"))
    # seen from the hub: site = p, partner = x
    seen = edge_table.select(
        *by, F.col("partner").alias("x"), F.col("site").alias("p"), F.col("n").alias("shared"), total.alias("alpha_p"),
        F.coalesce(F.when(F.col("site") > F.col("partner"), before).otherwise(after), F.lit(0)).alias("flank"),
    )
    if doubles is not None:
        d = doubles.select(*by, F.col("site").alias("x"), F.col("partner").alias("p"), F.col("n_double"))
        seen = lookup(seen, d, [*by, "x", "p"], "left")
    else:
        seen = seen.withColumn("n_double", F.lit(None).cast("long"))
    rest = F.greatest(F.col("alpha_p") - F.col("shared") - F.col("flank") - F.coalesce("n_double", F.lit(0)), F.lit(0))
    seen = seen.withColumn("rest", rest)
    g = seen.groupBy(*by, F.col("x").alias("site")).agg(
        F.sum("shared").alias("alpha"), F.sum("flank").alias("beta2_flank"), F.sum("rest").alias("cryptic"),
        F.sum(F.col("rest") * F.col("shared")).alias("_w"),
    )
    return g.withColumn("weighted", F.when(F.col("alpha") > 0, F.col("_w") / F.col("alpha")).otherwise(0.0)).drop("_w")


def strength(alpha: Column, beta1: Column, beta2: Column, weighted: Column | None = None) -> Column:
    den = alpha + beta1 + beta2 + (weighted if weighted is not None else F.lit(0))
    return F.when(den > 0, alpha / den).otherwise(0.0)


def site_catalogue(sites: DataFrame, edge_table: DataFrame, strict: bool = True) -> DataFrame:
    """All sites over samples with merged classes in fixed order; ``sites`` has (sample, region, strand, site).

    Edges may repeat: only the sides of the partners count, so ``directions`` of unsummed junctions will do. Rows are
    dealt once, by place, for both steps: samples of a site meet in one task.
    """
    key = ["sample", *PLACE, "site"]
    e = edge_table.select(*key, (F.col("partner") > F.col("site")).alias("down"), (F.col("partner") < F.col("site")).alias("up"))
    s = sites.select(*key, F.lit(False).alias("down"), F.lit(False).alias("up"))
    per = s.unionByName(e).repartition(*PLACE, "site").groupBy(*key).agg(F.max("down").alias("down"), F.max("up").alias("up"))
    d, u = F.col("down"), F.col("up")
    cls = F.when(d & u, "both").when(d, "exon_end").when(u, "exon_start").otherwise("unknown")
    per = per.withColumn("cls", cls)
    flags = [F.max(F.col("cls") == c).alias(c) for c in S.SITE_CLASS_ORDER]
    g = per.groupBy(*PLACE, "site").agg(*flags)
    known = F.col("exon_end") | F.col("exon_start") | F.col("both")
    parts = [F.when(F.col(c) & (~known if c == "unknown" else F.lit(True)), F.lit(c)) for c in S.SITE_CLASS_ORDER]
    return g.select(*PLACE, "site", F.concat_ws(",", *parts).alias("site_type"))


def ambiguous(site_type: Column, strict: bool = False) -> Column:
    if strict:
        return site_type.isin(*S.STRICT_AMBIGUOUS)
    return site_type.contains(",") | (site_type == "both")


def annotate(usage: DataFrame, catalogue: DataFrame, strict: bool = False) -> DataFrame:
    """Attach the catalogue class; null where unknown to it or ambiguous."""
    c = catalogue.select(*PLACE, "site", F.when(~ambiguous(F.col("site_type"), strict), F.col("site_type")).alias("site_type"))
    return lookup(usage, c, [*PLACE, "site"], "left")


def shift_starts(annotated: DataFrame) -> DataFrame:
    """``exon_start`` sites move from last intronic to first exonic base."""
    return annotated.withColumn("site", F.col("site") + F.when(F.col("site_type") == "exon_start", 1).otherwise(0))


def unique_sites(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop every member of a duplicated key (aggregation with map-side combine, no per-key window)."""
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    return g.filter("_n = 1").select(*df.columns)


def annotation_summary(annotated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Initial, ambiguous, duplicate and final site counts, by type and strand."""
    by = list(by)
    shifted = shift_starts(annotated)
    per = shifted.groupBy(*by, *PLACE, "site").agg(
        F.count("*").alias("n_all"), F.count("site_type").alias("n_typed"), F.first("site_type", ignorenulls=True).alias("site_type"),
    )
    kept = F.col("n_typed") == 1
    count = lambda c: F.count_if(kept & c)
    t, s = F.col("site_type"), F.col("strand")
    return per.groupBy(*by).agg(
        F.sum("n_all").alias("n_initial"), F.sum(F.col("n_all") - F.col("n_typed")).alias("n_ambiguous"),
        F.sum(F.when(F.col("n_typed") > 1, F.col("n_typed")).otherwise(0)).alias("n_duplicate"), F.count_if(kept).alias("n_final"),
        count((t == "exon_start") & (s == "+")).alias("start_plus"), count((t == "exon_start") & (s == "-")).alias("start_minus"),
        count((t == "exon_end") & (s == "+")).alias("end_plus"), count((t == "exon_end") & (s == "-")).alias("end_minus"),
    )


def dropped_sites(annotated: DataFrame, limit: int = 100) -> DataFrame:
    """The first dropped sites for the log, in coordinate order."""
    return annotated.filter("site_type IS NULL").select(*PLACE, "site").distinct().orderBy(*PLACE, "site").limit(limit)


def fractions(usage: DataFrame, betas: Sequence[str] = ("beta1",), key: Sequence[str] = (*PLACE, "site", "site_type")) -> DataFrame:
    """Summed counts per site and sample with the ``a/b`` text form."""
    den = F.sum("alpha") + sum(F.sum(F.coalesce(b, F.lit(0))) for b in betas)
    g = usage.groupBy("sample", *key).agg(F.sum("alpha").alias("num"), den.alias("den"))
    return g.withColumn("fraction", F.when(F.col("den") == 0, "0/0").otherwise(F.concat_ws("/", F.col("num").cast("string"), F.col("den").cast("string"))))


def usage_table(fraction_table: DataFrame, min_coverage: int = S.MIN_COVERAGE) -> DataFrame:
    return fraction_table.withColumn("ssu", S.masked_usage(F.col("num"), F.col("den"), min_coverage))


EXACT_UNITS = 1_000_000_000


def usage_matrix(usage: DataFrame, key: Sequence[str] = (*PLACE, "site", "site_type")) -> DataFrame:
    """Long processed matrix: mean over unmasked samples; sites masked everywhere are dropped.

    The mean is of whole billionths, so it is the same in whatever order the samples are added.
    """
    exact = F.sum(F.floor(F.col("ssu") * EXACT_UNITS)) / (F.count("ssu") * EXACT_UNITS)
    g = usage.groupBy(*key).agg(exact.alias("pop_mean"), F.count("ssu").alias("n_valid"), F.count("*").alias("n_samples"))
    return g.filter("n_valid > 0")


def wide(usage: DataFrame, samples: Sequence[str], value: str, key: Sequence[str]) -> DataFrame:
    """Pivot to one column per sample, for sinks only; the sample list is given, so no extra pass finds it."""
    return usage.groupBy(*key).pivot("sample", list(samples)).agg(F.first(value))


def differential_table(counts: DataFrame, samples: Sequence[str], min_reads: int = 10, key: Sequence[str] = (*PLACE, "site")) -> DataFrame:
    """Alpha, beta and strength per sample side by side, null below ``min_reads``; two decimals are a matter of the sink."""
    ok = F.col("alpha") + F.col("beta1") + F.col("beta2") >= min_reads
    beta = F.col("beta1") + F.col("beta2") + F.coalesce("weighted", F.lit(0.0))
    d = counts.select(
        *key, "sample", F.when(ok, F.col("alpha")).alias("alpha"), F.when(ok, beta).alias("beta"),
        F.when(ok, F.col("sse")).alias("sse"),
    )
    aggs = [F.first(F.when(F.col("sample") == s, F.col(c)), ignorenulls=True).alias(f"{s}_{c}") for s in samples for c in ("alpha", "beta", "sse")]
    return d.groupBy(*key).agg(*aggs)


def phenotype_rows(counts: DataFrame, min_reads: int = 10, min_samples: int = 5, key: Sequence[str] = (*PLACE, "site")) -> DataFrame:
    """Rows of sites that pass in at least ``min_samples`` samples (one row per site and sample)."""
    d = counts.filter(F.col("alpha") + F.col("beta1") + F.col("beta2") >= min_reads)
    n = F.count("*").over(Window.partitionBy(*key))
    return d.withColumn("n_pass", n).filter(F.col("n_pass") >= min_samples)


def write_phenotypes(rows: DataFrame, path: str) -> None:
    rows.select("gene", "site", "sample", "sse").write.mode("overwrite").partitionBy("gene", "site").option("sep", "\t").csv(path)


def site_statistics(usage: DataFrame, key: Sequence[str] = (*PLACE, "site", "site_type")) -> DataFrame:
    """n, mean, min, max, IQR, population variance and Gini over the samples with a value (one row per sample)."""
    d = usage.filter("ssu IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("ssu", "sample"))
    g = d.withColumn("_r", rank).groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("ssu").alias("mean"), F.min("ssu").alias("min"), F.max("ssu").alias("max"),
        (F.percentile("ssu", F.lit(0.75)) - F.percentile("ssu", F.lit(0.25))).alias("iqr"), F.var_pop("ssu").alias("var"),
        F.sum("ssu").alias("_t"), F.sum(F.col("_r") * F.col("ssu")).alias("_rt"),
    )
    n, t = F.col("n"), F.col("_t")
    gini = F.when((n < 2) | (t == 0), 0.0).otherwise((2 * F.col("_rt") - (n + 1) * t) / (n * t))
    return g.withColumn("gini", gini).drop("_t", "_rt")


def informative_sites(usage: DataFrame, key: Sequence[str], regions: Sequence[str] | None = None) -> DataFrame:
    d = usage if regions is None else usage.filter(F.col("region").isin(*regions))
    return d.groupBy(*key).agg(F.max(F.coalesce(F.col("ssu") > 0, F.lit(False))).alias("_ok")).filter("_ok").drop("_ok")


def sample_grid(usage: DataFrame, samples: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every site in every sample; samples without a row get nulls.

    Sites carry the sample array from a one-value subquery and explode it, so there is no product join.
    """
    ids = samples.select(F.array_sort(F.collect_set("sample")).alias("ids"))
    sites = usage.select(*key).distinct()
    grid = sites.withColumn("_ids", ids.scalar()).select(*key, F.explode("_ids").alias("sample"))
    return lookup(grid, usage, [*key, "sample"], "left")


def shallow_sites(usage: DataFrame, key: Sequence[str], min_samples: int, min_reads: int, min_sse: float) -> DataFrame:
    """Sites with enough samples that reach read depth and strength; used before combining."""
    ok = (F.col("alpha") + F.col("beta1") >= min_reads) & (F.col("sse") >= min_sse)
    return usage.groupBy(*key).agg(F.count_if(ok).alias("n_pass")).filter(F.col("n_pass") >= min_samples)


def fill_missing(catalogue: DataFrame, usage: DataFrame, evidence: DataFrame, samples: DataFrame) -> DataFrame:
    """Complete each sample to the catalogue: existing counts stay, missing sites take their read evidence."""
    key = [*PLACE, "site"]
    ids = samples.select(F.array_sort(F.collect_set("sample")).alias("ids"))
    grid = catalogue.select(*key).distinct().withColumn("_ids", ids.scalar()).select(*key, F.explode("_ids").alias("sample"))
    have = usage.select("sample", *key, "alpha", "beta1", "beta2", F.lit(True).alias("measured"))
    ev = evidence.select("sample", *key, F.col("beta1").alias("ev_beta1"), F.col("beta2").alias("ev_beta2"))
    j = lookup(lookup(grid, have, ["sample", *key], "left"), ev, ["sample", *key], "left")
    old = F.coalesce("measured", F.lit(False))
    pick = lambda a, b: F.when(old, F.col(a)).otherwise(F.coalesce(b, F.lit(0)))
    out = j.select(
        "sample", *key, old.alias("measured"), F.when(old, F.col("alpha")).otherwise(0).alias("alpha"),
        pick("beta1", "ev_beta1").alias("beta1"), pick("beta2", "ev_beta2").alias("beta2"),
    )
    return out.withColumn("sse", strength(F.col("alpha"), F.col("beta1"), F.col("beta2")))


def common_read_length(reads: DataFrame, first_n: int, by: str = "sample", order: str = "qname") -> DataFrame:
    """Most frequent length among the first ``first_n`` reads of each sample (ties: the longer one).

    The rank filter is a constant, so each map task keeps at most ``first_n`` reads per sample before the shuffle.
    """
    w = Window.partitionBy(by).orderBy(order)
    head = reads.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= first_n)
    g = head.groupBy(by, "read_length").agg(F.count("*").alias("n"))
    return g.groupBy(by).agg(F.max_by("read_length", F.struct("n", "read_length")).alias("read_length"), F.max("n").alias("n"))
