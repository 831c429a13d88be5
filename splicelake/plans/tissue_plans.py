"""Queries over tissues, expression and reproducible splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators import curves as C
from splicelake.operators import evaluation as V
from splicelake.operators import expression as X
from splicelake.operators import joins as J
from splicelake.operators import sampling as P
from splicelake.operators import strata as T
from splicelake.operators import tissues as T5
from splicelake.operators.ordered import lookup
from splicelake.plans.metric_plans import REG_COLS, rounded, sql_reg
from splicelake.plans.registry import query
from splicelake.plans.usage_plans import FRAC, SAMPLES, _usage
from splicelake.plans.views import cte, table, view

# a few sites are missing in one tissue, so that completeness matters
TS = ", ts AS (SELECT * FROM v_tissue_site WHERE NOT (pos % 5 = 0 AND tissue = 'view') AND NOT (pos % 7 = 0 AND tissue = 'click')), sx AS (SELECT pos, tissue, count(*) AS n, avg(ssu) AS mean, median(ssu) AS med, coalesce(stddev_samp(ssu), 0) AS sd, min(ssu) AS mn, max(ssu) AS mx FROM ts GROUP BY pos, tissue), sn AS (SELECT *, count(*) OVER (PARTITION BY pos) AS nt FROM sx)"
TAU = ", tu AS (SELECT pos, count(*) AS n_tissues, max(mean) AS max_ssu, avg(mean) AS mean_ssu, stddev_pop(mean) AS sd, max(mean) - min(mean) AS rng, count(*) FILTER (WHERE mean > 0.1) AS n_active, CASE WHEN max(mean) > 0 THEN (count(*) - sum(mean) / max(mean)) / (count(*) - 1) ELSE 0 END AS tau FROM sx GROUP BY pos HAVING count(*) >= 2)"
GROUP = "CASE WHEN tau <= 0.1 THEN 'constitutive' WHEN tau <= 0.5 THEN 'intermediate' ELSE 'tissue-specific' END"


def _ts(spark, sf):
    return view(spark, sf, "v_tissue_site").filter("NOT (pos % 5 = 0 AND tissue = 'view') AND NOT (pos % 7 = 0 AND tissue = 'click')")


def _stats(spark, sf):
    return T5.site_tissue_stats(_ts(spark, sf), ["pos"])


@query(cte("v_tissue_site") + TS + " SELECT pos, tissue, n, round(mean, 6) AS mean, round(med, 6) AS median, round(sd, 6) AS sd, round(mn, 6) AS min, round(mx, 6) AS max, nt AS n_tissues FROM sn")
def site_tissue_stats(spark, sf):
    return rounded(_stats(spark, sf), ["mean", "median", "sd", "min", "max"])


@query(cte("v_tissue_site") + TS + TAU + " SELECT pos, n_tissues, round(max_ssu, 6) AS max_ssu, round(mean_ssu, 6) AS mean_ssu, round(sd, 6) AS sd, round(rng, 6) AS range, n_active, round(tau, 6) AS tau FROM tu")
def tissue_specificity(spark, sf):
    return rounded(T5.specificity(_stats(spark, sf), ["pos"]), ["max_ssu", "mean_ssu", "sd", "range", "tau"])


@query(cte("v_tissue_site") + TS + TAU + f", j AS (SELECT ts.tissue, {GROUP} AS grp, ts.ssu, tu.mean_ssu AS pred FROM ts JOIN tu USING (pos) WHERE n_tissues = 5) SELECT tissue, grp, {sql_reg('ssu', 'pred')} FROM j GROUP BY tissue, grp")
def specificity_group_metrics(spark, sf):
    t = T5.specificity(_stats(spark, sf), ["pos"]).filter("n_tissues = 5").select("pos", T5.specificity_group(F.col("tau")).alias("grp"), F.col("mean_ssu").alias("pred"))
    return rounded(C.regression_metrics(lookup(_ts(spark, sf), t, ["pos"]), ["tissue", "grp"], "ssu", "pred"), REG_COLS)


OUT = ", ou AS (SELECT pos, arg_max(tissue, (mean, tissue)) AS max_tissue, arg_min(tissue, (mean, tissue)) AS min_tissue, max(mean) - avg(mean) AS up, avg(mean) - min(mean) AS dn, list_sort(list(mean)) AS v FROM sx GROUP BY pos HAVING count(*) = 5), od AS (SELECT pos, max_tissue, min_tissue, CASE WHEN up >= dn THEN 'inclusion' ELSE 'exclusion' END AS direction, CASE WHEN up >= dn THEN max_tissue ELSE min_tissue END AS outlier, CASE WHEN v[4] > 0 THEN v[5] / v[4] WHEN v[5] > 0 THEN 'Infinity'::DOUBLE END AS specificity_ratio, CASE WHEN v[1] > 0 THEN v[2] / v[1] WHEN v[2] > 0 THEN 'Infinity'::DOUBLE END AS depletion_ratio FROM ou)"


def _outlier(spark, sf):
    return T5.outlier_tissue(_stats(spark, sf), ["pos"], 5)


@query(cte("v_tissue_site") + TS + OUT + " SELECT pos, max_tissue, min_tissue, direction, outlier, round(specificity_ratio, 6) AS specificity_ratio, round(depletion_ratio, 6) AS depletion_ratio FROM od")
def outlier_tissues(spark, sf):
    return rounded(_outlier(spark, sf), ["specificity_ratio", "depletion_ratio"])


@query(cte("v_tissue_site") + TS + TAU + OUT + ", b AS (SELECT CAST(least(floor(tau * 10), 9) AS INT) AS tau_bin, outlier, direction FROM od JOIN tu USING (pos)) SELECT tau_bin, outlier, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tau_bin), 6) AS share FROM b GROUP BY tau_bin, outlier")
def outlier_shares(spark, sf):
    t = T5.specificity(_stats(spark, sf), ["pos"]).select("pos", T5.tau_bin(F.col("tau")).alias("tau_bin"))
    return rounded(T5.share_table(lookup(_outlier(spark, sf), t, ["pos"]), "tau_bin", "outlier"), ["share"])


@query(cte("v_tissue_site") + TS + TAU + OUT + ", b AS (SELECT CAST(least(floor(tau * 10), 9) AS INT) AS tau_bin, direction FROM od JOIN tu USING (pos)) SELECT tau_bin, direction, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tau_bin), 6) AS share FROM b GROUP BY tau_bin, direction")
def direction_shares(spark, sf):
    t = T5.specificity(_stats(spark, sf), ["pos"]).select("pos", T5.tau_bin(F.col("tau")).alias("tau_bin"))
    return rounded(T5.share_table(lookup(_outlier(spark, sf), t, ["pos"]), "tau_bin", "direction"), ["share"])


@query(cte("v_usage") + ", t AS (SELECT DISTINCT region, site FROM v_usage WHERE site % 3 = 0), d AS (SELECT site, sample FROM v_usage WHERE alpha >= 7 GROUP BY ALL), o AS (SELECT site, min(sample) AS sample FROM d GROUP BY site HAVING count(*) = 1) SELECT sample, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM o GROUP BY sample")
def single_origin_shares(spark, sf):
    """Sites seen in one sample only: where they come from."""
    d = view(spark, sf, "v_usage").filter("alpha >= 7").groupBy("site", "sample").agg(F.count("*").alias("n"))
    one = d.groupBy("site").agg(F.count("*").alias("k"), F.min("sample").alias("sample")).filter("k = 1")
    g = one.groupBy("sample").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / g.agg(F.sum("n")).scalar(), 6))


@query(cte("v_tissue_site") + TS + ", w AS (SELECT pos, tissue, avg(ssu) AS m, var_samp(ssu) AS v FROM ts GROUP BY pos, tissue) SELECT pos, round(avg(m), 6) AS mean, round(var_samp(m), 6) AS var, round(stddev_samp(m), 6) AS sd, round(max(m) - min(m), 6) AS range, round(avg(v), 6) AS within_var FROM w GROUP BY pos HAVING count(*) = 5")
def tissue_variability(spark, sf):
    return rounded(T5.variability(_ts(spark, sf), ["pos"], 5), ["mean", "var", "sd", "range", "within_var"])


RES = ", rs AS (SELECT tissue, sample, pos, ssu, 'h1' AS head, abs((pos % 50) / 50 - ssu) AS abs_resid FROM v_tissue_site UNION ALL SELECT tissue, sample, pos, ssu, 'h2', abs((pos % 31) / 31 - ssu) FROM v_tissue_site)"


def _residuals(spark, sf):
    d = view(spark, sf, "v_tissue_site").withColumns({"h1": F.col("pos") % 50 / 50, "h2": F.col("pos") % 31 / 31})
    return T5.residuals(d, ["tissue", "sample", "pos"], "ssu", ["h1", "h2"])


@query(cte("v_tissue_site") + RES + " SELECT pos, head, round(median(abs_resid), 6) AS median_resid FROM rs GROUP BY pos, head")
def residual_medians(spark, sf):
    return rounded(V.medians(_residuals(spark, sf), ["pos", "head"], "abs_resid", "median_resid"), ["median_resid"])


@query(cte("v_tissue_site") + RES + ", e AS (SELECT head, quantile_cont(ssu, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM rs GROUP BY head), b AS (SELECT rs.*, len(list_filter(q, lambda x: x <= ssu)) AS bin FROM rs JOIN e USING (head)), m AS (SELECT head, bin, tissue, sample, avg(abs_resid) AS m FROM b GROUP BY ALL) SELECT head, CAST(bin AS INT) AS bin, tissue, round(avg(m), 6) AS mean, count(*) AS n FROM m GROUP BY head, bin, tissue")
def residuals_by_quantile(spark, sf):
    b = V.quantile_edges_bins(_residuals(spark, sf), ["head"], "ssu", 8)
    return rounded(T5.two_level_mean(b, ["head", "bin", "tissue"], ["sample"], "abs_resid"), ["mean"])


@query(cte("v_tissue_site") + TS + f", j AS (SELECT nt AS n_tissues, ts.ssu, (ts.pos % 50) / 50 AS pred FROM ts JOIN (SELECT pos, max(nt) AS nt FROM sn GROUP BY pos) x USING (pos)) SELECT n_tissues, {sql_reg('ssu', 'pred')} FROM j GROUP BY n_tissues")
def metrics_by_tissues_detected(spark, sf):
    nt = _ts(spark, sf).groupBy("pos").agg(F.count_distinct("tissue").alias("n_tissues"))
    d = lookup(_ts(spark, sf), nt, ["pos"]).withColumn("pred", F.col("pos") % 50 / 50)
    return rounded(C.regression_metrics(d, ["n_tissues"], "ssu", "pred"), REG_COLS)


@query(cte("v_tissue_site") + TS + TAU + f", j AS (SELECT CAST(least(floor(tau * 10), 9) AS INT) AS tau_bin, n_tissues, ts.ssu, (ts.pos % 50) / 50 AS pred FROM ts JOIN tu USING (pos)) SELECT tau_bin, n_tissues, {sql_reg('ssu', 'pred')} FROM j GROUP BY tau_bin, n_tissues")
def metrics_by_specificity(spark, sf):
    t = T5.specificity(_stats(spark, sf), ["pos"]).select("pos", "n_tissues", T5.tau_bin(F.col("tau")).alias("tau_bin"))
    d = lookup(_ts(spark, sf), t, ["pos"]).withColumn("pred", F.col("pos") % 50 / 50)
    return rounded(C.regression_metrics(d, ["tau_bin", "n_tissues"], "ssu", "pred"), REG_COLS)


@query(cte("v_pred") + ", g AS (SELECT sample, region, pos, count(head_b) AS n, max(head_b) - min(head_b) AS d FROM v_pred WHERE y_ssu <> 777 GROUP BY ALL HAVING count(head_b) = 2) SELECT sample, count(*) AS n_pairs, round(avg(CASE WHEN d > 0.01 THEN 1 ELSE 0 END), 6) AS share_001, round(avg(CASE WHEN d > 0.05 THEN 1 ELSE 0 END), 6) AS share_005, round(avg(CASE WHEN d > 0.1 THEN 1 ELSE 0 END), 6) AS share_010, round(avg(d), 6) AS mean_delta, round(median(d), 6) AS median_delta FROM g GROUP BY sample")
def allele_differences(spark, sf):
    d = T5.allele_differences(view(spark, sf, "v_pred").filter("y_ssu <> 777"), ["sample"], ["region", "pos"], "head_b")
    return rounded(d, ["share_001", "share_005", "share_010", "mean_delta", "median_delta"])


@query(cte("v_usage") + FRAC + ", sh AS (SELECT region, strand, site FROM us GROUP BY ALL HAVING count(ssu) >= 8 AND count(ssu) = count(*)) SELECT sample, count(*) AS n_valid, count(sh.site) AS n_shared, round(100 * (1 - count(sh.site) / count(*)), 6) AS pct_lost FROM us LEFT JOIN sh USING (region, strand, site) WHERE ssu IS NOT NULL GROUP BY sample")
def shared_site_loss(spark, sf):
    u = _usage(spark, sf)
    key = ["region", "strand", "site"]
    sh = u.groupBy(*key).agg(F.count("*").alias("n"), F.count("ssu").alias("v")).filter("v >= 8 AND v = n")
    return rounded(T5.shared_loss(u, sh, key), ["pct_lost"])


@query(cte("v_tissue_site") + ", v4 AS (SELECT * FROM v_tissue_site WHERE tissue <> 'view'), w AS (SELECT pos, tissue, avg(ssu) AS m FROM v4 GROUP BY ALL), c AS (SELECT pos, stddev_samp(m) AS sd FROM w GROUP BY pos HAVING count(*) = 4), j AS (SELECT v4.tissue, v4.sample, CAST(least(floor(sd * 20), 9) AS INT) AS bin, abs(ssu - (v4.pos % 50) / 50) AS e FROM v4 JOIN c USING (pos)), m AS (SELECT tissue, sample, bin, avg(e) AS m FROM j GROUP BY ALL) SELECT tissue, bin, round(avg(m), 6) AS mean, count(*) AS n FROM m GROUP BY tissue, bin")
def second_set_variability_bins(spark, sf):
    """The four-tissue test set: errors by cross-tissue sd over sites seen in all four."""
    v = view(spark, sf, "v_tissue_site").filter("tissue <> 'view'")
    c = T5.variability(v, ["pos"], 4).select("pos", F.least(F.floor(F.col("sd") * 20), F.lit(9)).cast("int").alias("bin"))
    d = lookup(v, c, ["pos"]).withColumn("e", F.abs(F.col("ssu") - F.col("pos") % 50 / 50))
    return rounded(T5.two_level_mean(d, ["tissue", "bin"], ["sample"], "e"), ["mean"])


def _sql_individuals(by):
    return f""", sx AS (SELECT {by}, tissue, sample, CASE WHEN var_pop(ssu) > 0 THEN 1 - sum((ssu - p) * (ssu - p)) / (var_pop(ssu) * count(*)) END AS r2, CASE WHEN var_pop(ssu) > 0 AND var_pop(p) > 0 THEN corr(ssu, p) END AS pearson, avg((ssu - p) * (ssu - p)) AS mse, median(abs(ssu - p)) AS median_ae FROM b GROUP BY {by}, tissue, sample HAVING count(*) >= 10)
SELECT {by}, count(*) AS n_groups, round(avg(r2), 6) AS r2, round(avg(pearson), 6) AS pearson, round(avg(mse), 6) AS mse, round(avg(median_ae), 6) AS median_ae FROM sx GROUP BY {by}"""


IND = ["r2", "pearson", "mse", "median_ae"]


@query(cte("v_tissue_site") + ", h AS (SELECT tissue, sample, pos, ssu, 'h1' AS head, (pos % 50) / 50 AS p FROM v_tissue_site UNION ALL SELECT tissue, sample, pos, ssu, 'h2', (pos % 31) / 31 FROM v_tissue_site), e AS (SELECT head, quantile_cont(ssu, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM h GROUP BY head), b AS (SELECT h.*, CAST(len(list_filter(q, lambda x: x <= ssu)) AS INT) AS bin FROM h JOIN e USING (head))" + _sql_individuals("head, bin"))
def metrics_by_quantile(spark, sf):
    """All metrics per usage bin: of every tissue and individual, then their mean."""
    d = view(spark, sf, "v_tissue_site").withColumns({"h1": F.col("pos") % 50 / 50, "h2": F.col("pos") % 31 / 31}).unpivot(["tissue", "sample", "pos", "ssu"], ["h1", "h2"], "head", "p")
    b = V.quantile_edges_bins(d, ["head"], "ssu", 8)
    return rounded(T5.individual_metrics(b, ["head", "bin"], ["tissue", "sample"], "ssu", "p"), IND[:2]).withColumns({c: F.round(c, 6) for c in IND[2:]})


@query(cte("v_tissue_site") + ", v4 AS (SELECT * FROM v_tissue_site WHERE tissue <> 'view'), w AS (SELECT pos, tissue, avg(ssu) AS m FROM v4 GROUP BY ALL), c AS (SELECT pos, stddev_samp(m) AS sd FROM w GROUP BY pos HAVING count(*) = 4), b AS (SELECT v4.*, CAST(least(floor(sd * 20), 9) AS INT) AS bin, (v4.pos % 50) / 50 AS p FROM v4 JOIN c USING (pos))" + _sql_individuals("bin"))
def second_set_metrics(spark, sf):
    """The four-tissue test set: all metrics by cross-tissue sd, of every tissue and individual, then their mean."""
    v = view(spark, sf, "v_tissue_site").filter("tissue <> 'view'")
    c = T5.variability(v, ["pos"], 4).select("pos", F.least(F.floor(F.col("sd") * 20), F.lit(9)).cast("int").alias("bin"))
    d = lookup(v, c, ["pos"]).withColumn("p", F.col("pos") % 50 / 50)
    return rounded(T5.individual_metrics(d, ["bin"], ["tissue", "sample"], "ssu", "p"), IND[:2]).withColumns({c: F.round(c, 6) for c in IND[2:]})


# --- expression ---------------------------------------------------------------------------------------------------

CN = ", cn AS (SELECT sample, concat('G', CAST(site AS STRING)) AS gene_id, CAST(sum(alpha) % 9 AS BIGINT) AS n, max(site) % 17 * 100 AS length FROM v_usage GROUP BY sample, site)"


def _counts(spark, sf):
    return view(spark, sf, "v_usage").groupBy("sample", F.concat(F.lit("G"), F.col("site").cast("string")).alias("gene_id")).agg((F.sum("alpha") % 9).alias("n"), (F.max("site") % 17 * 100).alias("length"))


@query(cte("v_usage") + CN + " SELECT gene_id, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN sample = '{s}' THEN n END), 0) AS BIGINT) AS {s}" for s in SAMPLES) + " FROM cn GROUP BY gene_id")
def expression_counts(spark, sf):
    return X.complete_counts(_counts(spark, sf), SAMPLES)


@query(cte("v_usage") + CN + ", r AS (SELECT *, CASE WHEN length > 0 THEN n / (length / 1000) END AS rpk FROM cn) SELECT sample, gene_id, round(coalesce(rpk / (sum(rpk) OVER (PARTITION BY sample) / 1e6), 0), 4) AS tpm FROM r")
def expression_tpm(spark, sf):
    return X.tpm(_counts(spark, sf)).select("sample", "gene_id", F.round("tpm", 4).alias("tpm"))


SF = ", gm AS (SELECT gene_id, exp(avg(ln(n))) AS gm FROM cn WHERE n > 0 GROUP BY gene_id), fz AS (SELECT sample, median(n / gm) AS size_factor FROM cn JOIN gm USING (gene_id) WHERE n > 0 GROUP BY sample)"


@query(cte("v_usage") + CN + SF + " SELECT sample, round(size_factor, 6) AS size_factor FROM fz")
def size_factors(spark, sf):
    return rounded(X.size_factors(_counts(spark, sf)), ["size_factor"])


@query(cte("v_usage") + CN + SF + " SELECT sample, gene_id, round(n / size_factor, 6) AS norm FROM cn JOIN fz USING (sample)")
def normalised_counts(spark, sf):
    c = _counts(spark, sf)
    return rounded(X.normalised_counts(c, X.size_factors(c)), ["norm"]).select("sample", "gene_id", "norm")


LEN = ", ln AS (SELECT sample, gene_id, CASE WHEN (site * 7 + CAST(substring(sample, 2) AS INT)) % 50 = 0 THEN NULL ELSE length END AS length FROM (SELECT *, CAST(substring(gene_id, 2) AS INT) AS site FROM cn) q)"


@query(cte("v_usage") + CN + LEN + " SELECT a.sample, count(*) FILTER (WHERE a.length IS DISTINCT FROM b.length) AS n_different FROM ln a JOIN ln b ON a.gene_id = b.gene_id AND b.sample = 'S0' WHERE a.sample <> 'S0' GROUP BY a.sample")
def length_disagreements(spark, sf):
    site, s = F.substring("gene_id", 2, 20).cast("int"), F.substring("sample", 2, 9).cast("int")
    l = _counts(spark, sf).withColumn("length", F.when((site * 7 + s) % 50 != 0, F.col("length")))
    return X.length_disagreements(l, "S0")


@query(cte("v_gene") + "SELECT gene_id, arg_min(m, gstart) AS mean FROM (SELECT concat('G', CAST(gstart % 700 AS STRING)) AS gene_id, gstart, (tpm + gstart) / 2 AS m FROM v_gene) t GROUP BY gene_id")
def mean_expression(spark, sf):
    g = view(spark, sf, "v_gene").select(F.concat(F.lit("G"), (F.col("gstart") % 700).cast("string"), F.lit("."), F.col("gstart").cast("string")).alias("gene_id"), "gstart", F.col("tpm").alias("t1"), F.col("gstart").cast("double").alias("t2"))
    return X.mean_expression(g, ["t1", "t2"], "gstart")


@query(cte("v_gene") + "SELECT gene_id, t AS tissue, CAST(floor(CASE WHEN v > 0 THEN log2(v) ELSE -10 END / 0.4) AS INT) AS bin FROM (SELECT gene_id, 'lung' AS t, tpm - 905 AS v FROM v_gene UNION ALL SELECT gene_id, 'testis', tpm - 950 FROM v_gene) x")
def tissue_expression_bins(spark, sf):
    g = view(spark, sf, "v_gene").select("gene_id", (F.col("tpm") - 905).alias("lung"), (F.col("tpm") - 950).alias("testis"))
    return X.tissue_bins(g, ["lung", "testis"])


# --- splits -------------------------------------------------------------------------------------------------------


def md(seed, *cols):
    return "md5(concat_ws(':', CAST(" + str(seed) + " AS STRING), " + ", ".join(f"CAST({c} AS STRING)" for c in cols) + "))"


@query(cte("v_gene") + ", h AS (SELECT g.*, s FROM v_gene g JOIN (SELECT 0 AS m, 'train' AS s UNION ALL SELECT 1, 'train' UNION ALL SELECT 2, 'test') x ON x.m = g.gstart % 5) SELECT s AS split, gene_id FROM h WHERE (s = 'train' AND (region IN ('chr1', 'chr2') OR paralog = 1)) OR (s = 'test' AND region IN ('chr3', 'chr4') AND paralog = 0)")
def list_split(spark, sf):
    g = view(spark, sf, "v_gene").withColumn("sid", F.concat(F.lit("D"), (F.col("gstart") % 5).cast("string")))
    ids = g.select(F.col("sid").alias("sample")).distinct()
    d = P.split_by_lists(g, "sid", "region", ids.filter("sample IN ('D0', 'D1')"), ids.filter("sample = 'D2'"), ["chr1", "chr2"], ["chr3", "chr4"], "paralog")
    return d.select("split", "gene_id")


@query(cte("v_sample") + f", r AS (SELECT sample_id, k, row_number() OVER (PARTITION BY k ORDER BY {md('42 + k', 'sample_id')}) AS rn, count(*) OVER (PARTITION BY k) AS n FROM v_sample CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) x) SELECT CAST(k AS INT) AS replicate, sample_id, CASE WHEN rn <= floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r")
def sample_splits(spark, sf):
    return P.replicate_splits(view(spark, sf, "v_sample"), ["sample_id"], 3, 0.1, 42).select("replicate", "sample_id", "split")


GOODT = ", ok AS (SELECT * FROM v_gene WHERE NOT (paralog = 0 AND region IN ('chr5')))"


def _transcripts(spark, sf):
    return P.usable_transcripts(view(spark, sf, "v_gene"), "region", "paralog", ["chr5"])


@query(cte("v_gene") + GOODT + f", r AS (SELECT gene_id, paralog, k, row_number() OVER (PARTITION BY k, paralog ORDER BY {md('42 + k', 'gene_id')}) AS rn, count(*) OVER (PARTITION BY k) AS n FROM ok CROSS JOIN (SELECT unnest([1, 2]) AS k) x) SELECT CAST(k AS INT) AS replicate, gene_id, CASE WHEN paralog = 0 AND rn <= floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r")
def transcript_splits(spark, sf):
    """Validation size is a fraction of all rows, picks come from non-paralogs."""
    return P.replicate_splits(_transcripts(spark, sf), ["gene_id"], 2, 0.1, 42, F.col("paralog") == 0, of_all=True).select("replicate", "gene_id", "split")


@query(cte("v_gene") + GOODT + f", r AS (SELECT gene_id, k, row_number() OVER (PARTITION BY k ORDER BY {md('42 + k', 'gene_id')}) AS rn, count(*) OVER (PARTITION BY k) AS n FROM ok CROSS JOIN (SELECT unnest([1, 2]) AS k) x WHERE paralog = 0) SELECT CAST(k AS INT) AS replicate, gene_id, CASE WHEN rn <= floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r")
def nonparalog_splits(spark, sf):
    """Validation size is a fraction of the non-paralogs; paralogs are a separate output."""
    return P.replicate_splits(_transcripts(spark, sf).filter("paralog = 0"), ["gene_id"], 2, 0.1, 42).select("replicate", "gene_id", "split")


@query(cte("v_gene") + GOODT + f", r AS (SELECT gene_id, k, row_number() OVER (PARTITION BY k ORDER BY {md('42 + k', 'gene_id')}) AS rn, count(*) OVER (PARTITION BY k) AS n FROM ok CROSS JOIN (SELECT unnest([1, 2]) AS k) x WHERE paralog = 0) SELECT CAST(k AS INT) AS replicate, gene_id, CASE WHEN rn <= floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r UNION ALL SELECT 0, gene_id, 'paralogs' FROM ok WHERE paralog = 1")
def paralog_splits(spark, sf):
    """Splits of the non-paralogs with the paralogs as an output of their own."""
    return P.paralog_splits(_transcripts(spark, sf), ["gene_id"], "paralog", 2, 0.1, 42).select("replicate", "gene_id", "split")


@query(cte("v_gene") + f", h AS (SELECT *, {md(7, 'gene_id')} AS h FROM v_gene), t AS (SELECT gene_id FROM h WHERE region = 'chr4' AND paralog = 0), rest AS (SELECT * FROM h WHERE NOT (region = 'chr4' AND paralog = 0)), p AS (SELECT *, h = min(h) OVER (PARTITION BY region) AS must FROM rest WHERE paralog = 0), q AS (SELECT *, row_number() OVER (ORDER BY must DESC, h) AS rn FROM p) SELECT gene_id, 'test' AS split FROM t UNION ALL SELECT gene_id, 'train' FROM rest WHERE paralog = 1 UNION ALL SELECT gene_id, CASE WHEN must OR rn <= (SELECT floor(count(*) * 0.1) FROM rest) THEN 'validation' ELSE 'train' END FROM q")
def chromosome_holdout(spark, sf):
    d = P.chromosome_holdout(view(spark, sf, "v_gene"), ["gene_id"], "region", "paralog", ["chr4"], 0.1, 7, each_chromosome=True)
    return d.select("gene_id", "split")


@query(cte("v_sample") + f", e AS (SELECT * FROM v_sample WHERE stratum IN ('BUILDING', 'MACHINERY') AND sample_id % 9 <> 0 AND site_code <> 3), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {md(42, 'sample_id')}) AS rn FROM e) SELECT stratum, sample_id FROM r WHERE rn <= CASE WHEN stratum = 'BUILDING' THEN 20 ELSE 7 END")
def stratified_pick(spark, sf):
    s = view(spark, sf, "v_sample")
    p = P.stratified_pick(s, ["sample_id"], "stratum", {"BUILDING": 20, "MACHINERY": 7}, 42, s.filter("sample_id % 9 = 0"), [s.filter("site_code <> 3")], ["bal"])
    return p.select("stratum", "sample_id")


@query(cte("v_sample") + f", e AS (SELECT DISTINCT CAST(sample_id AS STRING) AS sample_id FROM v_sample WHERE site_code % 2 = 0 AND stratum <> 'BUILDING'), r AS (SELECT *, row_number() OVER (ORDER BY {md(11, 'sample_id')}) AS rn FROM e WHERE sample_id NOT IN ('1', '2', '3')) SELECT sample_id FROM r WHERE rn <= 30")
def list_pick(spark, sf):
    s = view(spark, sf, "v_sample").withColumn("sample_id", F.col("sample_id").cast("string"))
    return P.pick_from_list(s, "sample_id", 30, 11, s.filter("stratum = 'BUILDING'"), [s.filter("site_code % 2 = 0")], ["1", "2", "3"])


@query(cte("v_gene") + "SELECT gene_id, concat('D', CAST(gstart % 9 AS STRING)) AS sample FROM v_gene WHERE gstart % 9 IN (2, 5)")
def rows_of_samples(spark, sf):
    g = view(spark, sf, "v_gene").withColumn("uid", F.concat(F.lit("D"), (F.col("gstart") % 9).cast("string"), F.lit("_"), "gene_id", F.lit("_Maternal")))
    ids = g.select(F.substring_index("uid", "_", 1).alias("sample")).filter("sample IN ('D2', 'D5')")
    return P.rows_of_samples(g, "uid", ids).select("gene_id", "sample")
