"""Queries over fine-mapping tables, matching, and metrics of labelled variant pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators import finemapping as M
from splicelake.operators import matching as G
from splicelake.operators import strata as T
from splicelake.operators.curves import ranking_metrics
from splicelake.operators.joins import labelled_pairs
from splicelake.plans.join_plans import LABELLED, PAIRED, _pairs_scores
from splicelake.plans.metric_plans import SQL_COLS, rounded, sql_metrics
from splicelake.plans.registry import query
from splicelake.plans.views import cte, view
from splicelake.session import written


def _v(spark, sf):
    return view(spark, sf, "v_variant")


@query(cte("v_variant") + "SELECT gene_id, max(pip) AS max_pip, CASE WHEN max(pip) >= 0.9 THEN 'positive' WHEN max(pip) < 0.01 THEN 'negative' ELSE 'between' END AS cls FROM v_variant GROUP BY gene_id")
def pip_classes(spark, sf):
    return M.pip_classes(_v(spark, sf), ["gene_id"])


@query(cte("v_variant") + "SELECT gene_id FROM v_variant WHERE pip >= 0.95 INTERSECT SELECT gene_id FROM v_variant WHERE pip < 0.05")
def key_set_intersect(spark, sf):
    v = _v(spark, sf)
    return v.filter("pip >= 0.95").select("gene_id").intersect(v.filter("pip < 0.05").select("gene_id"))


@query(cte("v_variant") + "SELECT gene_id FROM v_variant WHERE pip >= 0.8 EXCEPT SELECT gene_id FROM v_variant WHERE pip < 0.1")
def key_set_except(spark, sf):
    v = _v(spark, sf)
    return v.filter("pip >= 0.8").select("gene_id").subtract(v.filter("pip < 0.1").select("gene_id"))


@query(cte("v_variant") + "SELECT gene_id FROM v_variant WHERE pip >= 0.97 UNION SELECT gene_id FROM v_variant WHERE pip < 0.03")
def key_set_union(spark, sf):
    v = _v(spark, sf)
    return v.filter("pip >= 0.97").select("gene_id").unionByName(v.filter("pip < 0.03").select("gene_id")).distinct()


@query(cte("v_variant") + "SELECT tissue, cs_id, count(DISTINCT var_key) AS cs_size, max(pip) AS max_pip, round(sum(pip), 9) AS pip_sum FROM v_variant GROUP BY tissue, cs_id")
def credible_set_summary(spark, sf):
    return M.set_summary(_v(spark, sf)).withColumn("pip_sum", F.round("pip_sum", 9))


@query(cte("v_variant") + "SELECT tissue, count(*) AS n_rows, count(DISTINCT var_key) AS n_variants, count(DISTINCT gene_id) AS n_genes, count(*) FILTER (WHERE pip >= 0.9) AS n_high FROM v_variant GROUP BY tissue")
def tissue_summary(spark, sf):
    return M.tissue_summary(_v(spark, sf))


@query(cte("v_variant") + "SELECT tissue, count(*) AS n_rows, count(DISTINCT concat(region, pos)) AS n_variants, count(DISTINCT cs_id) AS n_traits, count(DISTINCT (concat(region, pos), cs_id)) AS n_pairs FROM v_variant GROUP BY tissue")
def summary_counts(spark, sf):
    v = _v(spark, sf).select("tissue", F.concat("region", F.col("pos").cast("string")).alias("var_key"), F.col("cs_id").alias("trait"))
    return M.summary_counts(v)


AMB = """, mb AS (SELECT tissue, cs_id, var_key, pip, pos, orderkey % 40 <> 0 AS is_snv, custkey % 1500 AS istart, custkey % 1500 + 900 AS iend, custkey % 7 <> 0 AS in_gene FROM v_variant),
fl AS (SELECT tissue, cs_id, max(pip) AS mp, count(*) AS n, bool_and(in_gene) AS g, bool_and(is_snv) AS s, bool_and(abs(pos - istart) <= 1900 AND abs(pos - iend) <= 1900) AS nr FROM mb GROUP BY tissue, cs_id)"""


def _amb(spark, sf):
    return _v(spark, sf).selectExpr("tissue", "cs_id", "var_key", "pip", "pos", "orderkey % 40 <> 0 AS is_snv", "custkey % 1500 AS istart", "custkey % 1500 + 900 AS iend", "custkey % 7 <> 0 AS in_gene")


@query(cte("v_variant") + AMB + " SELECT count(*) AS n_sets, count(*) FILTER (WHERE mp < 0.9) AS n_stage1, count(*) FILTER (WHERE mp < 0.9 AND n BETWEEN 2 AND 10) AS n_stage2, count(*) FILTER (WHERE mp < 0.9 AND n BETWEEN 2 AND 10 AND g) AS n_stage3, count(*) FILTER (WHERE mp < 0.9 AND n BETWEEN 2 AND 10 AND g AND s) AS n_stage4, count(*) FILTER (WHERE mp < 0.9 AND n BETWEEN 2 AND 10 AND g AND s AND nr) AS n_stage5 FROM fl")
def ambiguous_set_funnel(spark, sf):
    return M.ambiguous_funnel(M.ambiguous_sets(_amb(spark, sf), reach=1900))


@query(cte("v_variant") + ", r AS (SELECT *, row_number() OVER (PARTITION BY tissue, cs_id ORDER BY pip DESC, var_key DESC) AS k FROM v_variant) SELECT tissue, cs_id, count(*) AS n, max(pos) - min(pos) AS span, max(pip) AS max_pip, max(CASE WHEN k = 1 THEN var_key END) AS top_variant, max(CASE WHEN k = 2 THEN pip END) AS second_pip FROM r GROUP BY tissue, cs_id")
def credible_set_statistics(spark, sf):
    return M.set_statistics(_v(spark, sf))


@query(cte("v_variant") + ", s AS (SELECT tissue, cs_id, count(*) AS n FROM v_variant GROUP BY tissue, cs_id) SELECT n, count(*) AS n_sets FROM s GROUP BY n")
def credible_set_sizes(spark, sf):
    return M.size_distribution(M.set_statistics(_v(spark, sf)))


@query(cte("v_variant") + "SELECT gene_id AS var_key, string_agg(DISTINCT tissue, ',' ORDER BY tissue) AS tissues, count(DISTINCT tissue) AS n_tissues FROM v_variant GROUP BY gene_id")
def variant_tissues(spark, sf):
    return M.variant_tissues(_v(spark, sf).select(F.col("gene_id").alias("var_key"), "tissue"))


@query(cte("v_variant") + ", p AS (SELECT tissue, cs_id, min(var_key) AS positive_key FROM v_variant WHERE pip >= 0.9 AND status = 'F' GROUP BY ALL) SELECT v.tissue, v.cs_id, v.var_key, p.positive_key, (v.pip >= 0.9 AND v.status = 'F') AS is_positive FROM v_variant v JOIN p USING (tissue, cs_id)")
def credible_set_companions(spark, sf):
    v = _v(spark, sf)
    return M.companions(v, v.filter("pip >= 0.9 AND status = 'F'")).select("tissue", "cs_id", "var_key", "positive_key", "is_positive")


@query(cte("v_variant") + ", d AS (SELECT DISTINCT cs_id, tissue, gene_id FROM v_variant), s AS (SELECT cs_id, tissue, list_sort(list(gene_id)) AS m FROM d GROUP BY ALL), n AS (SELECT cs_id, count(DISTINCT gene_id) AS n_members FROM d GROUP BY cs_id) SELECT s.cs_id, count(*) AS n_tissues, n_members, count(DISTINCT m) = 1 AS same FROM s JOIN n USING (cs_id) GROUP BY s.cs_id, n_members")
def same_credible_sets(spark, sf):
    v = _v(spark, sf).select("cs_id", "tissue", F.col("gene_id").alias("var_key"))
    return M.same_members(v)


@query(cte("v_variant") + ", k AS (SELECT gene_id, tissue, bit_or(CASE WHEN status = 'F' THEN 1 WHEN status = 'O' THEN 2 ELSE 4 END) AS code FROM v_variant GROUP BY gene_id, tissue) SELECT tissue, code, count(*) AS n FROM k GROUP BY tissue, code")
def dataset_overlap(spark, sf):
    v = _v(spark, sf)
    sets = {s: v.filter(F.col("status") == s) for s in ("F", "O", "P")}
    return M.membership_codes(sets, ["gene_id", "tissue"]).groupBy("tissue", "code").agg(F.count("*").alias("n"))


def _scored(spark, sf):
    v = _v(spark, sf)
    heads = F.inline(F.array(F.struct(F.lit("a").alias("head"), (F.col("custkey") * 31 % 101 / 101).alias("score")), F.struct(F.lit("b").alias("head"), (F.col("orderkey") % 97 / 97).alias("score"))))
    return v.select("tissue", "cs_id", "var_key", "pip", heads)


SCORED = ", sd AS (SELECT tissue, cs_id, var_key, pip, 'a' AS head, custkey * 31 % 101 / 101 AS score FROM v_variant UNION ALL SELECT tissue, cs_id, var_key, pip, 'b', orderkey % 97 / 97 FROM v_variant)"


@query(cte("v_variant") + SCORED + ", t AS (SELECT tissue, cs_id, head, count(*) AS n, first(var_key ORDER BY pip DESC, var_key) = first(var_key ORDER BY score DESC, var_key) AS match FROM sd GROUP BY tissue, cs_id, head HAVING count(*) >= 2) SELECT head, n, count(*) AS n_sets, round(avg(CASE WHEN match THEN 1 ELSE 0 END), 6) AS agreement FROM t GROUP BY head, n")
def top_agreement(spark, sf):
    t = M.top_agreement(_scored(spark, sf))
    return t.groupBy("head", "n").agg(F.count("*").alias("n_sets"), F.round(F.avg(F.col("match").cast("int")), 6).alias("agreement"))


@query(cte("v_variant") + SCORED + ", c AS (SELECT tissue, cs_id, head, count(*) AS n, count(*) FILTER (WHERE score >= CASE WHEN head = 'a' THEN 0.9 ELSE 0.8 END) AS nc FROM sd GROUP BY ALL) SELECT head, n, count(*) AS n_sets, " + ", ".join(f"round(avg(CASE WHEN {c} THEN 1 ELSE 0 END), 6) AS {a}" for c, a in (("nc = 0", "p0"), ("nc = 1", "p1"), ("nc = 2", "p2"), ("nc >= 3", "p3plus"))) + " FROM c GROUP BY head, n")
def call_distribution(spark, sf):
    c = M.call_distribution(M.calls_per_set(_scored(spark, sf), {"a": 0.9, "b": 0.8}), ["head", "n"])
    return rounded(c, ["p0", "p1", "p2", "p3plus"])


@query(cte("v_variant") + SCORED + """, lb AS (SELECT head, score, CASE WHEN var_key = first_value(var_key) OVER (PARTITION BY tissue, cs_id, head ORDER BY pip DESC, var_key) THEN 1 ELSE 0 END AS label FROM sd),
e AS (SELECT head, quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi, sum(label) AS np FROM lb GROUP BY head), i AS (SELECT lb.head, label, CASE WHEN score < lo THEN 0 WHEN score >= hi THEN 50 ELSE floor((score - lo) / ((hi - lo) / 49)) + 1 END AS i FROM lb JOIN e USING (head))
SELECT e.head, CAST(t AS INT) AS t, round(lo + t * ((hi - lo) / 49), 6) AS threshold, round(sum(label) / count(*), 6) AS "precision", round(sum(label) / max(np), 6) AS recall FROM i JOIN e USING (head) JOIN (SELECT unnest(range(50)) AS t) x ON t < i.i GROUP BY e.head, t, lo, hi""")
def threshold_sweep(spark, sf):
    d = _scored(spark, sf)
    top = M.top_agreement(d).select("tissue", "cs_id", "head", F.col("by_pip").alias("_b"))
    from splicelake.operators.ordered import lookup

    single = lookup(d, top, ["tissue", "cs_id", "head"], "left")
    lab = single.withColumn("label", (F.col("_b").isNull() | (F.col("_b") == F.col("var_key"))).cast("int"))
    return rounded(T.threshold_sweep(lab, ["head"], 50), ["threshold", "precision", "recall"])


def _labelled(spark, sf):
    pairs, scores = _pairs_scores(spark, sf)
    return labelled_pairs(pairs, scores)


PT = cte("v_variant") + PAIRED + LABELLED + sql_metrics("lb", "tissue, head") + ", pt AS (SELECT * FROM mt WHERE n_pos >= 10)"


@query(PT + f" SELECT tissue, head, {SQL_COLS} FROM pt")
def tissue_metrics(spark, sf):
    return rounded(T.per_tissue(_labelled(spark, sf)))


@query(PT + " SELECT head, round(median(pr_area), 6) AS median_pr_area, round(median(auroc), 6) AS median_auroc, median(youden_threshold) AS median_threshold, count(*) AS n_tissues FROM pt GROUP BY head")
def tissue_medians(spark, sf):
    return rounded(T.tissue_medians(T.per_tissue(_labelled(spark, sf))), ["median_pr_area", "median_auroc"])


@query(cte("v_variant") + PAIRED + LABELLED + sql_metrics("lb", "head") + f" SELECT head, {SQL_COLS} FROM mt")
def pooled_pair_metrics(spark, sf):
    return rounded(ranking_metrics(_labelled(spark, sf), ["head"]))


@query(cte("v_variant") + ", pr AS (SELECT tissue, gene_id AS p, cs_id AS n FROM v_variant WHERE pip > 0.9), x AS (SELECT 'p' AS s, tissue, p AS k FROM pr UNION SELECT 'n', tissue, n FROM pr), c AS (SELECT s, k, count(*) AS c FROM x GROUP BY s, k), y AS (SELECT x.*, c FROM x JOIN c USING (s, k)) SELECT tissue, " + ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS n_{n}, count(*) FILTER (WHERE s = '{s}' AND c > 1) AS n_{n}_shared, count(*) FILTER (WHERE s = '{s}' AND c = 1) AS n_{n}_unique" for s, n in (("p", "pos"), ("n", "neg"))) + " FROM y GROUP BY tissue")
def tissue_pair_counts(spark, sf):
    return T.tissue_counts(_v(spark, sf).filter("pip > 0.9").selectExpr("tissue", "gene_id AS pos_var_key", "cs_id AS neg_var_key"))


def _thr(values):
    return "(SELECT unnest([" + ", ".join(f"{float(v)}" for v in values) + "]::DOUBLE[]) AS threshold)"


DIST = (50, 100, 200, 500, 2000, 10000)


@query(cte("v_variant") + PAIRED + LABELLED + f", lt AS (SELECT lb.*, threshold FROM lb JOIN {_thr(DIST)} t ON CAST(substring(pos_var_key, 2) AS INT) % 3000 <= threshold)" + sql_metrics("lt", "tissue, head, threshold") + " SELECT head, threshold, round(median(pr_area), 6) AS median_pr_area, count(*) AS n_tissues FROM mt WHERE n_pos >= 10 GROUP BY head, threshold")
def metrics_by_distance(spark, sf):
    d = F.substring("pos_var_key", 2, 20).cast("int") % 3000
    m = T.cumulative_metrics(_labelled(spark, sf), d, DIST, ["tissue", "head"])
    return T.tissue_medians(m, ["head", "threshold"]).select("head", "threshold", F.round("median_pr_area", 6).alias("median_pr_area"), "n_tissues")


@query(cte("v_variant") + PAIRED + LABELLED + f", lu AS (SELECT DISTINCT head, label, var_key, score FROM lb), lt AS (SELECT lu.*, threshold FROM lu JOIN {_thr(DIST)} t ON CAST(substring(var_key, 2) AS INT) % 3000 <= threshold)" + sql_metrics("lt", "head, threshold") + f" SELECT head, threshold, {SQL_COLS} FROM mt WHERE n_pos >= 10")
def unique_metrics_by_distance(spark, sf):
    u = _labelled(spark, sf).select("head", "label", "var_key", "score").distinct()
    d = F.substring("var_key", 2, 20).cast("int") % 3000
    return rounded(T.cumulative_metrics(u, d, DIST, ["head"]))


FRACTION = ", tf AS (SELECT gene_id, count(DISTINCT CASE WHEN pip >= 0.9 THEN tissue END) / count(DISTINCT tissue) AS fraction, count(DISTINCT CASE WHEN pip >= 0.9 THEN tissue END) AS np, count(DISTINCT tissue) AS nt FROM v_variant GROUP BY gene_id HAVING count(DISTINCT CASE WHEN pip >= 0.9 THEN tissue END) > 0)"


def _fraction(spark, sf):
    v = _v(spark, sf).withColumn("var_key", F.col("gene_id"))
    return T.tissue_fraction(v.filter("pip >= 0.9"), v)


@query(cte("v_variant") + FRACTION + " SELECT gene_id AS var_key, np AS n_pos_tissues, nt AS n_tested, round(fraction, 6) AS fraction FROM tf")
def tissue_fraction(spark, sf):
    return rounded(_fraction(spark, sf), ["fraction"])


FR = (0.2, 0.4, 0.6, 0.8, 1.0)


@query(cte("v_variant") + PAIRED + LABELLED + FRACTION + f", lf AS (SELECT lb.*, fraction FROM lb JOIN v_variant v ON v.var_key = lb.pos_var_key JOIN tf ON tf.gene_id = v.gene_id), lt AS (SELECT lf.*, threshold FROM lf JOIN {_thr(FR)} t ON fraction <= threshold)" + sql_metrics("lt", "head, threshold") + f" SELECT head, threshold, {SQL_COLS} FROM mt WHERE n_pos >= 10")
def metrics_by_tissue_fraction(spark, sf):
    gene = _v(spark, sf).select(F.col("var_key").alias("pos_var_key"), "gene_id")
    lf = _labelled(spark, sf).join(gene, "pos_var_key").join(_fraction(spark, sf).select(F.col("var_key").alias("gene_id"), "fraction"), "gene_id")
    return rounded(T.cumulative_metrics(lf, F.col("fraction"), FR, ["head"]))


@query(PT + FRACTION + ", sh AS (SELECT p.tissue, avg(CASE WHEN fraction = 1 THEN 1 ELSE 0 END) AS share FROM v_variant p JOIN tf ON tf.gene_id = p.gene_id WHERE pip >= 0.9 GROUP BY p.tissue) SELECT pt.tissue, head, round(pr_area, 6) AS pr_area, round(share, 6) AS share_full FROM pt JOIN sh USING (tissue)")
def metrics_against_shared_positives(spark, sf):
    p = _v(spark, sf).filter("pip >= 0.9").join(_fraction(spark, sf).select(F.col("var_key").alias("gene_id"), "fraction"), "gene_id")
    share = p.groupBy("tissue").agg(F.round(F.avg((F.col("fraction") == 1).cast("int")), 6).alias("share_full"))
    return T.per_tissue(_labelled(spark, sf)).join(share, "tissue").select("tissue", "head", F.round("pr_area", 6).alias("pr_area"), "share_full")


PIPS = (0.9, 0.92, 0.94, 0.96, 0.98)


@query(cte("v_variant") + PAIRED + LABELLED + f", lt AS (SELECT lb.*, threshold FROM lb JOIN {_thr(PIPS)} t ON pos_pip >= threshold)" + sql_metrics("lt", "head, threshold") + f" SELECT head, threshold, {SQL_COLS} FROM mt WHERE n_pos >= 10")
def metrics_by_pip(spark, sf):
    return rounded(T.cumulative_metrics(_labelled(spark, sf), F.col("pos_pip"), PIPS, ["head"], at_least=True))


IDEAL = PAIRED.replace("AS neg_var_key, pip AS pos_pip", "AS neg_var_key, concat('V', CAST(orderkey + CASE WHEN custkey % 3 = 0 THEN 8 ELSE 7 END AS STRING)) AS neg_var_key_ideal, pip AS pos_pip")


@query(cte("v_variant") + IDEAL + """, kd AS (SELECT tissue, pos_var_key, neg_var_key, 'actual' AS negatives, pos_pip FROM pr UNION ALL SELECT tissue, pos_var_key, neg_var_key_ideal, 'ideal', pos_pip FROM pr), lp AS (SELECT kd.*, p.head, p.score AS ps, n.score AS ns FROM kd JOIN sc p ON p.var_key = kd.pos_var_key JOIN sc n ON n.var_key = kd.neg_var_key AND n.head = p.head WHERE p.score IS NOT NULL AND n.score IS NOT NULL),
lb AS (SELECT negatives, head, 1 AS label, ps AS score, pos_pip FROM lp UNION ALL SELECT negatives, head, 0, ns, pos_pip FROM lp)""" + f", lt AS (SELECT lb.*, threshold FROM lb JOIN {_thr(PIPS)} t ON pos_pip >= threshold)" + sql_metrics("lt", "negatives, head, threshold") + f" SELECT negatives, head, threshold, {SQL_COLS} FROM mt WHERE n_pos >= 10")
def metrics_by_pip_and_negatives(spark, sf):
    """Metrics by smallest PIP against the matched negatives and against the ideal ones."""
    _, scores = _pairs_scores(spark, sf)
    v = _v(spark, sf).filter("pip >= 0.9").selectExpr("tissue", "var_key AS pos_var_key", "concat('V', CAST(orderkey + 7 AS STRING)) AS actual", "concat('V', CAST(orderkey + CASE WHEN custkey % 3 = 0 THEN 8 ELSE 7 END AS STRING)) AS ideal", "pip AS pos_pip")
    both = v.unpivot(["tissue", "pos_var_key", "pos_pip"], ["actual", "ideal"], "negatives", "neg_var_key")
    return rounded(T.cumulative_metrics(labelled_pairs(both, scores), F.col("pos_pip"), PIPS, ["negatives", "head"], at_least=True))


@query(cte("v_variant") + PAIRED + f""", sd AS (SELECT DISTINCT tissue, pos_var_key AS var_key, 1 AS label FROM pr UNION ALL SELECT DISTINCT tissue, neg_var_key, 0 FROM pr), lt AS (SELECT sd.*, head, score, threshold FROM sd JOIN sc USING (var_key) JOIN (SELECT var_key, custkey % 3000 AS dist FROM v_variant) g USING (var_key) JOIN {_thr(DIST)} t ON dist <= threshold WHERE score IS NOT NULL)"""
    + sql_metrics("lt", "tissue, head, threshold") + " SELECT head, threshold, round(median(pr_area), 6) AS median_pr_area, count(*) AS n_tissues FROM mt WHERE n_pos >= 10 AND n_neg >= 10 GROUP BY head, threshold")
def independent_metrics_by_distance(spark, sf):
    """Positives and negatives cut each by their own distance, then the median over tissues."""
    pairs, scores = _pairs_scores(spark, sf)
    m = T.independent_cumulative(pairs, scores, _v(spark, sf).selectExpr("var_key", "custkey % 3000 AS splice_dist"), DIST)
    return T.tissue_medians(m, ["head", "threshold"]).select("head", "threshold", F.round("median_pr_area", 6).alias("median_pr_area"), "n_tissues")


OFF = ", of AS (SELECT var_key, 'a' AS head, custkey % 41 - 20 AS off FROM v_variant UNION ALL SELECT var_key, 'b', orderkey % 41 - 20 FROM v_variant UNION ALL SELECT var_key, 'c', custkey % 2300 - 1000 FROM v_variant)"


def _offsets(spark, sf):
    o = lambda h, e: F.struct(F.lit(h).alias("head"), F.expr(e).alias("offset"))
    return _v(spark, sf).select("var_key", F.inline(F.array(o("a", "custkey % 41 - 20"), o("b", "orderkey % 41 - 20"), o("c", "custkey % 2300 - 1000"))))


@query(cte("v_variant") + OFF + " SELECT head, round(median(abs(off)), 6) AS median_offset, round(avg(CASE WHEN abs(off) <= 10 THEN 1 ELSE 0 END), 6) AS share_near, count(*) AS n FROM of GROUP BY head")
def offset_summary(spark, sf):
    return rounded(T.offset_summary(_offsets(spark, sf)), ["median_offset", "share_near"])


@query(cte("v_variant") + PAIRED + LABELLED + OFF + ", lo AS (SELECT lb.*, CASE WHEN abs(off) < 1 THEN 0 WHEN abs(off) < 10 THEN 1 WHEN abs(off) < 100 THEN 2 WHEN abs(off) < 1000 THEN 3 ELSE 4 END AS bin FROM lb JOIN of ON of.var_key = lb.pos_var_key AND of.head = lb.head)" + sql_metrics("lo", "head, bin") + f" SELECT head, bin, {SQL_COLS} FROM mt WHERE n_pos >= 10")
def metrics_by_offset(spark, sf):
    o = _offsets(spark, sf).withColumnRenamed("var_key", "pos_var_key")
    lo = _labelled(spark, sf).join(o, ["pos_var_key", "head"]).withColumn("bin", T.offset_bin(F.col("offset")))
    return rounded(T.per_tissue(lo, ["head", "bin"]))


@query(cte("v_variant") + OFF + """, p AS (SELECT x.head AS head_a, y.head AS head_b, x.off AS a, y.off AS b FROM of x JOIN of y ON x.var_key = y.var_key AND x.head < y.head), r AS (SELECT *, rank() OVER (PARTITION BY head_a, head_b ORDER BY a) + (count(*) OVER (PARTITION BY head_a, head_b, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY head_a, head_b ORDER BY b) + (count(*) OVER (PARTITION BY head_a, head_b, b) - 1) / 2 AS rb FROM p)
SELECT head_a, head_b, round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 6) AS equal_rate, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY head_a, head_b""")
def offset_concordance(spark, sf):
    return rounded(T.concordance(_offsets(spark, sf), ["var_key"], "offset", ["a", "b", "c"]), ["equal_rate", "spearman"])


@query(PT + ", o AS (SELECT tissue, max(CASE WHEN head = 'a' THEN pr_area END) AS m, max(CASE WHEN head <> 'a' THEN pr_area END) AS b, arg_max(head, pr_area) FILTER (WHERE head <> 'a') AS best_head FROM pt GROUP BY tissue) SELECT tissue, round(m, 6) AS matched, round(b, 6) AS best_other, best_head, m > b AS matched_wins FROM o")
def matched_head(spark, sf):
    return rounded(T.matched_head(T.per_tissue(_labelled(spark, sf)), F.col("head") == "a"), ["matched", "best_other"])


@query(cte("v_variant") + "SELECT cs_id, count(*) AS n FROM v_variant WHERE pip > 0.9 GROUP BY cs_id ORDER BY n DESC, cs_id LIMIT 5")
def most_common_values(spark, sf):
    return T.most_common(_v(spark, sf).filter("pip > 0.9"), "cs_id", 5)


@query(PT + ", b AS (SELECT *, max(pr_area) OVER (PARTITION BY tissue) - pr_area AS d FROM pt) SELECT head, count(*) FILTER (WHERE d <= 0.02) AS n_wins, round(avg(d), 6) AS mean_deficit FROM b GROUP BY head")
def head_wins(spark, sf):
    return rounded(T.wins(T.per_tissue(_labelled(spark, sf))), ["mean_deficit"])


@query(cte("v_variant") + PAIRED + ", w AS (SELECT pr.*, pa.score - na.score AS ma, pb.score - nb.score AS mb FROM pr JOIN sc pa ON pa.var_key = pos_var_key AND pa.head = 'a' JOIN sc na ON na.var_key = neg_var_key AND na.head = 'a' JOIN sc pb ON pb.var_key = pos_var_key AND pb.head = 'b' JOIN sc nb ON nb.var_key = neg_var_key AND nb.head = 'b') SELECT tissue, CASE WHEN ma > 0 AND mb > 0 THEN 'both_win' WHEN ma > 0 THEN 'a_rescue' WHEN mb > 0 THEN 'b_rescue' ELSE 'both_fail' END AS quadrant, count(*) AS n, round(avg(ma), 6) AS mean_a FROM w WHERE ma IS NOT NULL AND mb IS NOT NULL GROUP BY 1, 2")
def pair_margins(spark, sf):
    pairs, scores = _pairs_scores(spark, sf)
    m = T.margins(pairs, scores, "a", "b")
    return m.groupBy("tissue", "quadrant").agg(F.count("*").alias("n"), F.round(F.avg("margin_a"), 6).alias("mean_a"))


@query(PT + """, lm AS (SELECT tissue, head, CASE WHEN head = 'a' THEN 'x' ELSE 'y' END AS family, pr_area AS value FROM pt), r AS (SELECT *, row_number() OVER (PARTITION BY tissue ORDER BY value DESC, head) AS ro, row_number() OVER (PARTITION BY tissue, family ORDER BY value DESC, head) AS rf FROM lm)
SELECT tissue, 'all' AS family, head, round(value, 6) AS value FROM r WHERE ro = 1 UNION ALL SELECT tissue, family, head, round(value, 6) FROM r WHERE rf = 1""")
def best_heads(spark, sf):
    m = T.per_tissue(_labelled(spark, sf)).select("tissue", "head", F.when(F.col("head") == "a", "x").otherwise("y").alias("family"), F.col("pr_area").alias("value"))
    return rounded(T.best_heads(m, ["tissue"]), ["value"])


@query(cte("v_variant") + PAIRED + LABELLED + ", cd AS (SELECT gene_id, bit_or(CASE WHEN status = 'F' THEN 1 ELSE 2 END) AS code FROM v_variant WHERE pip >= 0.9 GROUP BY gene_id), lc AS (SELECT lb.*, CASE WHEN code = 3 THEN 'shared' ELSE 'exclusive' END AS origin FROM lb JOIN v_variant v ON v.var_key = pos_var_key JOIN cd ON cd.gene_id = v.gene_id)" + sql_metrics("lc", "tissue, head, origin") + f" SELECT tissue, head, origin, {SQL_COLS} FROM mt WHERE n_pos >= 100")
def metrics_by_overlap(spark, sf):
    v = _v(spark, sf).filter("pip >= 0.9")
    code = M.membership_codes({"f": v.filter("status = 'F'"), "o": v.filter("status <> 'F'")}, ["gene_id"])
    tag = v.join(code, "gene_id").select(F.col("var_key").alias("pos_var_key"), F.when(F.col("code") == 3, "shared").otherwise("exclusive").alias("origin"))
    return rounded(T.per_tissue(_labelled(spark, sf).join(tag, "pos_var_key"), ["tissue", "head", "origin"], 100))


@query(cte("v_variant") + ", u AS (SELECT gene_id, count(*) AS n FROM v_variant WHERE pip >= 0.9 AND orderkey % 3 <> 0 GROUP BY gene_id) SELECT u.gene_id, n AS n_unmatched, EXISTS (SELECT 1 FROM v_variant x WHERE x.gene_id = u.gene_id AND x.pip < 0.05) AS has_negative FROM u")
def unmatched_positives(spark, sf):
    v = _v(spark, sf)
    pos = v.filter("pip >= 0.9")
    return T.unmatched_positives(pos, pos.filter("orderkey % 3 = 0").withColumnRenamed("var_key", "pos_var_key"), v.filter("pip < 0.05"))


def _match_inputs(spark, sf):
    """Positives and negatives with expression bins; a fifth of the genes has no bin."""
    g = view(spark, sf, "v_gene").select("gene_id", F.when(F.col("gstart") % 5 != 0, S.expression_bin(F.col("tpm") - 890)).alias("bin"))
    v = _v(spark, sf).withColumn("splice_dist", (F.col("orderkey") * 7919 % 1500).cast("long")).join(g, "gene_id", "left")
    cols = ["tissue", "var_key", "gene_id", "ref", "alt", "splice_dist", "bin"]
    return v.filter("pip >= 0.9").select(*cols, "pip"), v.filter("pip < 0.6").select(*cols)


@query()
def tiered_matches(spark, sf):
    return G.tiered_matches(*_match_inputs(spark, sf), max_diff=500).drop("ideal_tier")


MATCH = """, gb AS (SELECT gene_id, CASE WHEN gstart % 5 <> 0 THEN CAST(floor(CASE WHEN tpm - 890 > 0 THEN log2(tpm - 890) ELSE -10 END / 0.4) AS INT) END AS bin FROM v_gene),
mv AS (SELECT v.*, orderkey * 7919 % 1500 AS d, bin FROM v_variant v LEFT JOIN gb USING (gene_id)), mp AS (SELECT * FROM mv WHERE pip >= 0.9), mn AS (SELECT * FROM mv WHERE pip < 0.6),
ca AS (SELECT p.tissue, p.var_key AS pk, n.var_key AS nk, abs(p.d - n.d) AS df, CASE WHEN n.gene_id = p.gene_id AND n.ref = p.ref AND n.alt = p.alt THEN 1 WHEN n.gene_id = p.gene_id THEN 2 WHEN n.ref = p.ref AND n.alt = p.alt THEN 3 ELSE 4 END AS tier FROM mp p JOIN mn n ON n.tissue = p.tissue AND (n.gene_id = p.gene_id OR n.bin = p.bin)),
id AS (SELECT tissue, pk, arg_min(nk, (tier, df, md5(nk))) AS ideal, min(tier) AS tier FROM ca WHERE df <= 500 GROUP BY tissue, pk)"""


@query(cte("v_gene", "v_variant") + MATCH + " SELECT p.tissue, p.var_key AS pos_var_key, id.ideal AS neg_var_key_ideal, id.tier AS ideal_tier FROM mp p LEFT JOIN id ON id.pk = p.var_key AND id.tissue = p.tissue")
def ideal_matches(spark, sf):
    m = G.tiered_matches(*_match_inputs(spark, sf), max_diff=500)
    return m.select("tissue", "pos_var_key", F.when(F.col("ideal_tier").isNotNull(), F.col("neg_var_key_ideal")).alias("neg_var_key_ideal"), "ideal_tier")


@query()
def optimal_matches(spark, sf):
    return G.optimal_matches(*_match_inputs(spark, sf), max_diff=500).drop("ideal_tier")


@query()
def match_report(spark, sf):
    return G.match_report(G.tiered_matches(*_match_inputs(spark, sf), max_diff=500))


@query()
def match_quality(spark, sf):
    return G.match_quality(G.tiered_matches(*_match_inputs(spark, sf), max_diff=500), ["tissue"])


@query()
def matching_scheme_comparison(spark, sf):
    """Median PR area per head under tiered and under optimal matching."""
    pos, neg = _match_inputs(spark, sf)
    _, scores = _pairs_scores(spark, sf)
    # the metrics take several passes, none of which should match again
    pairs = lambda m: written(G.matched_only(m).select("tissue", "pos_var_key", "neg_var_key"), "matched")
    med = lambda m: T.tissue_medians(T.per_tissue(written(labelled_pairs(pairs(m), scores), "labelled")))
    return T.scheme_comparison(med(G.tiered_matches(pos, neg)), med(G.optimal_matches(pos, neg)))


@query(cte("v_variant") + "SELECT gene_id, var_key, pos FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY pip DESC, var_key) AS rn FROM v_variant) t WHERE rn = 1")
def strongest_variant(spark, sf):
    """The variant with the largest pip of each gene."""
    v = _v(spark, sf).withColumn("pip", F.col("pip").cast("double"))
    return M.first_per_key(v, ["gene_id"], [("pip", False)], "var_key").select("gene_id", "var_key", "pos")
