"""Queries over prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators import curves as C
from splicelake.operators import evaluation as V
from splicelake.plans.registry import query
from splicelake.plans.views import cte, table, view


def sql_metrics(src: str, by: str, score: str = "score", label: str = "label", w: str = "1") -> str:
    """CTEs that end in ``mt`` with all ranking metrics per group, written with plain windows."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f""", cg AS (SELECT {b}{score} AS s, sum(CASE WHEN {label} > 0 THEN {w} ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN {label} > 0 THEN 0 ELSE {w} END)::DOUBLE AS n FROM {src} WHERE {score} IS NOT NULL GROUP BY {b}{score}),
cc AS (SELECT *, sum(p) OVER (W ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (W ROWS UNBOUNDED PRECEDING) AS fp, sum(p) OVER ({part}) AS np, sum(n) OVER ({part}) AS nn FROM cg WINDOW W AS ({part}ORDER BY s DESC)),
mt AS (SELECT {b}CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(n * (tp - p / 2)) / (max(np) * max(nn)) END AS auroc,
 CASE WHEN max(np) > 0 THEN sum(p * tp / (tp + fp)) / max(np) END AS avg_precision, CASE WHEN max(np) > 0 THEN sum(p * (tp / (tp + fp) + CASE WHEN tp - p + fp - n > 0 THEN (tp - p) / (tp - p + fp - n) ELSE 1 END) / 2) / max(np) END AS pr_area,
 CASE WHEN max(np) > 0 THEN max(2 * tp / (np + tp + fp)) END AS f1_max, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN arg_max(s, (tp / np - fp / nn, s)) END AS youden_threshold FROM cc{' GROUP BY ' + by if by else ''})"""


METRIC_COLS = ["auroc", "avg_precision", "pr_area", "f1_max"]
SQL_COLS = "n_pos, n_neg, " + ", ".join(f"round({c}, 6) AS {c}" for c in METRIC_COLS) + ", youden_threshold"


def rounded(df, cols=METRIC_COLS):
    # means of short decimals often end in a 5 at the seventh digit, so error means keep eleven
    return df.withColumns({c: F.round(c, 11 if c in ("mse", "mae") else 6) for c in cols})


@query(cte("v_label_score") + sql_metrics("v_label_score", "stratum") + f" SELECT stratum, {SQL_COLS} FROM mt")
def ranking_metrics(spark, sf):
    return rounded(C.ranking_metrics(view(spark, sf, "v_label_score"), ["stratum"]))


@query(cte("v_pred") + ", lg AS (SELECT sample, 'head_a' AS head, head_a AS score, y_acceptor AS label FROM v_pred UNION ALL SELECT sample, 'head_b', head_b, y_acceptor FROM v_pred)" + sql_metrics("lg", "sample, head") + f" SELECT sample, head, {SQL_COLS} FROM mt")
def ranking_metrics_by_head(spark, sf):
    d = V.unpivot_heads(view(spark, sf, "v_pred").withColumnRenamed("y_acceptor", "label"), ["head_a", "head_b"], ["sample", "label"])
    return rounded(C.ranking_metrics(d, ["sample", "head"]))


@query(cte("v_pred") + """, g AS (SELECT sample, y_acceptor AS y, head_a AS s, row_number() OVER (PARTITION BY sample ORDER BY head_a DESC, md5(concat_ws(':', '0', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)))) AS rn, sum(y_acceptor) OVER (PARTITION BY sample) AS np, count(*) OVER (PARTITION BY sample) AS n FROM v_pred),
k AS (SELECT sample, f AS factor, CAST(least(floor(f * max(np)), max(n)) AS BIGINT) AS k, max(np) AS np FROM g CROSS JOIN (SELECT unnest([0.5, 1.0, 2.0, 4.0]) AS f) GROUP BY sample, f)
SELECT k.sample, CAST(factor AS DOUBLE) AS factor, k, CAST(sum(y) AS BIGINT) AS hits, round(sum(y) / least(k, max(k.np)), 6) AS accuracy, min(s) AS threshold FROM k JOIN g ON g.sample = k.sample AND g.rn <= k.k GROUP BY k.sample, factor, k""")
def top_k_accuracy(spark, sf):
    v = view(spark, sf, "v_pred")
    t = C.top_k(v, ["sample"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], (0.5, 1.0, 2.0, 4.0), "head_a", "y_acceptor")
    return t.withColumn("accuracy", F.round("accuracy", 6))


REG = "count(*) AS n, round(CASE WHEN stddev_pop({t}) > 0 AND stddev_pop({p}) > 0 THEN covar_pop({t}, {p}) / (stddev_pop({t}) * stddev_pop({p})) END, 6) AS pearson, round(CASE WHEN var_pop({t}) > 0 THEN 1 - sum(({t} - {p}) * ({t} - {p})) / (var_pop({t}) * count(*)) END, 6) AS r2, round(avg(({t} - {p}) * ({t} - {p})), 11) AS mse, round(avg(abs({t} - {p})), 11) AS mae"
REG_COLS = ["pearson", "r2", "mse", "mae"]


def sql_reg(t, p):
    return REG.format(t=t, p=p)


@query(cte("v_pred") + f"SELECT sample, {sql_reg('y_ssu', 'head_b')} FROM v_pred WHERE y_ssu <> 777 GROUP BY sample")
def regression_metrics(spark, sf):
    v = view(spark, sf, "v_pred").withColumn("ssu", S.from_sentinel(F.col("y_ssu")))
    return rounded(C.regression_metrics(v, ["sample"], "ssu", "head_b"), REG_COLS)


@query(cte("v_pred") + """, v AS (SELECT * FROM v_pred WHERE y_ssu <> 777), r AS (SELECT sample, rank() OVER (PARTITION BY sample ORDER BY y_ssu) + (count(*) OVER (PARTITION BY sample, y_ssu) - 1) / 2 AS a, rank() OVER (PARTITION BY sample ORDER BY head_a) + (count(*) OVER (PARTITION BY sample, head_a) - 1) / 2 AS b FROM v) SELECT sample, round(corr(a, b), 6) AS spearman FROM r GROUP BY sample""")
def spearman_by_sample(spark, sf):
    v = view(spark, sf, "v_pred").withColumn("ssu", S.from_sentinel(F.col("y_ssu")))
    return rounded(C.spearman(v, ["sample"], "ssu", "head_a"), ["spearman"])


_PRED_KEY = "concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))"


@query(cte("v_pred") + f", v AS (SELECT sample, y_ssu, head_a, md5({_PRED_KEY}) AS k FROM v_pred WHERE y_ssu <> 777), r AS (SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY y_ssu, k) AS a, row_number() OVER (PARTITION BY sample ORDER BY head_a, k) AS b FROM v) SELECT sample, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY sample")
def ordinal_spearman_by_sample(spark, sf):
    """Ordinal ranks: equal values one after the other, in the order of the row keys' hashes."""
    v = view(spark, sf, "v_pred").select("sample", S.from_sentinel(F.col("y_ssu")).alias("ssu"), "head_a", F.md5(F.expr(_PRED_KEY)).alias("k"))
    return rounded(C.ordinal_spearman(v, ["sample"], "ssu", "head_a", "k"), ["spearman"])


@query(cte("v_pred") + "SELECT sample, round(median(abs(y_ssu - head_b)), 6) AS median_ae FROM v_pred WHERE y_ssu <> 777 GROUP BY sample")
def median_absolute_error(spark, sf):
    v = view(spark, sf, "v_pred").withColumn("ae", F.abs(S.from_sentinel(F.col("y_ssu")) - F.col("head_b")))
    return rounded(V.medians(v, ["sample"], "ae", "median_ae"), ["median_ae"])


DELTA = "WITH d AS (SELECT l_discount * 10 AS pop, (l_quantity - 25) / 50 AS td, l_tax * 5 AS pd, l_returnflag <> 'N' AS site FROM lineitem), e AS (SELECT pop - td AS t, pop - pd AS p, site, abs(td) > 0.1 AS ch FROM d), x AS (SELECT 'all' AS subset, t, p FROM e UNION ALL SELECT 'splice', t, p FROM e WHERE site UNION ALL SELECT 'changed', t, p FROM e WHERE site AND ch UNION ALL SELECT 'changed_used', t, p FROM e WHERE site AND ch AND abs(t) > 0)"


@query(DELTA + f" SELECT subset, {sql_reg('t', 'p')}, round(var_pop(t), 6) AS variance FROM x GROUP BY subset")
def delta_statistics(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("l_discount * 10 AS pop", "(l_quantity - 25) / 50 AS td", "l_tax * 5 AS pd", "l_returnflag <> 'N' AS site")
    return rounded(V.delta_subsets(d, "pop", "td", "pd", F.col("site")), [*REG_COLS, "variance"])


SUBSETS = """, sh AS (SELECT region, pos FROM v_pred GROUP BY region, pos HAVING bool_and(y_ssu <> 777)), b AS (SELECT v.*, sh.pos IS NOT NULL AS shared, y_ssu <> 777 AS valid FROM v_pred v LEFT JOIN sh USING (region, pos)),
su AS (SELECT unnest(['all', 'ssu_valid', 'ssu_valid_nonzero', 'ssu_shared', 'ssu_shared_nonzero']) AS subset),
mem AS (SELECT b.*, subset, CASE subset WHEN 'all' THEN true WHEN 'ssu_valid' THEN valid WHEN 'ssu_valid_nonzero' THEN valid AND y_ssu > 0 WHEN 'ssu_shared' THEN shared ELSE shared AND valid AND y_ssu > 0 END AS mem FROM b CROSS JOIN su),
tg AS (SELECT subset, 'acceptor' AS target, y_acceptor AS label, head_a, head_b FROM mem WHERE (y_acceptor = 1 AND mem) OR (y_acceptor = 0 AND y_donor = 0) UNION ALL SELECT subset, 'donor', y_donor, head_a, head_b FROM mem WHERE (y_donor = 1 AND mem) OR (y_acceptor = 0 AND y_donor = 0)),
lg AS (SELECT subset, target, 'head_a' AS head, label, head_a AS score FROM tg WHERE target = 'acceptor' UNION ALL SELECT subset, target, 'head_b', label, head_b FROM tg)"""


def _shared(spark, sf):
    from splicelake.operators.joins import shared_sites, with_membership

    v = view(spark, sf, "v_pred").withColumn("ssu", S.from_sentinel(F.col("y_ssu")))
    return with_membership(v, shared_sites(v, ["region", "pos"]), ["region", "pos"], "shared")


@query(cte("v_pred") + SUBSETS + sql_metrics("lg", "subset, target, head") + f" SELECT subset, target, head, {SQL_COLS} FROM mt")
def metrics_by_subset(spark, sf):
    m = V.classification_metrics(_shared(spark, sf), ["head_a", "head_b"], {"acceptor": "y_acceptor", "donor": "y_donor"}, {"head_a": "acceptor"}, "shared")
    return rounded(m)


@query(cte("v_pred") + SUBSETS + ", tg2 AS (SELECT subset, greatest(y_acceptor, y_donor) AS label, greatest(head_a, head_b) AS score FROM mem WHERE mem OR (y_acceptor = 0 AND y_donor = 0))" + sql_metrics("tg2", "subset") + f" SELECT subset, 'splice' AS target, {SQL_COLS} FROM mt")
def pooled_splice_metrics(spark, sf):
    d = _shared(spark, sf).withColumns({"splice": F.greatest("head_a", "head_b"), "y_splice": F.greatest("y_acceptor", "y_donor")})
    return rounded(V.classification_metrics(d, ["splice"], {"splice": "y_splice"}, None, "shared")).drop("head")


SITE = ", st AS (SELECT subset, y_ssu AS ssu, head_a, head_b FROM mem WHERE mem AND valid AND subset <> 'all' AND (y_acceptor = 1 OR y_donor = 1)), sl AS (SELECT subset, ssu, 'head_a' AS head, head_a AS score FROM st UNION ALL SELECT subset, ssu, 'head_b', head_b FROM st)"
BINS = "CASE WHEN ssu < 0.1 THEN 0 WHEN ssu < 0.2 THEN 1 WHEN ssu < 0.30000000000000004::DOUBLE THEN 2 WHEN ssu < 0.4 THEN 3 WHEN ssu < 0.5 THEN 4 WHEN ssu < 0.6000000000000001::DOUBLE THEN 5 WHEN ssu < 0.7000000000000001::DOUBLE THEN 6 WHEN ssu < 0.8 THEN 7 WHEN ssu < 0.9 THEN 8 ELSE 9 END"


@query(cte("v_pred") + SUBSETS + SITE + f" SELECT subset, head, {sql_reg('ssu', 'score')} FROM sl GROUP BY subset, head")
def regression_by_subset(spark, sf):
    rows = V.site_rows(_shared(spark, sf), ["head_a", "head_b"], "shared")
    return rounded(C.regression_metrics(rows, ["subset", "head"], "ssu", "score"), REG_COLS)


@query(cte("v_pred") + SUBSETS + SITE + f" SELECT subset, head, {BINS} AS bin, {sql_reg('ssu', 'score')} FROM sl GROUP BY subset, head, 3")
def binned_regression(spark, sf):
    rows = V.site_rows(_shared(spark, sf), ["head_a", "head_b"], "shared").withColumn("bin", S.usage_bin(F.col("ssu")))
    return rounded(C.regression_metrics(rows, ["subset", "head", "bin"], "ssu", "score"), REG_COLS)


@query(cte("v_pred") + f", s AS (SELECT y_ssu AS ssu, y_acceptor, y_donor FROM v_pred WHERE y_ssu <> 777 AND (y_acceptor = 1 OR y_donor = 1)) SELECT {BINS} AS bin, CAST(sum(y_acceptor) AS BIGINT) AS n_acc, CAST(sum(y_donor) AS BIGINT) AS n_don FROM s GROUP BY 1")
def binned_counts(spark, sf):
    return V.binned_counts(view(spark, sf, "v_pred").withColumn("ssu", S.from_sentinel(F.col("y_ssu"))))


HASH = "md5(concat_ws(':', '{seed}', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)))"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
RATIO = f""", po AS (SELECT *, y_ssu AS ssu FROM v_pred WHERE y_acceptor = 1 AND y_ssu <> 777), pb AS (SELECT *, {BINS} AS bin FROM po), ne AS (SELECT *, row_number() OVER (ORDER BY {HASH.format(seed=42)}) AS rn, count(*) OVER () AS nn FROM v_pred WHERE y_acceptor = 0 AND y_donor = 0),
qb AS (SELECT bin, count(*) AS n_pos FROM pb GROUP BY bin), qq AS (SELECT bin, CASE WHEN n_pos = (SELECT max(n_pos) FROM qb) THEN (SELECT max(nn) FROM ne) ELSE CAST(floor(n_pos * ((SELECT max(nn) FROM ne) / (SELECT max(n_pos) FROM qb))) AS BIGINT) END AS quota FROM qb)"""


def _ratio(spark, sf):
    v = view(spark, sf, "v_pred").withColumn("ssu", S.from_sentinel(F.col("y_ssu")))
    pos = v.filter("y_acceptor = 1 AND ssu IS NOT NULL").withColumn("bin", S.usage_bin(F.col("ssu")))
    return pos, v.filter("y_acceptor = 0 AND y_donor = 0")


@query(cte("v_pred") + RATIO + " SELECT bin, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM qq JOIN ne ON rn <= quota GROUP BY bin")
def ratio_negatives(spark, sf):
    pos, neg = _ratio(spark, sf)
    r = V.ratio_negatives(pos, neg, "bin", KEYS)
    return r.groupBy("bin").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


@query(cte("v_pred") + RATIO + ", rw AS (SELECT bin, 1 AS label, head_a AS score FROM pb UNION ALL SELECT bin, 0, head_a FROM qq JOIN ne ON rn <= quota)" + sql_metrics("rw", "bin") + f" SELECT bin, {SQL_COLS} FROM mt")
def ratio_binned_classification(spark, sf):
    pos, neg = _ratio(spark, sf)
    n = V.ratio_negatives(pos, neg, "bin", KEYS).select("bin", F.lit(0).alias("label"), "head_a")
    rows = pos.select("bin", F.lit(1).alias("label"), "head_a").unionByName(n)
    return rounded(C.ranking_metrics(rows, ["bin"], "head_a"))


@query(cte("v_pred") + RATIO.replace(f"{BINS} AS bin", "CASE WHEN pos % 3 = 0 THEN 'constitutive' WHEN pos % 3 = 1 THEN 'intermediate' ELSE 'tissue-specific' END AS bin") + ", rw AS (SELECT bin, 1 AS label, head_b AS score FROM pb UNION ALL SELECT bin, 0, head_b FROM qq JOIN ne ON rn <= quota)" + sql_metrics("rw", "bin") + f" SELECT bin AS stratum, {SQL_COLS} FROM mt")
def ratio_grouped_classification(spark, sf):
    pos, neg = _ratio(spark, sf)
    m = F.col("pos") % 3
    pos = pos.withColumn("stratum", F.when(m == 0, "constitutive").when(m == 1, "intermediate").otherwise("tissue-specific"))
    n = V.ratio_negatives(pos, neg, "stratum", KEYS).select("stratum", F.lit(0).alias("label"), "head_b")
    rows = pos.select("stratum", F.lit(1).alias("label"), "head_b").unionByName(n)
    return rounded(C.ranking_metrics(rows, ["stratum"], "head_b"))


KEPT = f""", k0 AS (SELECT *, y_acceptor = 1 AS site, pos % 7 = 0 AS strat FROM v_pred), qt AS (SELECT sample, count(*) FILTER (WHERE site) * 20 AS quota FROM k0 GROUP BY sample),
nr AS (SELECT k0.*, row_number() OVER (PARTITION BY sample ORDER BY {HASH.format(seed=5)}) AS rn FROM k0 WHERE NOT (site OR strat)), kp AS (SELECT sample, site, l_orderkey FROM k0 WHERE site OR strat UNION ALL SELECT nr.sample, site, l_orderkey FROM nr JOIN qt USING (sample) WHERE rn <= quota)"""


@query(cte("v_pred") + KEPT + " SELECT sample, count(*) AS n, count(*) FILTER (WHERE site) AS n_site, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM kp GROUP BY sample")
def pooled_keep_mask(spark, sf):
    v = view(spark, sf, "v_pred")
    site = F.col("y_acceptor") == 1
    k = V.kept_rows(v, ["sample"], KEYS, site, F.col("pos") % 7 == 0, V.NEGATIVES_PER_POSITIVE, 5)
    return k.groupBy("sample").agg(F.count("*").alias("n"), F.count_if(site).alias("n_site"), F.sum("l_orderkey").alias("key_sum"))


@query(cte("v_pred") + KEPT.replace("UNION ALL SELECT nr.sample, site, l_orderkey", "UNION ALL SELECT nr.sample, site, l_orderkey").replace("AS (SELECT sample, site, l_orderkey FROM k0", "AS (SELECT sample, site, head_b FROM k0").replace("nr.sample, site, l_orderkey FROM", "nr.sample, site, head_b FROM") + ", rw AS (SELECT CASE WHEN site THEN 1 ELSE 0 END AS label, head_b AS score FROM kp)" + sql_metrics("rw", "") + f" SELECT {SQL_COLS} FROM mt")
def pooled_metrics(spark, sf):
    """All individuals pooled after each was filtered on its own."""
    v = view(spark, sf, "v_pred")
    site = F.col("y_acceptor") == 1
    k = V.kept_rows(v, ["sample"], KEYS, site, F.col("pos") % 7 == 0, V.NEGATIVES_PER_POSITIVE, 5)
    return rounded(C.ranking_metrics(k.select(site.cast("int").alias("label"), "head_b"), [], "head_b"))


@query(cte("v_pred") + ", m AS (SELECT sample, region, corr(y_ssu, head_b) AS r, avg(abs(y_ssu - head_b)) AS mae FROM v_pred WHERE y_ssu <> 777 GROUP BY sample, region) SELECT region, round(avg(r), 6) AS pearson, round(avg(mae), 6) AS mae, count(*) AS n_samples FROM m GROUP BY region")
def mean_over_individuals(spark, sf):
    v = view(spark, sf, "v_pred").withColumn("ssu", S.from_sentinel(F.col("y_ssu")))
    m = C.regression_metrics(v, ["sample", "region"], "ssu", "head_b")
    return m.groupBy("region").agg(F.round(F.avg("pearson"), 6).alias("pearson"), F.round(F.avg("mae"), 6).alias("mae"), F.count("*").alias("n_samples"))


@query(cte("v_pred") + "SELECT sample, CAST(least(floor(head_a * 10 * 20), 19) AS INT) AS bin, round(avg(head_a * 10), 6) AS mean_pred, round(avg(y_ssu), 6) AS mean_true, count(*) AS n FROM v_pred WHERE y_ssu <> 777 GROUP BY sample, 2")
def calibration(spark, sf):
    v = view(spark, sf, "v_pred").select("sample", (F.col("head_a") * 10).alias("pred"), S.from_sentinel(F.col("y_ssu")).alias("ssu"))
    return rounded(V.calibration(v, ["sample"], "ssu", "pred"), ["mean_pred", "mean_true"])


@query(cte("v_pred") + "SELECT CAST(least(floor(head_b * 25), 24) AS INT) AS bx, CAST(least(floor(y_ssu * 25), 24) AS INT) AS \"by\", count(*) AS n FROM v_pred WHERE head_b BETWEEN 0 AND 1 AND y_ssu BETWEEN 0 AND 1 GROUP BY 1, 2")
def density_grid(spark, sf):
    return V.histogram_2d(view(spark, sf, "v_pred"), "head_b", "y_ssu", 25)


@query(cte("v_label_score") + sql_metrics("v_label_score", "stratum") + """, gp AS (SELECT unnest(range(200)) AS i), sg AS (SELECT stratum, (fp - n) / nn AS x0, fp / nn AS x1, (tp - p) / np AS y0, tp / np AS y1 FROM cc WHERE np > 0 AND nn > 0),
v AS (SELECT stratum, i, y0 + (y1 - y0) * (i / 199 - x0) / (x1 - x0) AS y FROM sg JOIN gp ON x1 > x0 AND i <= floor(x1 * 199) AND i >= CASE WHEN x0 = 0 THEN 0 ELSE floor(x0 * 199) + 1 END) SELECT i, round(median(y), 6) AS tpr FROM v GROUP BY i""")
def median_roc_curve(spark, sf):
    g = C.on_grid(C.curve(view(spark, sf, "v_label_score"), ["stratum"]), ["stratum"], 200, "roc")
    return g.groupBy("i").agg(F.round(F.percentile("y", F.lit(0.5)), 6).alias("tpr"))


@query(cte("v_label_score") + sql_metrics("v_label_score", "stratum") + """, gp AS (SELECT unnest(range(200)) AS i), sg AS (SELECT stratum, (tp - p) / np AS x0, tp / np AS x1, CASE WHEN tp - p + fp - n > 0 THEN (tp - p) / (tp - p + fp - n) ELSE 1 END AS y0, tp / (tp + fp) AS y1 FROM cc WHERE np > 0 AND nn > 0),
v AS (SELECT stratum, i, y0 + (y1 - y0) * (i / 199 - x0) / (x1 - x0) AS y FROM sg JOIN gp ON x1 > x0 AND i <= floor(x1 * 199) AND i >= CASE WHEN x0 = 0 THEN 0 ELSE floor(x0 * 199) + 1 END), m AS (SELECT i, median(y) AS y FROM v GROUP BY i) SELECT round(sum((y + py) / 2 / 199), 6) AS area, count(*) AS n_points FROM (SELECT *, lag(y) OVER (ORDER BY i) AS py FROM m) z""")
def median_pr_area(spark, sf):
    from pyspark.sql import Window

    g = C.on_grid(C.curve(view(spark, sf, "v_label_score"), ["stratum"]), ["stratum"], 200, "pr")
    m = g.groupBy("i").agg(F.percentile("y", F.lit(0.5)).alias("y"))
    m = m.withColumn("py", F.lag("y").over(Window.orderBy("i")))  # 200 grid points
    return m.agg(F.round(F.sum((F.col("y") + F.col("py")) / 2 / 199), 6).alias("area"), F.count("*").alias("n_points"))
