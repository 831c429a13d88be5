"""Queries over reporter-assay variants: effect labels, regions, exons, trends and resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.functions.stats import correlation
from splicelake.functions import scalar as S
from splicelake.operators import curves as C
from splicelake.operators import reporter as R
from splicelake.operators.ordered import lookup
from splicelake.operators.resampling import bootstrap_metrics
from splicelake.plans.metric_plans import REG_COLS, rounded, sql_metrics, sql_reg
from splicelake.plans.registry import query
from splicelake.plans.views import cte, locations_sql, table, view
from splicelake.session import spread, written

HEADS = ["a", "b", "c"]
ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SQLKEY = "concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))"
RP = ", rp AS (SELECT *, CASE WHEN abs(y) > (SELECT stddev_pop(y) FROM v_reporter) THEN 1 ELSE 0 END AS label FROM v_reporter)"


def _key():
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ROW_KEY])


def long(src, keep):
    return "(" + " UNION ALL ".join(f"SELECT {keep}, '{h}' AS head, {h} AS score FROM {src}" for h in HEADS) + ")"


def _r(spark, sf):
    return R.large_effect(view(spark, sf, "v_reporter"), "y")


@query(cte("v_reporter") + RP + " SELECT label, count(*) AS n, round(avg(y), 6) AS mean_y FROM rp GROUP BY label")
def effect_labels(spark, sf):
    return _r(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))


@query(cte("v_reporter") + ", m AS (SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM v_reporter) SELECT CASE WHEN y > mu + sd THEN 'increasing' WHEN y < mu - sd THEN 'decreasing' ELSE 'neutral' END AS zone, count(*) AS n FROM v_reporter CROSS JOIN m GROUP BY 1")
def effect_zones(spark, sf):
    return R.effect_zone(view(spark, sf, "v_reporter"), "y").groupBy("zone").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT p_partkey AS k, p_partkey * 10 AS s, p_size + 20 AS i1, p_size + 30 AS ex, CASE WHEN p_size % 10 = 0 THEN 41 ELSE 40 END AS i2, p_partkey * 10 + p_size * 2 + 89 AS e FROM part) SELECT k, s + i1 AS exon_start, s + i1 + ex - 1 AS exon_end, e - s = i1 + ex + i2 - 1 AS span_ok, s + i1 + ex - 1 = e - i2 AS end_ok FROM o")
def oligo_exons(spark, sf):
    o = table(spark, sf, "part").selectExpr("p_partkey AS k", "p_partkey * 10 AS start", "p_size + 20 AS intron1_len", "p_size + 30 AS exon_len", "CASE WHEN p_size % 10 = 0 THEN 41 ELSE 40 END AS intron2_len", "p_partkey * 10 + p_size * 2 + 89 AS end")
    return R.oligo_exons(o).select("k", "exon_start", "exon_end", "span_ok", "end_ok")


@query(cte("v_seq") + ", s AS (SELECT doc_id, regexp_replace(seq, '[^ACGT]', 'N', 'g') AS seq FROM v_seq), t AS (SELECT doc_id, seq, CASE WHEN doc_id % 3 = 0 THEN seq WHEN doc_id % 3 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE concat(seq, 'A') END AS nat FROM s) SELECT CASE WHEN seq = nat THEN 'forward' WHEN seq = reverse(translate(nat, 'ACGT', 'TGCA')) THEN 'revcomp' ELSE 'mismatch' END AS orient, CASE WHEN seq = nat THEN '+' WHEN seq = reverse(translate(nat, 'ACGT', 'TGCA')) THEN '-' END AS strand, count(*) AS n FROM t GROUP BY 1, 2")
def oligo_orientation(spark, sf):
    from splicelake.functions.sequence import reverse_complement

    s = view(spark, sf, "v_seq").select("doc_id", F.regexp_replace("seq", "[^ACGT]", "N").alias("seq"))
    m = F.col("doc_id") % 3
    nat = F.when(m == 0, F.col("seq")).when(m == 1, reverse_complement(F.col("seq"))).otherwise(F.concat("seq", F.lit("A")))
    o = s.select(R.orientation(F.col("seq"), nat).alias("orient"))
    return o.groupBy("orient", R.strand_from_orientation(F.col("orient")).alias("strand")).agg(F.count("*").alias("n"))


LOC = locations_sql("rp", "pos", "estart", "eend", "lx")


def _region_counts(rows, label=None):
    keep = [label] if label else []
    return R.region_counts(spread(rows.select("pos", "estart", "eend", "y", *keep, *HEADS)), "y", label, HEADS)


def sql_head_metrics(src, by):
    b = ", ".join(by)
    on = " AND ".join(f"g.{c} = k.{c}" for c in [*by, "head"])
    return f""", ll AS (SELECT *, abs(score) AS ascore FROM {long(src, b + ', y, label')} z), rg AS (SELECT {b}, head, {sql_reg('y', 'score')} FROM ll GROUP BY {b}, head HAVING count(*) >= 5),
rk AS (SELECT {b}, head, rank() OVER (PARTITION BY {b}, head ORDER BY y) + (count(*) OVER (PARTITION BY {b}, head, y) - 1) / 2 AS ra, rank() OVER (PARTITION BY {b}, head ORDER BY score) + (count(*) OVER (PARTITION BY {b}, head, score) - 1) / 2 AS rb FROM ll), sp AS (SELECT {b}, head, corr(ra, rb) AS spearman FROM rk GROUP BY {b}, head)
""" + sql_metrics("ll", f"{b}, head", "ascore") + f", hm AS (SELECT rg.*, round(sp.spearman, 6) AS spearman, mt.n_pos, round(mt.avg_precision, 6) AS avg_precision, round(mt.auroc, 6) AS auroc FROM rg JOIN sp USING ({b}, head) LEFT JOIN mt USING ({b}, head))"


HM = [*REG_COLS, "spearman", "avg_precision", "auroc"]


@query(cte("v_reporter") + RP + LOC + sql_head_metrics("lx", ["location"]) + " SELECT * FROM hm")
def metrics_by_location(spark, sf):
    return rounded(R.counted_metrics(_region_counts(_r(spark, sf), "label"), ["location"]), HM)


SWEEP = [i / 100 for i in range(1, 101)]
SWEEP_SQL = "(SELECT unnest([" + ", ".join(str(x) for x in SWEEP) + "]::DOUBLE[]) AS threshold)"


@query(cte("v_reporter") + ", rp AS (SELECT * FROM v_reporter), sw AS (SELECT head, threshold, abs(score) AS ascore, CASE WHEN abs(y) > threshold THEN 1 ELSE 0 END AS label FROM " + long("rp", "y") + f" z CROSS JOIN {SWEEP_SQL} t)" + sql_metrics("sw", "head, threshold", "ascore") + " SELECT head, threshold, n_pos, n_neg, round(avg_precision, 6) AS avg_precision FROM mt")
def effect_threshold_sweep(spark, sf):
    d = view(spark, sf, "v_reporter").unpivot(["y"], HEADS, "head", "score")
    return rounded(R.sweep_metrics(d, ["head"], "y", "score", SWEEP), ["avg_precision"])


@query(cte("v_reporter") + RP + LOC + ", sw AS (SELECT location, head, threshold, abs(score) AS ascore, CASE WHEN abs(y) > threshold THEN 1 ELSE 0 END AS label FROM " + long("lx", "location, y") + f" z CROSS JOIN {SWEEP_SQL} t)" + sql_metrics("sw", "location, head, threshold", "ascore") + " SELECT location, head, threshold, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round(avg_precision, 6) END AS avg_precision FROM mt")
def location_threshold_sweep(spark, sf):
    d = _region_counts(view(spark, sf, "v_reporter"))
    return rounded(R.sweep_metrics(d, ["location", "head"], "truth", "score", SWEEP, both_classes=True, count="n"), ["avg_precision"])


@query(cte("v_reporter") + "SELECT pos, count(*) AS n, round(avg(abs(y)), 6) AS mean, round(median(abs(y)), 6) AS median FROM v_reporter GROUP BY pos HAVING count(*) >= 5")
def position_profile(spark, sf):
    d = view(spark, sf, "v_reporter").withColumn("ay", F.abs("y"))
    return rounded(R.position_profile(d, [], "pos", "ay"), ["mean", "median"])


@query(cte("v_reporter") + RP + ", e AS (SELECT head, pos, abs(score - y) AS err, label FROM " + long("rp", "pos, y, label") + " z) SELECT head, pos, count(*) AS n, round(sum(err), 7) AS abs_error, round(avg(label), 6) AS share_positive FROM e GROUP BY head, pos HAVING count(*) >= 5")
def error_profile(spark, sf):
    d = _r(spark, sf).unpivot(["pos", "y", "label"], HEADS, "head", "score")
    return d.groupBy("head", "pos").agg(F.count("*").alias("n"), F.round(F.sum(F.abs(F.col("score") - F.col("y"))), 7).alias("abs_error"), F.round(F.avg("label"), 6).alias("share_positive")).filter("n >= 5")


@query(cte("v_reporter") + "SELECT pos, round(avg(sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2) / 3)), 6) AS disagreement FROM v_reporter GROUP BY pos")
def head_disagreement(spark, sf):
    return view(spark, sf, "v_reporter").groupBy("pos").agg(F.round(F.avg(R.disagreement(HEADS)), 6).alias("disagreement"))


@query(cte("v_reporter") + ", d AS (SELECT abs(y) AS x, abs(b - y) AS e FROM v_reporter), q AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q, max(x) AS mx FROM d), z AS (SELECT len(list_filter(q, lambda t: t <= x)) AS bin, e FROM d CROSS JOIN q WHERE x < mx) SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(e), 6) AS mean, round(median(e), 6) AS median FROM z GROUP BY bin HAVING count(*) >= 3")
def percentile_trend(spark, sf):
    d = view(spark, sf, "v_reporter").select(F.abs("y").alias("x"), F.abs(F.col("b") - F.col("y")).alias("e"))
    return rounded(R.percentile_trend(d, "x", "e", 10), ["mean", "median"])


EXON = cte("v_reporter") + RP + sql_head_metrics("rp", ["exon"])


def _exon(spark, sf):
    return R.head_metrics(_r(spark, sf), ["exon"], "y", "label", HEADS)


@query(EXON + " SELECT *, CAST(row_number() OVER (PARTITION BY exon ORDER BY pearson DESC, head) AS INT) AS rank FROM hm WHERE pearson IS NOT NULL")
def exon_ranks(spark, sf):
    return R.ranked_heads(rounded(_exon(spark, sf), HM), ["exon"], "pearson")


@query(EXON + ", r AS (SELECT *, row_number() OVER (PARTITION BY exon ORDER BY pearson DESC, head) AS rank FROM hm WHERE pearson IS NOT NULL) SELECT head, count(*) AS n, round(avg(rank), 6) AS mean_rank, round(count(*) FILTER (WHERE rank = 1) / count(*), 6) AS share_first, round(count(*) FILTER (WHERE rank = 2) / count(*), 6) AS share_second FROM r GROUP BY head")
def rank_shares(spark, sf):
    return rounded(R.rank_shares(R.ranked_heads(rounded(_exon(spark, sf), HM), ["exon"], "pearson")), ["mean_rank", "share_first", "share_second"])


@query(EXON + """ , w AS (SELECT exon, head, 'pearson' AS metric, pearson AS v, pearson AS good FROM hm UNION ALL SELECT exon, head, 'spearman', spearman, spearman FROM hm UNION ALL SELECT exon, head, 'mae', mae, -mae FROM hm)
SELECT x.metric, x.head AS head_a, z.head AS head_b, count(*) FILTER (WHERE x.good > z.good) AS wins, count(*) FILTER (WHERE x.good < z.good) AS losses, count(*) AS n FROM w x JOIN w z ON x.exon = z.exon AND x.metric = z.metric AND x.head <> z.head GROUP BY 1, 2, 3""")
def win_matrix(spark, sf):
    m = written(rounded(_exon(spark, sf), HM).select("exon", "head", "pearson", "spearman", "mae"), "heads")
    return reduce(DataFrame.unionByName, [R.win_matrix(m, ["exon"], c, c == "mae").select(F.lit(c).alias("metric"), "*") for c in ("pearson", "spearman", "mae")])


@query(EXON + " SELECT exon, head, mae, CAST(row_number() OVER (PARTITION BY exon ORDER BY mae, head) AS INT) AS rank FROM hm WHERE mae IS NOT NULL")
def exon_error_ranks(spark, sf):
    return R.ranked_heads(rounded(_exon(spark, sf), HM), ["exon"], "mae", smaller_is_better=True).select("exon", "head", "mae", "rank")


@query(EXON + ", pr AS (SELECT exon, max(eend) AS elen, count(*) AS nv FROM rp GROUP BY exon), me AS (SELECT exon, avg(mae) AS m FROM hm GROUP BY exon) SELECT round(corr(m, elen), 6) AS r_length, round(corr(m, nv), 6) AS r_count, count(*) AS n FROM me JOIN pr USING (exon)")
def exon_difficulty(spark, sf):
    m = rounded(_exon(spark, sf), HM).groupBy("exon").agg(F.avg("mae").alias("m"))
    p = view(spark, sf, "v_reporter").groupBy("exon").agg(F.max("eend").alias("elen"), F.count("*").alias("nv"))
    return lookup(m, p, ["exon"]).agg(F.round(correlation("m", "elen"), 6).alias("r_length"), F.round(correlation("m", "nv"), 6).alias("r_count"), F.count("*").alias("n"))


@query(cte("v_reporter") + "SELECT exon, round(corr(a, b), 6) AS ab, round(corr(a, c), 6) AS ac, round(corr(b, c), 6) AS bc, count(*) AS n FROM v_reporter GROUP BY exon")
def exon_concordance(spark, sf):
    g = view(spark, sf, "v_reporter").groupBy("exon").agg(correlation("a", "b").alias("ab"), correlation("a", "c").alias("ac"), correlation("b", "c").alias("bc"), F.count("*").alias("n"))
    return rounded(g, ["ab", "ac", "bc"])


@query(cte("v_reporter") + f"SELECT {SQLKEY} AS k, round(CASE WHEN stddev_samp(y) OVER w > 0 THEN (y - avg(y) OVER w) / stddev_samp(y) OVER w ELSE 0 END, 6) AS z FROM v_reporter WINDOW w AS (PARTITION BY exon)")
def exon_z_scores(spark, sf):
    return R.group_z(view(spark, sf, "v_reporter"), ["exon"], "y").select(_key().alias("k"), F.round("z", 6).alias("z"))


@query(cte("v_reporter") + RP + LOC + f" SELECT {SQLKEY} AS k, location, label, round(abs(a), 6) AS abs_a, round(abs(b), 7) AS abs_b, CASE WHEN abs(a) >= abs(b) THEN 'a' ELSE 'b' END AS stronger FROM lx WHERE location IN ('exon', 'intron', 'splice_site', 'splice_region')")
def two_head_table(spark, sf):
    d = R.by_region(_r(spark, sf)).filter(F.col("location").isin("exon", "intron", "splice_site", "splice_region"))
    return d.select(_key().alias("k"), "location", "label", F.round(F.abs("a"), 6).alias("abs_a"), F.round(F.abs("b"), 7).alias("abs_b"), F.when(F.abs("a") >= F.abs("b"), "a").otherwise("b").alias("stronger"))


@query(cte("v_reporter") + RP + LOC + ", lh AS (SELECT location, label, head, abs(score) AS ascore FROM (SELECT location, label, 'a' AS head, a AS score FROM lx UNION ALL SELECT location, label, 'b', b FROM lx) z WHERE location IN ('exon', 'intron', 'splice_site', 'splice_region'))" + sql_metrics("lh", "location, head", "ascore") + " SELECT location, max(n_pos) AS n_pos, round(max(CASE WHEN head = 'a' THEN avg_precision END), 6) AS precision_a, round(max(CASE WHEN head = 'b' THEN avg_precision END), 6) AS precision_b FROM mt GROUP BY location")
def two_head_precision(spark, sf):
    """Average precision of two heads side by side, by location class."""
    d = R.by_region(_r(spark, sf)).filter(F.col("location").isin("exon", "intron", "splice_site", "splice_region")).unpivot(["location", "label"], ["a", "b"], "head", "score")
    m = C.ranking_metrics(d.withColumn("s", F.abs("score")), ["location", "head"], "s")
    own = lambda h: F.round(F.max(F.when(F.col("head") == h, F.col("avg_precision"))), 6).alias(f"precision_{h}")
    return m.groupBy("location").agg(F.max("n_pos").alias("n_pos"), own("a"), own("b"))


@query(cte("v_reporter") + "SELECT pos, count(*) AS n, round(count(*) / (SELECT count(*) FROM v_reporter WHERE y IS NOT NULL), 9) AS density FROM v_reporter WHERE y IS NOT NULL GROUP BY pos HAVING count(*) >= 5")
def position_density(spark, sf):
    """Share of all measured rows at each position with enough rows."""
    d = view(spark, sf, "v_reporter")
    total = d.filter("y IS NOT NULL").agg(F.count("*")).scalar()
    p = R.position_profile(d, [], "pos", "y")
    return p.select("pos", "n", F.round(F.col("n") / total, 9).alias("density"))


@query(cte("v_reporter") + RP + ", ag AS (SELECT label, a, b, c, (a + b + c) / 3 AS agg FROM rp), l4 AS (SELECT label, head, abs(score) AS ascore FROM (SELECT label, 'a' AS head, a AS score FROM ag UNION ALL SELECT label, 'b', b FROM ag UNION ALL SELECT label, 'c', c FROM ag UNION ALL SELECT label, 'aggregate', agg FROM ag) z)" + sql_metrics("l4", "head", "ascore") + " SELECT head, round(avg_precision, 6) AS avg_precision, CAST(row_number() OVER (ORDER BY avg_precision DESC, head) AS INT) AS rank, avg_precision > (SELECT avg_precision FROM mt WHERE head = 'aggregate') AS beats_aggregate FROM mt")
def head_ranks_against_aggregate(spark, sf):
    d = _r(spark, sf).withColumn("aggregate", (F.col("a") + F.col("b") + F.col("c")) / 3)
    m = C.ranking_metrics(d.unpivot(["label"], [*HEADS, "aggregate"], "head", "score").withColumn("s", F.abs("score")), ["head"], "s").withColumn("one", F.lit(1))
    top = m.filter("head = 'aggregate'").select("avg_precision").scalar()
    r = R.ranked_heads(m, ["one"], "avg_precision").withColumn("beats_aggregate", F.col("avg_precision") > top)
    return r.select("head", F.round("avg_precision", 6).alias("avg_precision"), "rank", "beats_aggregate")


@query(cte("v_reporter") + ", t AS (SELECT head, split, strand, y, score FROM " + long("v_reporter", "split, strand, y") + " z) SELECT head, split, strand, round(corr(y, score), 6) AS r, count(*) AS n FROM t GROUP BY head, split, strand")
def correlation_table(spark, sf):
    d = view(spark, sf, "v_reporter").unpivot(["split", "strand", "y"], HEADS, "head", "score")
    return d.groupBy("head", "split", "strand").agg(F.round(correlation("y", "score"), 6).alias("r"), F.count("*").alias("n"))


# --- resampling ---------------------------------------------------------------------------------------------------

BOOT = ["diff_mean", "ci_lo", "ci_hi", "p"]
REPLICATES = 10_000


def _boot(spark, sf, key):
    m = bootstrap_metrics(_r(spark, sf), "y", "label", HEADS, key, REPLICATES)
    return rounded(R.bootstrap_compare(m, HEADS), BOOT)


@query()
def paired_bootstrap(spark, sf):
    """10,000 resamples of rows; tested by brute force, since SQL would repeat the rows as often."""
    return _boot(spark, sf, _key())


@query()
def cluster_bootstrap(spark, sf):
    """10,000 resamples of exons with all their rows."""
    return _boot(spark, sf, F.col("exon"))


@query(EXON + ", t AS (SELECT head, exon, round(exp(-abs(pearson) * 20), 9) AS p FROM hm WHERE pearson IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY p, exon) AS i, count(*) OVER (PARTITION BY head) AS k FROM t), m AS (SELECT *, least(max(p * (k - i + 1)) OVER (PARTITION BY head ORDER BY p, exon ROWS UNBOUNDED PRECEDING), 1) AS pa FROM r) SELECT head, exon, round(pa, 6) AS p_adj, CASE WHEN pa < 0.001 THEN '***' WHEN pa < 0.01 THEN '**' WHEN pa < 0.05 THEN '*' ELSE '' END AS stars, round(least(p * 3, 1), 6) AS p_bonf FROM m")
def holm_correction(spark, sf):
    t = rounded(_exon(spark, sf), HM).filter("pearson IS NOT NULL").select("head", "exon", F.round(F.exp(-F.abs("pearson") * 20), 9).alias("p"))
    h = R.holm(t, ["head"], ["exon"]).withColumn("p_bonf", R.bonferroni(F.col("p"), 3))
    return h.select("head", "exon", F.round("p_adj", 6).alias("p_adj"), "stars", F.round("p_bonf", 6).alias("p_bonf"))


KW = ", kd AS (SELECT CASE WHEN y < -0.3 THEN 'low' WHEN y < 0.3 THEN 'mid' ELSE 'high' END AS g, a AS v FROM v_reporter), kr AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM kd), kt AS (SELECT sum(t * t * t - t) AS ties, sum(t) AS n FROM (SELECT count(*)::DOUBLE AS t FROM kd GROUP BY v) q), ks AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS rs FROM kr GROUP BY g)"


@query(cte("v_reporter") + KW + ", h AS (SELECT (12 / (max(kt.n) * (max(kt.n) + 1)) * sum(rs * rs / ks.n) - 3 * (max(kt.n) + 1)) / (1 - max(ties) / (max(kt.n) ** 3 - max(kt.n))) AS h FROM ks CROSS JOIN kt) SELECT round(h, 6) AS h, round(exp(-h / 2), 6) AS p FROM h")
def kruskal_wallis(spark, sf):
    d = view(spark, sf, "v_reporter").select(F.when(F.col("y") < -0.3, "low").when(F.col("y") < 0.3, "mid").otherwise("high").alias("g"), "a")
    return rounded(R.kruskal_wallis(d, "g", "a", 3), ["h", "p"])


@query(cte("v_reporter") + KW.replace("FROM v_reporter)", "FROM v_reporter WHERE y < -0.3 OR y >= 0.3)", 1) + ", u AS (SELECT max(CASE WHEN g = 'low' THEN rs END) - max(CASE WHEN g = 'low' THEN ks.n END) * (max(CASE WHEN g = 'low' THEN ks.n END) + 1) / 2 AS u, max(CASE WHEN g = 'low' THEN ks.n END) AS n1, max(CASE WHEN g = 'high' THEN ks.n END) AS n2, max(ties) AS t FROM ks CROSS JOIN kt) SELECT u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM u")
def mann_whitney(spark, sf):
    d = view(spark, sf, "v_reporter").select(F.when(F.col("y") < -0.3, "low").when(F.col("y") < 0.3, "mid").otherwise("high").alias("g"), "a")
    return R.mann_whitney(d, "g", "a", "low", "high").select("u", F.round("z", 6).alias("z"))
