"""Queries over position joins, haplotype rows and key joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators import haplotypes as H
from splicelake.operators import intervals as I
from splicelake.operators import joins as J
from splicelake.operators import usage as U
from splicelake.operators.stages import StageCounts
from splicelake.plans.registry import query
from splicelake.plans.usage_plans import FRAC, _usage
from splicelake.plans.views import cte, table, view
from splicelake.session import scratch_dir

BIN = 64  # the driver's coordinates span a few thousand positions only


def _rows(spark, sf):
    """Haplotype rows: each gene belongs to one sample, with both alleles."""
    g = view(spark, sf, "v_gene").withColumn("sample", F.concat(F.lit("S"), (F.col("gstart") % 10).cast("string")))
    return g.select("gene_id", "region", "strand", "gstart", "gend", "sample", "paralog")


ROWS = ", gr AS (SELECT gene_id, region, strand, gstart, gend, paralog, concat('S', CAST(gstart % 10 AS STRING)) AS sample FROM v_gene)"
SITES = """, att AS (SELECT gr.gene_id, site_type, string_agg(CAST(site AS STRING), ',' ORDER BY site) AS sites, string_agg(CAST(CAST(round(coalesce(ssu, 777.0) * 1000) AS BIGINT) AS STRING), ',' ORDER BY site) AS vals, bool_and(ssu IS NULL) AS allmiss
 FROM gr JOIN us ON gr.region = us.region AND gr.strand = us.strand AND gr.sample = us.sample AND us.site BETWEEN gr.gstart AND gr.gend GROUP BY ALL),
hs AS (SELECT gr.*, coalesce(e.sites, '') AS exon_ends, coalesce(s.sites, '') AS exon_starts, coalesce(e.vals, '') AS end_vals, coalesce(s.vals, '') AS start_vals, coalesce(e.allmiss, false) AS em, coalesce(s.allmiss, false) AS sm
 FROM gr LEFT JOIN (SELECT * FROM att WHERE site_type = 'exon_end') e ON gr.gene_id = e.gene_id LEFT JOIN (SELECT * FROM att WHERE site_type = 'exon_start') s ON gr.gene_id = s.gene_id)"""


def _text(df):
    mil = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 1000).cast("long")), ",")
    return df.select("gene_id", F.array_join("exon_ends", ",").alias("exon_ends"), F.array_join("exon_starts", ",").alias("exon_starts"), mil("exon_end_ssus").alias("end_vals"), mil("exon_start_ssus").alias("start_vals"))


def _attached(spark, sf):
    return H.attach_sites(_rows(spark, sf), _usage(spark, sf), BIN)


@query(cte("v_gene", "v_usage") + FRAC + ROWS + SITES + " SELECT gene_id, exon_ends, exon_starts, end_vals, start_vals FROM hs")
def sites_per_haplotype(spark, sf):
    return _text(_attached(spark, sf))


@query(cte("v_gene", "v_usage") + FRAC + ROWS + SITES + " SELECT gene_id, exon_ends, exon_starts, end_vals, start_vals FROM hs WHERE NOT em AND NOT sm")
def usable_haplotypes(spark, sf):
    return _text(H.drop_unusable(_attached(spark, sf)))


@query(cte("v_gene", "v_usage") + FRAC + ROWS + SITES + " SELECT gene_id, exon_ends, exon_starts, end_vals, start_vals FROM hs WHERE exon_ends <> '' AND exon_starts <> ''")
def nonempty_haplotypes(spark, sf):
    return _text(H.drop_empty(_attached(spark, sf)))


ANNOTATION = ", ann AS (SELECT concat('G', CAST(p_partkey - p_partkey % 10 AS STRING)) AS gene_id, CAST(p_partkey AS INT) AS s, CAST(p_partkey + p_size * 3 AS INT) AS e FROM part)"


def _annotation(spark, sf):
    f = table(spark, sf, "part").selectExpr("concat('G', CAST(p_partkey - p_partkey % 10 AS STRING)) AS gene_id", "CAST(p_partkey AS INT) AS gstart", "CAST(p_partkey + p_size * 3 AS INT) AS gend")
    return H.annotation_arrays(f)


FILLED = """, ex AS (SELECT gr.gene_id, us.site, us.site_type FROM gr JOIN us ON gr.region = us.region AND gr.strand = us.strand AND gr.sample = us.sample AND us.site BETWEEN gr.gstart AND gr.gend),
fi AS (SELECT DISTINCT gr.gene_id, p, t FROM gr JOIN (SELECT gene_id, s AS p, 'exon_start' AS t FROM ann UNION SELECT gene_id, e, 'exon_end' FROM ann) a ON a.gene_id = gr.gene_id AND p BETWEEN gr.gstart AND gr.gend
 WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.gene_id = gr.gene_id AND ex.site = p AND ex.site_type = t)),
al AS (SELECT gene_id, site AS p, site_type AS t, 0 AS filled FROM ex UNION ALL SELECT gene_id, p, t, 1 FROM fi)"""


@query(cte("v_gene", "v_usage") + FRAC + ROWS + ANNOTATION + FILLED + """ SELECT gr.gene_id, coalesce(string_agg(CASE WHEN t = 'exon_end' THEN CAST(p AS STRING) END, ',' ORDER BY p), '') AS exon_ends, coalesce(string_agg(CASE WHEN t = 'exon_start' THEN CAST(p AS STRING) END, ',' ORDER BY p), '') AS exon_starts,
coalesce(CAST(sum(filled) AS BIGINT), 0) AS n_filled FROM gr LEFT JOIN al ON gr.gene_id = al.gene_id GROUP BY gr.gene_id""")
def annotation_fill(spark, sf):
    a = _attached(spark, sf).withColumn("n0", F.size("exon_ends") + F.size("exon_starts"))
    f = H.fill_from_annotation(a, _annotation(spark, sf))
    n = F.size("exon_ends") + F.size("exon_starts") - F.col("n0")
    return f.select("gene_id", F.array_join("exon_ends", ",").alias("exon_ends"), F.array_join("exon_starts", ",").alias("exon_starts"), n.cast("long").alias("n_filled"))


@query(cte("v_gene", "v_usage") + FRAC + ROWS + ANNOTATION + FILLED + """, us2 AS (SELECT DISTINCT gene_id, p, t FROM al), ms AS (SELECT gene_id, string_agg(CAST(p AS STRING), ',' ORDER BY p) AS starts FROM (SELECT DISTINCT gene_id, s AS p FROM ann) x WHERE NOT EXISTS (SELECT 1 FROM us2 WHERE us2.gene_id = x.gene_id AND us2.p = x.p AND t = 'exon_start') GROUP BY gene_id),
me AS (SELECT gene_id, string_agg(CAST(p AS STRING), ',' ORDER BY p) AS ends FROM (SELECT DISTINCT gene_id, e AS p FROM ann) x WHERE NOT EXISTS (SELECT 1 FROM us2 WHERE us2.gene_id = x.gene_id AND us2.p = x.p AND t = 'exon_end') GROUP BY gene_id)
SELECT gene_id, starts, ends, 'holder_holder_holder' AS uid FROM ms JOIN me USING (gene_id)""")
def annotation_holders(spark, sf):
    ann = _annotation(spark, sf)
    h = H.holder_rows(H.fill_from_annotation(_attached(spark, sf), ann), ann)
    return h.withColumns({"starts": F.array_join("starts", ","), "ends": F.array_join("ends", ",")})


VCF = ", vc AS (SELECT region, pos, CASE WHEN orderkey % 5 = 0 THEN concat(ref, 'TTTTTTTTTTTTTTTTTTTTTTTTTTTTTT') ELSE ref END AS ref, CASE WHEN orderkey % 7 = 0 THEN concat(alt, 'GA') ELSE alt END AS alt, orderkey % 6 = 0 AS multi, CASE WHEN orderkey % 4 = 0 THEN '0|0' WHEN status = 'F' THEN '1|0' WHEN status = 'O' THEN '0|1' ELSE '1|1' END AS gt FROM v_variant)"
PAIRS = """, pv AS (SELECT vc.*, g.gene_id, CASE WHEN length(vc.ref) > length(vc.alt) AND vc.pos + length(vc.ref) - 1 > g.gend THEN 'deletion_extends' WHEN multi THEN 'multiallelic' WHEN gt = '0|0' THEN 'homref' ELSE 'kept' END AS reason,
CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) > length(alt) THEN 'deletion' WHEN length(ref) < length(alt) THEN 'insertion' ELSE 'mnv' END AS vtype FROM vc JOIN v_gene g ON vc.region = g.region AND vc.pos BETWEEN g.gstart AND g.gend)"""


def _vcf(spark, sf):
    v = view(spark, sf, "v_variant")
    alt = F.expr("CASE WHEN orderkey % 7 = 0 THEN concat(alt, 'GA') ELSE alt END")
    return v.select(
        "region", "pos", F.expr(f"CASE WHEN orderkey % 5 = 0 THEN concat(ref, '{'T' * 30}') ELSE ref END").alias("ref"),
        F.when(F.col("orderkey") % 6 == 0, F.array(alt, F.lit("N"))).otherwise(F.array(alt)).alias("alts"),
        F.expr("CASE WHEN orderkey % 4 = 0 THEN '0|0' WHEN status = 'F' THEN '1|0' WHEN status = 'O' THEN '0|1' ELSE '1|1' END").alias("gt"),
    )


def _pairs(spark, sf):
    return H.variants_in_genes(_vcf(spark, sf), view(spark, sf, "v_gene"), BIN)


@query(cte("v_gene", "v_variant") + VCF + PAIRS + " SELECT gene_id, count(*) AS n_pairs, count(*) FILTER (WHERE reason = 'kept') AS n_kept, CAST(sum(pos) AS BIGINT) AS sum_pos FROM pv GROUP BY gene_id")
def variants_in_genes(spark, sf):
    return _pairs(spark, sf).groupBy("gene_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("reason") == "kept").alias("n_kept"), F.sum("pos").alias("sum_pos"))


@query(cte("v_gene", "v_variant") + VCF + PAIRS + " SELECT reason, CASE WHEN reason = 'kept' THEN vtype ELSE '-' END AS vtype, count(*) AS n FROM pv GROUP BY 1, 2")
def variant_funnel(spark, sf):
    return H.variant_funnel(_pairs(spark, sf))


HAPS = """, kv AS (SELECT DISTINCT gene_id, pos, concat(region, ':', CAST(pos AS STRING), ':', ref, ':', alt) AS k, a FROM (SELECT *, unnest(CASE WHEN gt = '1|0' THEN ['Paternal'] WHEN gt = '0|1' THEN ['Maternal'] ELSE ['Paternal', 'Maternal'] END) AS a FROM pv WHERE reason = 'kept') x),
hv AS (SELECT gene_id, a, string_agg(k, ',' ORDER BY pos, k) AS vl, count(*) AS n FROM kv GROUP BY gene_id, a),
hp AS (SELECT g.gene_id, g.strand, al.a AS allele, concat('D1_', g.gene_id, '_', al.a) AS uid, coalesce(vl, 'None') AS variant_list, CAST(coalesce(n, 0) AS INT) AS n_variants FROM v_gene g CROSS JOIN (SELECT 'Paternal' AS a UNION ALL SELECT 'Maternal') al LEFT JOIN hv ON hv.gene_id = g.gene_id AND hv.a = al.a)"""


def _haplotypes(spark, sf):
    genes = view(spark, sf, "v_gene").select("gene_id", "region", "strand", "gstart", "gend")
    return H.phased_haplotypes(_pairs(spark, sf), genes, F.lit("D1"))


@query(cte("v_gene", "v_variant") + VCF + PAIRS + HAPS + " SELECT gene_id, allele, uid, variant_list, n_variants FROM hp")
def phased_haplotypes(spark, sf):
    return _haplotypes(spark, sf).select("gene_id", "allele", "uid", "variant_list", "n_variants")


@query(cte("v_gene", "v_variant") + VCF + PAIRS + HAPS + ", x AS (SELECT uid, strand, unnest(range(len(string_split(variant_list, ',')))) AS i, unnest(string_split(variant_list, ',')) AS k FROM hp), c AS (SELECT k, strand FROM x GROUP BY k, strand HAVING count(*) >= 12), f AS (SELECT x.uid, string_agg(x.k, ',' ORDER BY i) AS vl FROM x JOIN c ON x.k = c.k AND x.strand = c.strand GROUP BY x.uid) SELECT hp.uid, coalesce(f.vl, 'None') AS variant_list FROM hp LEFT JOIN f ON hp.uid = f.uid")
def frequent_variants(spark, sf):
    return H.frequent_variants(_haplotypes(spark, sf), 12).select("uid", "variant_list")


@query(cte("v_gene", "v_junction") + ", c AS (SELECT j.region, j.jleft, j.jright, g.gene_id, row_number() OVER (PARTITION BY j.region, j.jleft, j.jright ORDER BY g.gstart, g.gene_id) AS rn FROM (SELECT DISTINCT region, jleft, jright FROM v_junction) j JOIN v_gene g ON g.region = j.region AND g.gstart <= j.jleft AND g.gend >= j.jright) SELECT j.region, j.jleft, j.jright, c.gene_id, count(*) AS n FROM v_junction j LEFT JOIN c ON c.rn = 1 AND c.region = j.region AND c.jleft = j.jleft AND c.jright = j.jright GROUP BY ALL")
def intron_gene(spark, sf):
    j = view(spark, sf, "v_junction").groupBy("region", "jleft", "jright").agg(F.count("*").alias("n"))
    return I.first_containing(j, view(spark, sf, "v_gene"), "jleft", "gstart", "gend", ["region"], "gene_id", BIN, pos_end="jright")


@query(cte("v_gene", "v_usage") + ", s AS (SELECT region, strand, site, count(*) AS n FROM v_usage GROUP BY ALL), c AS (SELECT s.region, s.strand, s.site, arg_min(g.gene_id, (g.gstart, g.gene_id)) AS gene_id FROM s JOIN v_gene g ON g.region = s.region AND g.strand = s.strand AND s.site BETWEEN g.gstart AND g.gend GROUP BY ALL) SELECT s.region, s.strand, s.site, s.n, c.gene_id FROM s LEFT JOIN c USING (region, strand, site)")
def site_gene(spark, sf):
    s = view(spark, sf, "v_usage").groupBy("region", "strand", "site").agg(F.count("*").alias("n"))
    return I.first_containing(s, view(spark, sf, "v_gene"), "site", "gstart", "gend", ["region", "strand"], "gene_id", BIN)


@query(cte("v_gene", "v_variant") + ", m AS (SELECT DISTINCT region, b FROM (SELECT region, gstart AS b FROM v_gene UNION ALL SELECT region, gend FROM v_gene) x), p AS (SELECT DISTINCT region, pos FROM v_variant), d AS (SELECT p.region, p.pos, min(abs(p.pos - m.b)) AS d FROM p JOIN m ON p.region = m.region GROUP BY ALL) SELECT v.var_key, CASE WHEN d.d <= 10 THEN d.d END AS splice_dist FROM v_variant v LEFT JOIN d ON d.region = v.region AND d.pos = v.pos")
def nearest_boundary(spark, sf):
    m = I.boundary_positions(view(spark, sf, "v_gene"), ["region"])
    v = view(spark, sf, "v_variant").select("var_key", "region", "pos")
    return I.nearest_distance(v, m, "pos", "pos", ["region"], max_dist=10).select("var_key", "splice_dist")


@query(cte("v_gene", "v_variant") + ", m AS (SELECT gene_id, gstart AS b FROM v_gene UNION ALL SELECT gene_id, gend FROM v_gene), d AS (SELECT v.var_key, min(abs(v.pos - m.b)) AS d FROM v_variant v JOIN m ON v.gene_id = m.gene_id GROUP BY ALL) SELECT v.var_key, v.gene_id, d.d AS splice_dist FROM v_variant v LEFT JOIN d USING (var_key)")
def nearest_boundary_in_gene(spark, sf):
    m = I.boundary_positions(view(spark, sf, "v_gene"), ["gene_id"])
    v = view(spark, sf, "v_variant").select("var_key", "gene_id", "pos")
    return I.nearest_distance(v, m, "pos", "pos", ["gene_id"]).select("var_key", "gene_id", "splice_dist")


EXONS = ", t AS (SELECT gene_id, region, strand, gstart + 5 AS es, gend + 5 AS ee FROM v_gene), x AS (SELECT t.gene_id, t.es, t.ee, max(CASE WHEN g.gend < t.es THEN g.gend END) AS u, min(CASE WHEN g.gstart > t.ee THEN g.gstart END) AS d FROM t LEFT JOIN v_gene g ON g.region = t.region AND g.strand = t.strand GROUP BY ALL)"


@query(cte("v_gene") + EXONS + " SELECT gene_id, es - u AS up_intron, d - ee AS down_intron, CASE WHEN u IS NULL THEN d - ee WHEN d IS NULL THEN es - u ELSE least(es - u, d - ee) END AS min_intron, CASE WHEN u IS NULL THEN d - ee WHEN d IS NULL THEN es - u ELSE greatest(es - u, d - ee) END AS max_intron, ((es - u) + (d - ee)) / 2 AS mean_intron FROM x")
def flanking_introns(spark, sf):
    g = view(spark, sf, "v_gene")
    t = g.selectExpr("gene_id", "region", "strand", "gstart + 5 AS estart", "gend + 5 AS eend")
    ex = g.selectExpr("region", "strand", "gstart AS estart", "gend AS eend")
    out = I.flanking_introns(t, ex, ["region", "strand"])
    return out.select("gene_id", "up_intron", "down_intron", "min_intron", "max_intron", "mean_intron")


@query(cte("v_gene") + "SELECT brand AS gene_id, min(gstart) AS gstart, max(gend) AS gend, arg_min(region, (gstart, gend, region, strand)) AS region, arg_min(strand, (gstart, gend, region, strand)) AS strand FROM v_gene GROUP BY brand")
def gene_bounds(spark, sf):
    return I.gene_bounds(view(spark, sf, "v_gene").drop("gene_id").withColumnRenamed("brand", "gene_id"))


@query(cte("v_gene") + "SELECT brand, string_agg(CAST(p AS STRING), ',' ORDER BY p) AS positions, count(*) AS n FROM (SELECT DISTINCT brand, unnest([gstart, gend]) AS p FROM v_gene WHERE ptype IN ('PROMO', 'SMALL')) t GROUP BY brand")
def boundary_positions(spark, sf):
    b = I.boundary_positions(view(spark, sf, "v_gene").filter("ptype IN ('PROMO', 'SMALL')"), ["brand"])
    return b.groupBy("brand").agg(F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("positions"), F.count("*").alias("n"))


@query()
def overlap_resolution(spark, sf):
    return I.resolve_overlaps(view(spark, sf, "v_gene"), ["region", "strand"])


@query(cte("v_gene") + """, p AS (SELECT *, max(gend) OVER (PARTITION BY region, strand ORDER BY gstart, gend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT region, strand, gstart, CAST(gstart + p8 AS INT) AS gend, gene_id FROM (SELECT *, (gend - gstart) // 8 AS p8 FROM v_gene) q) z),
i AS (SELECT *, sum(CASE WHEN reach > gstart THEN 0 ELSE 1 END) OVER (PARTITION BY region, strand ORDER BY gstart) AS island FROM p) SELECT gene_id, CAST(island AS BIGINT) AS island FROM i""")
def overlap_islands(spark, sf):
    g = view(spark, sf, "v_gene").withColumn("gend", (F.col("gstart") + F.floor((F.col("gend") - F.col("gstart")) / 8)).cast("int"))
    return I.overlap_islands(g.select("region", "strand", "gstart", "gend", "gene_id"), ["region", "strand"], "gstart", "gend", 256).select("gene_id", F.col("island").cast("long").alias("island"))


@query(cte("v_gene") + "SELECT gene_id, CASE WHEN gene_id IN (SELECT concat('G', CAST(ps AS STRING)) FROM (SELECT CAST(s_suppkey * 7 AS BIGINT) AS ps, s_nationkey FROM supplier) s WHERE s_nationkey % 2 = 0) THEN 1 ELSE 0 END AS paralog_status FROM v_gene")
def paralog_flags(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("G"), (F.col("s_suppkey") * 7).cast("string"), F.lit(".3")).alias("gene"), F.when(F.col("s_nationkey") % 2 == 0, "P").alias("partner"))
    return H.paralog_flag(view(spark, sf, "v_gene"), s).select("gene_id", "paralog_status")


@query(cte("v_gene", "v_variant") + "SELECT gene_id, true AS kept, count(*) AS n FROM v_variant WHERE gene_id IN (SELECT gene_id FROM v_gene WHERE paralog = 1) GROUP BY gene_id UNION ALL SELECT gene_id, false, count(*) FROM v_variant WHERE gene_id NOT IN (SELECT gene_id FROM v_gene WHERE paralog = 1) GROUP BY gene_id")
def key_filters(spark, sf):
    v, k = view(spark, sf, "v_variant"), view(spark, sf, "v_gene").filter("paralog = 1").select("gene_id")
    n = lambda d, flag: d.groupBy("gene_id").agg(F.count("*").alias("n")).withColumn("kept", F.lit(flag))
    return n(J.keep_keys(v, k, ["gene_id"]), True).unionByName(n(J.drop_keys(v, k, ["gene_id"]), False))


@query(cte("v_variant") + ", f AS (SELECT region, pos, ref, unnest([alt, 'N']) AS alt, unnest([pip / 100, 0.5]) AS af FROM v_variant WHERE orderkey % 3 = 0), m AS (SELECT region, pos, ref, alt, max(af) AS af FROM f GROUP BY ALL) SELECT v.var_key, round(m.af, 9) AS af FROM v_variant v LEFT JOIN m USING (region, pos, ref, alt)")
def allele_frequencies(spark, sf):
    v = view(spark, sf, "v_variant")
    f = v.filter("orderkey % 3 = 0").select("region", "pos", "ref", F.array("alt", F.lit("N")).alias("alts"), F.array(F.col("pip") / 100, F.lit(0.5)).alias("afs"))
    return J.allele_frequency(v.select("var_key", "region", "pos", "ref", "alt"), f).select("var_key", F.round("af", 9).alias("af"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality IS NULL) AS n_missing FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def label_merge_check(spark, sf):
    m = J.merge_labels(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"], "quality")
    return J.merge_check(m, "quality")


@query(cte("v_pred", "v_tissue_site") + ", g AS (SELECT pos, CASE WHEN avg(ssu) < 0.3 THEN 'low' ELSE 'high' END AS grp FROM v_tissue_site GROUP BY pos) SELECT coalesce(g.grp, '-1') AS grp, count(*) AS n FROM v_pred LEFT JOIN g USING (pos) GROUP BY 1")
def stratum_labels(spark, sf):
    g = view(spark, sf, "v_tissue_site").groupBy("pos").agg(F.when(F.avg("ssu") < 0.3, "low").otherwise("high").alias("grp"))
    p = view(spark, sf, "v_pred").select("pos")
    return J.with_stratum(p, g, ["pos"], "grp").groupBy("grp").agg(F.count("*").alias("n"))


@query(cte("v_usage", "v_pred") + FRAC + ", sh AS (SELECT region, site FROM us GROUP BY region, site HAVING count(*) = count(ssu) AND count(ssu) = 10) SELECT v.region, v.pos, EXISTS (SELECT 1 FROM sh WHERE sh.region = v.region AND sh.site = v.pos) AS shared, count(*) AS n FROM v_pred v GROUP BY ALL")
def shared_site_flags(spark, sf):
    sh = J.shared_sites(_usage(spark, sf), ["region", "site"], 10).withColumnRenamed("site", "pos")
    p = view(spark, sf, "v_pred").groupBy("region", "pos").agg(F.count("*").alias("n"))
    return J.with_membership(p, sh, ["region", "pos"], "shared")


PAIRED = ", pr AS (SELECT tissue, var_key AS pos_var_key, concat('V', CAST(orderkey + 7 AS STRING)) AS neg_var_key, pip AS pos_pip FROM v_variant WHERE pip >= 0.9), sc AS (SELECT var_key, 'a' AS head, CASE WHEN custkey % 11 = 0 THEN NULL ELSE pip END AS score FROM v_variant UNION ALL SELECT var_key, 'b', (custkey % 97) / 97 FROM v_variant)"


def _pairs_scores(spark, sf):
    v = view(spark, sf, "v_variant")
    pairs = v.filter("pip >= 0.9").selectExpr("tissue", "var_key AS pos_var_key", "concat('V', CAST(orderkey + 7 AS STRING)) AS neg_var_key", "pip AS pos_pip")
    heads = F.inline(F.array(F.struct(F.lit("a").alias("head"), F.when(F.col("custkey") % 11 != 0, F.col("pip")).alias("score")), F.struct(F.lit("b").alias("head"), (F.col("custkey") % 97 / 97).alias("score"))))
    return pairs, v.select("var_key", heads)


LABELLED = ", lp AS (SELECT pr.*, p.head, p.score AS ps, n.score AS ns FROM pr JOIN sc p ON p.var_key = pr.pos_var_key JOIN sc n ON n.var_key = pr.neg_var_key AND n.head = p.head WHERE p.score IS NOT NULL AND n.score IS NOT NULL), lb AS (SELECT tissue, pos_var_key, neg_var_key, head, 1 AS label, pos_var_key AS var_key, ps AS score, pos_pip FROM lp UNION ALL SELECT tissue, pos_var_key, neg_var_key, head, 0, neg_var_key, ns, pos_pip FROM lp)"


@query(cte("v_variant") + PAIRED + LABELLED + " SELECT tissue, head, label, var_key, round(score, 9) AS score FROM lb")
def labelled_pairs(spark, sf):
    pairs, scores = _pairs_scores(spark, sf)
    return J.labelled_pairs(pairs, scores).select("tissue", "head", "label", "var_key", F.round("score", 9).alias("score"))


TISSUES = ["click", "error", "purchase", "signup", "view"]


@query(cte("v_tissue_site") + "SELECT pos, " + ", ".join(f"round(avg(CASE WHEN tissue = '{t}' THEN ssu END), 6) AS mean_{t}, nullif(count(*) FILTER (WHERE tissue = '{t}'), 0) AS n_{t}" for t in TISSUES) + " FROM v_tissue_site GROUP BY pos")
def across_tissues(spark, sf):
    s = view(spark, sf, "v_tissue_site").groupBy("tissue", "pos").agg(F.round(F.avg("ssu"), 6).alias("mean"), F.count("*").alias("n"))
    return J.across_tissues(s, ["pos"], TISSUES, ["mean", "n"])


@query(cte("v_variant") + ", m AS (SELECT gene_id, max(pip) AS pip FROM v_variant WHERE status = 'F' GROUP BY gene_id) SELECT v.var_key, round(coalesce(m.pip, 0), 6) AS pip FROM v_variant v LEFT JOIN m USING (gene_id)")
def pip_lookup(spark, sf):
    v = view(spark, sf, "v_variant")
    return J.pip_or_zero(v.select("var_key", "gene_id"), v.filter("status = 'F'"), ["gene_id"]).select("var_key", F.round("pip", 6).alias("pip"))


@query(cte("v_usage", "v_pred") + FRAC + " SELECT u.sample, u.region, u.site, round(avg(p.head_b), 11) AS pred, round(max(u.ssu), 6) AS ssu FROM us u JOIN v_pred p ON p.sample = u.sample AND p.region = u.region AND p.strand = u.strand AND p.pos = u.site WHERE u.ssu IS NOT NULL GROUP BY ALL")
def site_predictions(spark, sf):
    """Ensemble mean of predictions joined to measured usage by sample and position."""
    p = view(spark, sf, "v_pred").groupBy("sample", "region", "strand", F.col("pos").alias("site")).agg(F.sum("head_b").alias("s"), F.count("*").alias("c"))
    u = _usage(spark, sf).filter("ssu IS NOT NULL")
    j = u.join(p, ["sample", "region", "strand", "site"])
    return j.groupBy("sample", "region", "site").agg(F.round(F.sum("s") / F.sum("c"), 11).alias("pred"), F.round(F.max("ssu"), 6).alias("ssu"))


STAGES = "autosomal AS (SELECT * FROM v_variant WHERE region <> 'chr5'), typed AS (SELECT * FROM autosomal WHERE ref <> alt), strong AS (SELECT * FROM typed WHERE pip >= 0.5)"


@query(cte("v_variant") + ", " + STAGES + """ SELECT 0 AS place, 'all' AS stage, 'n' AS measure, count(*) AS n FROM v_variant UNION ALL SELECT 0, 'all', 'sex_chromosome', count(*) FROM v_variant WHERE region = 'chr5' UNION ALL SELECT 1, 'autosomal', 'n', count(*) FROM autosomal
UNION ALL SELECT 1, 'autosomal', 'same_allele', count(*) FROM autosomal WHERE ref = alt UNION ALL SELECT 2, 'typed', 'n', count(*) FROM typed UNION ALL SELECT 3, 'strong', 'n', count(*) FROM strong""")
def stage_counts(spark, sf):
    """Rows of each stage and reasons of rejection, counted by the one job that writes the result."""
    seen = StageCounts()
    d = seen.watch(view(spark, sf, "v_variant"), "all", sex_chromosome=F.col("region") == "chr5").filter("region <> 'chr5'")
    d = seen.watch(d, "autosomal", same_allele=F.col("ref") == F.col("alt")).filter("ref <> alt")
    d = seen.watch(seen.watch(d, "typed").filter("pip >= 0.5"), "strong")
    d.write.parquet(scratch_dir(spark, "strong-variants"))
    return seen.rows(spark)
