"""Queries over junctions, reads and usage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators import evidence as E
from splicelake.operators import usage as U
from splicelake.plans.registry import query
from splicelake.plans.views import cte, view
from splicelake.session import written

KEY = ["region", "strand", "site", "site_type"]
SAMPLES = [f"S{i}" for i in range(10)]

EDGES = """, j AS (SELECT sample, region, strand, jleft, jright, CAST(sum(n) AS BIGINT) AS n FROM v_junction GROUP BY ALL),
ed AS (SELECT sample, region, strand, jleft AS site, jright AS partner, n FROM j UNION ALL SELECT sample, region, strand, jright, jleft, n FROM j)"""
FRAC = """, fr AS (SELECT sample, region, strand, site, site_type, CAST(sum(alpha) AS BIGINT) AS num, CAST(sum(alpha + beta1) AS BIGINT) AS den FROM v_usage GROUP BY ALL),
us AS (SELECT *, CASE WHEN den >= 5 THEN num / den END AS ssu FROM fr)"""


def _edges(spark, sf):
    return U.edges(view(spark, sf, "v_junction"))


def _usage(spark, sf):
    return U.usage_table(U.fractions(view(spark, sf, "v_usage")))


@query(cte("v_junction") + EDGES + " SELECT sample, region, strand, site, CAST(sum(n) AS BIGINT) AS alpha FROM ed GROUP BY ALL")
def site_alpha(spark, sf):
    return U.alpha(_edges(spark, sf))


@query(cte("v_junction") + EDGES + " SELECT sample, region, strand, site, string_agg(concat(CAST(partner AS STRING), ':', CAST(n AS STRING)), ',' ORDER BY partner) AS partners FROM ed GROUP BY sample, region, strand, site")
def site_partners(spark, sf):
    p = U.partner_lists(_edges(spark, sf))
    text = F.array_join(F.transform(F.map_entries("partners"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return p.withColumn("partners", text)


@query(cte("v_junction") + EDGES + " SELECT DISTINCT a.sample, a.region, a.strand, a.site, b.partner AS competitor FROM ed a JOIN ed b ON a.sample = b.sample AND a.region = b.region AND a.strand = b.strand AND a.partner = b.site WHERE b.partner <> a.site")
def site_competitors(spark, sf):
    return U.competitors(_edges(spark, sf))


@query(cte("v_junction") + EDGES + """, al AS (SELECT sample, region, strand, site, sum(n) AS alpha FROM ed GROUP BY ALL),
pr AS (SELECT a.sample, a.region, a.strand, a.site, a.partner, a.n AS shared, al.alpha AS alpha_p FROM ed a JOIN al ON a.sample = al.sample AND a.region = al.region AND a.strand = al.strand AND a.partner = al.site),
fl AS (SELECT a.sample, a.region, a.strand, a.site, a.partner, sum(b.n) AS flank FROM ed a JOIN ed b ON a.sample = b.sample AND a.region = b.region AND a.strand = b.strand AND a.partner = b.site
  WHERE (a.partner > a.site AND b.partner < a.site) OR (a.partner < a.site AND b.partner > a.site) GROUP BY ALL),
q AS (SELECT pr.*, coalesce(fl.flank, 0) AS flank, greatest(0, alpha_p - shared - coalesce(fl.flank, 0)) AS rest FROM pr LEFT JOIN fl USING (sample, region, strand, site, partner))
SELECT sample, region, strand, site, CAST(sum(shared) AS BIGINT) AS alpha, CAST(sum(flank) AS BIGINT) AS beta2_flank, CAST(sum(rest) AS BIGINT) AS cryptic, round(sum(rest * shared) / sum(shared), 6) AS weighted FROM q GROUP BY sample, region, strand, site""")
def partner_evidence(spark, sf):
    return U.partner_evidence(_edges(spark, sf)).withColumn("weighted", F.round("weighted", 6))


@query(cte("v_usage") + " SELECT sample, region, strand, site, CAST(sum(alpha) AS BIGINT) AS alpha, CAST(sum(beta1) AS BIGINT) AS beta1, round(CASE WHEN sum(alpha + beta1) > 0 THEN sum(alpha) / sum(alpha + beta1) ELSE 0 END, 6) AS sse FROM v_usage GROUP BY sample, region, strand, site")
def site_strength(spark, sf):
    g = view(spark, sf, "v_usage").groupBy("sample", "region", "strand", "site").agg(F.sum("alpha").alias("alpha"), F.sum("beta1").alias("beta1"))
    return g.withColumn("sse", F.round(U.strength(F.col("alpha"), F.col("beta1"), F.lit(0)), 6))


CATALOG = """, st AS (SELECT DISTINCT sample, region, strand, site FROM v_usage),
pc AS (SELECT sample, region, strand, site, CASE WHEN bool_or(d) AND bool_or(u) THEN 'both' WHEN bool_or(d) THEN 'exon_end' WHEN bool_or(u) THEN 'exon_start' ELSE 'unknown' END AS cls FROM (
  SELECT sample, region, strand, site, false AS d, false AS u FROM st UNION ALL SELECT sample, region, strand, site, partner > site, partner < site FROM ed) t GROUP BY sample, region, strand, site),
ct AS (SELECT region, strand, site, CASE WHEN bool_or(cls <> 'unknown') THEN concat_ws(',', CASE WHEN bool_or(cls = 'exon_end') THEN 'exon_end' END, CASE WHEN bool_or(cls = 'exon_start') THEN 'exon_start' END, CASE WHEN bool_or(cls = 'both') THEN 'both' END) ELSE 'unknown' END AS site_type FROM pc GROUP BY region, strand, site)"""


def _catalogue(spark, sf):
    return U.site_catalogue(view(spark, sf, "v_usage").select("sample", "region", "strand", "site"), U.directions(view(spark, sf, "v_junction")))


@query(cte("v_usage", "v_junction") + EDGES + CATALOG + " SELECT region, strand, site, site_type FROM ct")
def site_catalogue(spark, sf):
    return _catalogue(spark, sf)


ANNOT = """, us0 AS (SELECT sample, region, strand, site, CAST(sum(alpha) AS BIGINT) AS alpha FROM v_usage GROUP BY ALL),
an AS (SELECT us0.*, CASE WHEN contains(ct.site_type, ',') OR ct.site_type = 'both' THEN NULL ELSE ct.site_type END AS site_type FROM us0 LEFT JOIN ct USING (region, strand, site)),
sh AS (SELECT sample, region, strand, site + CASE WHEN site_type = 'exon_start' THEN 1 ELSE 0 END AS site, alpha, site_type FROM an)"""


def _annotated(spark, sf):
    u = view(spark, sf, "v_usage").groupBy("sample", "region", "strand", "site").agg(F.sum("alpha").alias("alpha"))
    return U.annotate(u, _catalogue(spark, sf))


@query(cte("v_usage", "v_junction") + EDGES + CATALOG + ANNOT + " SELECT sample, region, strand, site, alpha, site_type FROM an")
def site_annotation(spark, sf):
    return _annotated(spark, sf)


@query(cte("v_usage", "v_junction") + EDGES + CATALOG + ANNOT + ", d AS (SELECT *, count(*) OVER (PARTITION BY sample, region, strand, site) AS c FROM sh WHERE site_type IS NOT NULL) SELECT sample, region, strand, site, alpha, site_type FROM d WHERE c = 1")
def shifted_unique_sites(spark, sf):
    d = U.shift_starts(_annotated(spark, sf).filter("site_type IS NOT NULL"))
    return U.unique_sites(d, ["sample", "region", "strand", "site"])


@query(cte("v_usage", "v_junction") + EDGES + CATALOG + ANNOT + """, g AS (SELECT sample, strand, count(*) AS na, count(site_type) AS nt, max(site_type) AS t FROM sh GROUP BY sample, region, strand, site)
SELECT sample, CAST(sum(na) AS BIGINT) AS n_initial, CAST(sum(na - nt) AS BIGINT) AS n_ambiguous, CAST(sum(CASE WHEN nt > 1 THEN nt ELSE 0 END) AS BIGINT) AS n_duplicate, count(*) FILTER (WHERE nt = 1) AS n_final,
count(*) FILTER (WHERE nt = 1 AND t = 'exon_start' AND strand = '+') AS start_plus, count(*) FILTER (WHERE nt = 1 AND t = 'exon_start' AND strand = '-') AS start_minus,
count(*) FILTER (WHERE nt = 1 AND t = 'exon_end' AND strand = '+') AS end_plus, count(*) FILTER (WHERE nt = 1 AND t = 'exon_end' AND strand = '-') AS end_minus FROM g GROUP BY sample""")
def annotation_summary(spark, sf):
    return U.annotation_summary(_annotated(spark, sf), ["sample"])


@query(cte("v_usage", "v_junction") + EDGES + CATALOG + ANNOT + " SELECT DISTINCT region, strand, site FROM an WHERE site_type IS NULL ORDER BY region, strand, site LIMIT 100")
def dropped_sites_log(spark, sf):
    return U.dropped_sites(_annotated(spark, sf), 100)


@query(cte("v_usage") + FRAC + " SELECT sample, region, strand, site, site_type, CASE WHEN den = 0 THEN '0/0' ELSE concat(CAST(num AS STRING), '/', CAST(den AS STRING)) END AS fraction FROM us")
def usage_fractions(spark, sf):
    return U.fractions(view(spark, sf, "v_usage")).select("sample", *KEY, "fraction")


@query(cte("v_usage") + FRAC + " SELECT region, strand, site, site_type, sum(CAST(floor(ssu * 1000000000) AS BIGINT)) / (count(ssu) * 1000000000) AS pop_mean, count(ssu) AS n_valid, count(*) AS n_samples FROM us GROUP BY ALL HAVING count(ssu) > 0 ORDER BY region, strand, site")
def usage_matrix(spark, sf):
    return U.usage_matrix(_usage(spark, sf)).orderBy("region", "strand", "site", "site_type")


@query(cte("v_usage") + FRAC + " SELECT region, strand, site, site_type, " + ", ".join(f"max(CASE WHEN sample = '{s}' THEN coalesce(round(ssu, 6), 777.0) END) AS {s}" for s in SAMPLES) + " FROM us GROUP BY region, strand, site, site_type")
def wide_usage(spark, sf):
    u = _usage(spark, sf).withColumn("v", F.round(S.to_sentinel(F.col("ssu")), 6))
    return U.wide(u, SAMPLES, "v", KEY)


COUNTS = """, ctb AS (SELECT sample, region, strand, site, CAST(sum(alpha) AS BIGINT) AS alpha, CAST(sum(beta1) AS BIGINT) AS beta1 FROM v_usage GROUP BY ALL),
c2 AS (SELECT *, CAST(beta1 % 3 AS BIGINT) AS beta2, beta1 / 4 AS weighted, CASE WHEN alpha + beta1 > 0 THEN alpha / (alpha + beta1) ELSE 0 END AS sse FROM ctb)"""


def _counts(spark, sf):
    g = view(spark, sf, "v_usage").groupBy("sample", "region", "strand", "site").agg(F.sum("alpha").alias("alpha"), F.sum("beta1").alias("beta1"))
    return g.withColumns({"beta2": F.col("beta1") % 3, "weighted": F.col("beta1") / 4, "sse": U.strength(F.col("alpha"), F.col("beta1"), F.lit(0))})


def _pick(cond, col, name):
    return f"max(CASE WHEN sample = '{name}' AND {cond} THEN {col} END)"


_OK = "alpha + beta1 + beta2 >= 10"


@query(cte("v_usage") + COUNTS + " SELECT region, strand, site, " + ", ".join(f"{_pick(_OK, 'alpha', s)} AS {s}_alpha, {_pick(_OK, 'beta1 + beta2 + weighted', s)} AS {s}_beta, {_pick(_OK, 'round(sse, 6)', s)} AS {s}_sse" for s in SAMPLES) + " FROM c2 GROUP BY region, strand, site")
def differential_table(spark, sf):
    return U.differential_table(_counts(spark, sf).withColumn("sse", F.round("sse", 6)), SAMPLES, 10)


@query(cte("v_usage") + COUNTS + f", p AS (SELECT *, count(*) OVER (PARTITION BY region, strand, site) AS n_pass FROM c2 WHERE {_OK}) SELECT region, strand, site, sample, round(sse, 6) AS sse, n_pass FROM p WHERE n_pass >= 3")
def phenotype_rows(spark, sf):
    return U.phenotype_rows(_counts(spark, sf), 10, 3).select("region", "strand", "site", "sample", F.round("sse", 6).alias("sse"), "n_pass")


@query(cte("v_usage") + FRAC + """, r AS (SELECT *, row_number() OVER (PARTITION BY region, strand, site, site_type ORDER BY ssu, sample) AS rk FROM us WHERE ssu IS NOT NULL)
SELECT region, strand, site, site_type, count(*) AS n, round(avg(ssu), 6) AS mean, round(min(ssu), 6) AS min, round(max(ssu), 6) AS max, round(quantile_cont(ssu, 0.75) - quantile_cont(ssu, 0.25), 6) AS iqr, round(var_pop(ssu), 6) AS var,
round(CASE WHEN count(*) < 2 OR sum(ssu) = 0 THEN 0 ELSE (2 * sum(rk * ssu) - (count(*) + 1) * sum(ssu)) / (count(*) * sum(ssu)) END, 6) AS gini FROM r GROUP BY region, strand, site, site_type""")
def site_statistics(spark, sf):
    s = U.site_statistics(_usage(spark, sf))
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "min", "max", "iqr", "var", "gini")})


@query(cte("v_usage") + FRAC + " SELECT region, strand, site FROM us WHERE region IN ('chr1', 'chr3', 'chr5') GROUP BY region, strand, site HAVING bool_or(coalesce(ssu > 0.5, false))")
def informative_sites(spark, sf):
    u = _usage(spark, sf).withColumn("ssu", F.when(F.col("ssu") > 0.5, F.col("ssu")).otherwise(0.0))
    return U.informative_sites(u, ["region", "strand", "site"], ["chr1", "chr3", "chr5"])


@query(cte("v_usage") + COUNTS + ", st AS (SELECT DISTINCT region, strand, site FROM c2), sm AS (SELECT DISTINCT sample FROM c2) SELECT sample, region, strand, site, c2.alpha, c2.beta1 FROM st CROSS JOIN sm LEFT JOIN c2 USING (sample, region, strand, site)")
def sample_grid(spark, sf):
    c = _counts(spark, sf).select("sample", "region", "strand", "site", "alpha", "beta1")
    return U.sample_grid(c, c, ["region", "strand", "site"])


@query(cte("v_usage") + COUNTS + " SELECT region, strand, site, count(*) FILTER (WHERE alpha + beta1 >= 8 AND sse >= 0.4) AS n_pass FROM c2 GROUP BY region, strand, site HAVING count(*) FILTER (WHERE alpha + beta1 >= 8 AND sse >= 0.4) >= 2")
def shallow_sites(spark, sf):
    return U.shallow_sites(_counts(spark, sf), ["region", "strand", "site"], 2, 8, 0.4)


@query(cte("v_junction") + "SELECT sample, count(*) AS n, CAST(sum(n) AS BIGINT) AS reads FROM v_junction WHERE region = 'chr2' AND jright >= 60 AND jleft <= 340 GROUP BY sample")
def junctions_near_gene(spark, sf):
    return U.near_gene(view(spark, sf, "v_junction"), "chr2", 100, 300, 40).groupBy("sample").agg(F.count("*").alias("n"), F.sum("n").alias("reads"))


# reads as the view builds them: aS qM bN cM dI eM fN 9M with b = 10 l, c = l + 3, e = l + 5, f = 7 (s % 4) + 4
SEGMENTS = """, rd AS (SELECT l_suppkey, concat('S', CAST(l_suppkey % 10 AS STRING)) AS sample, concat('chr', CAST(l_partkey % 5 + 1 AS STRING)) AS region, CAST(l_partkey AS INT) AS p, CAST(l_quantity AS INT) AS q, l_linenumber AS l,
 CASE WHEN l_returnflag = 'A' THEN 64 ELSE 128 END AS first, l_linestatus AS ls, CAST(l_quantity AS INT) % 2 * 2 + CASE WHEN l_returnflag = 'R' THEN 256 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 64 ELSE 128 END AS flag FROM lineitem),
sg AS (SELECT *, p + q AS b1, p + q + 10 * l AS s2, p + q + 10 * l + l + 3 AS b2, p + q + 10 * l + l + 3 + l + 5 AS b3, CAST(p + q + 10 * l + 2 * l + 8 + l_suppkey % 4 * 7 + 4 AS INT) AS s4, CAST(p + q + 10 * l + 2 * l + 8 + l_suppkey % 4 * 7 + 4 + 9 AS INT) AS stop FROM rd)"""


@query("WITH x AS (SELECT 1)" + SEGMENTS + " SELECT sample, region, b1 - 1 AS left, s2 - 1 AS right, count(*) AS n FROM sg GROUP BY ALL UNION ALL SELECT sample, region, b3 - 1, s4 - 1, count(*) FROM sg GROUP BY ALL")
def cigar_gaps(spark, sf):
    r = E.with_walk(E.collapse_reads(view(spark, sf, "v_read")))
    g = r.select("sample", "region", "n_reads", F.posexplode(E.gaps(F.col("walk"))).alias("i", "g"))
    return g.groupBy("sample", "region", "i", "g.left", "g.right").agg(F.sum("n_reads").alias("n")).drop("i")


EVIDENCE = """, ju AS (SELECT sample, region, jl, jr, count(*) AS n FROM (SELECT sample, region, b1 - 1 AS jl, s2 - 1 AS jr FROM sg UNION ALL SELECT sample, region, b3 - 1, s4 - 1 FROM sg) g GROUP BY ALL),
ej AS (SELECT sample, region, jl AS site, jr AS partner, n FROM ju UNION ALL SELECT sample, region, jr, jl, n FROM ju),
ss AS (SELECT DISTINCT sample, region, site FROM ej),
cm AS (SELECT DISTINCT a.sample, a.region, a.site, b.partner AS comp FROM ej a JOIN ej b ON a.sample = b.sample AND a.region = b.region AND a.partner = b.site WHERE b.partner <> a.site),
rc AS (SELECT sample, region, p, b1, s2, b3, s4, stop, flag, count(*) AS n FROM sg GROUP BY ALL),
pl AS (SELECT sample, region, site, list(DISTINCT partner) AS pa FROM ej GROUP BY ALL),
cl AS (SELECT sample, region, site, list(comp) AS co FROM cm GROUP BY ALL),
sl AS (SELECT pl.*, coalesce(cl.co, []) AS co FROM pl LEFT JOIN cl USING (sample, region, site)),
rs AS (SELECT rc.*, sl.site AS t, pa, co FROM rc JOIN sl ON rc.sample = sl.sample AND rc.region = sl.region AND sl.site >= rc.p AND sl.site <= rc.stop - 2),
f1 AS (SELECT *, b1 - 1 AS l1, s2 - 1 AS r1, b3 - 1 AS l2, s4 - 1 AS r2 FROM rs),
f2 AS (SELECT *, (l1 = t OR r1 = t) AS a1, (l1 = t OR r1 = t OR l2 = t OR r2 = t) AS a2, (list_contains(co, r1) AND list_contains(pa, l1)) OR (list_contains(co, l1) AND list_contains(pa, r1)) AS c1,
 (list_contains(co, r2) AND list_contains(pa, l2)) OR (list_contains(co, l2) AND list_contains(pa, r2)) AS c2x FROM f1),
f3 AS (SELECT *, (c1 OR c2x) AS c2, (p <= t AND b1 > t + 1) OR (s2 <= t AND s2 + (b3 - s2) > t + 1 AND s2 <= t AND (b3 > t + 1) AND NOT (t + 1 >= s2 + (b3 - s2))) AS dummy FROM f2)"""


def _evidence(spark, sf):
    """Classified reads, and the edges of all their gaps; strands are not asked for, so flags don't tell reads apart."""
    reads, shapes = E.laid_out(E.collapse_reads(view(spark, sf, "v_read").withColumn("flag", F.lit(0))))
    return E.classify_own(reads, shapes, bin_width=256), E.own_junctions(reads, shapes).withColumn("strand", F.lit("."))


LADDER = """, bl AS (SELECT *, (p <= t AND b1 > t + 1) OR (s2 <= t AND b2 > t + 1) OR (b2 <= t AND b3 > t + 1) OR (s4 <= t AND stop > t + 1) AS be FROM (SELECT f3.*, s2 + (b3 - s2 - 2) // 2 + 0 AS z, CAST((b3 - s2 - 8) // 2 + 3 + s2 AS INT) AS b2 FROM f3) y),
ky AS (SELECT *, CASE WHEN a2 AND c2 THEN 'alpha_comp' WHEN (c1 AND t > l1 AND t < r1) OR (c2 AND t > l2 AND t < r2) THEN 'flank' WHEN (NOT a1 AND NOT c1 AND t > l1 AND t < r1) OR (NOT a2 AND NOT c2 AND t > l2 AND t < r2) THEN 'mutex' WHEN be AND c2 THEN 'beta1_comp' WHEN be THEN 'beta1' END AS cls FROM bl)"""


@query("WITH x AS (SELECT 1)" + SEGMENTS + EVIDENCE + LADDER + """ SELECT sample, region, t AS site, CAST(sum(CASE WHEN cls = 'beta1' THEN n ELSE 0 END) AS BIGINT) AS beta1, CAST(sum(CASE WHEN cls IN ('mutex', 'beta1_comp', 'flank') THEN n ELSE 0 END) AS BIGINT) AS beta2,
CAST(sum(CASE WHEN cls = 'alpha_comp' THEN n ELSE 0 END) AS BIGINT) AS alpha_comp FROM ky WHERE cls IS NOT NULL GROUP BY ALL""")
def read_evidence(spark, sf):
    c, _ = _evidence(spark, sf)
    return E.evidence_counts(c, "reads").drop("strand")


@query("WITH x AS (SELECT 1)" + SEGMENTS + EVIDENCE + LADDER + """, db AS (SELECT sample, region, t, n, cls, unnest(list_distinct(list_intersect(pa, [l1, r1, l2, r2]))) AS partner, CASE WHEN l2 = t THEN r2 WHEN r2 = t THEN l2 WHEN r1 = t THEN l1 WHEN l1 = t THEN r1 END AS used FROM ky WHERE cls IN ('alpha_comp', 'beta1_comp'))
SELECT sample, region, t AS site, partner, CAST(sum(n) AS BIGINT) AS n_double FROM db WHERE cls = 'beta1_comp' OR partner <> used GROUP BY ALL""")
def read_double_counts(spark, sf):
    c, _ = _evidence(spark, sf)
    return E.double_counts(c).drop("strand")


@query()
def strength_with_cryptic(spark, sf):
    """Strength with weighted cryptic evidence from all reads and all their junctions together."""
    c, e = _evidence(spark, sf)
    c = written(c, "classes")
    ev = E.evidence_counts(c, "junction")
    pe = U.partner_evidence(e, E.double_counts(c))
    j = pe.join(ev.drop("alpha_comp"), ["sample", "region", "strand", "site"], "left").na.fill(0, ["beta1", "beta2"])
    total = F.col("beta2") + F.col("beta2_flank")
    return j.withColumn("sse", F.round(U.strength(F.col("alpha"), F.col("beta1"), total, F.col("weighted")), 6))


@query("WITH x AS (SELECT 1)" + SEGMENTS + """, st AS (SELECT DISTINCT region, b1 - 1 AS site FROM sg), sm AS (SELECT DISTINCT sample FROM sg), h AS (SELECT sample, region, b1 - 1 AS site, count(*) AS alpha FROM sg GROUP BY ALL),
rc AS (SELECT sample, region, p, b1, s2, CAST(s2 + l + 3 AS INT) AS b2, b3, s4, stop, count(*) AS n FROM sg GROUP BY ALL),
ev AS (SELECT rc.sample, rc.region, st.site, sum(CASE WHEN (st.site > b1 - 1 AND st.site < s2 - 1 AND true) OR (st.site NOT IN (b1 - 1, s2 - 1, b3 - 1, s4 - 1) AND st.site > b3 - 1 AND st.site < s4 - 1) THEN n ELSE 0 END) AS m,
 sum(CASE WHEN NOT ((st.site > b1 - 1 AND st.site < s2 - 1) OR (st.site > b3 - 1 AND st.site < s4 - 1)) AND ((p <= st.site AND b1 > st.site + 1) OR (s2 <= st.site AND b2 > st.site + 1) OR (b2 <= st.site AND b3 > st.site + 1) OR (s4 <= st.site AND stop > st.site + 1)) THEN n ELSE 0 END) AS b
 FROM rc JOIN st ON rc.region = st.region AND st.site >= rc.p AND st.site <= rc.stop - 2 GROUP BY ALL)
SELECT sample, region, site, h.alpha IS NOT NULL AS measured, coalesce(h.alpha, 0) AS alpha, CAST(CASE WHEN h.alpha IS NULL THEN coalesce(ev.b, 0) ELSE 0 END AS BIGINT) AS beta1, CAST(CASE WHEN h.alpha IS NULL THEN coalesce(ev.m, 0) ELSE 0 END AS BIGINT) AS beta2,
round(CASE WHEN coalesce(h.alpha, 0) > 0 THEN 1.0 ELSE 0.0 END, 6) AS sse FROM st CROSS JOIN sm LEFT JOIN h USING (sample, region, site) LEFT JOIN ev USING (sample, region, site)""")
def filled_samples(spark, sf):
    v = view(spark, sf, "v_read")
    reads, shapes = E.laid_out(E.collapse_reads(v.withColumn("flag", F.lit(0))))
    first = reads.join(shapes.select("shape", F.get("gaps", F.lit(0))["left"].alias("left")), "shape").withColumn("site", F.col("left") + F.col("pos"))
    have = first.groupBy("sample", "region", "site").agg(F.sum("n_reads").alias("alpha"))
    # every position measured in any sample gets read evidence in each sample that covers it
    return E.fill_samples(reads, shapes, have, v.select("sample").distinct(), bin_width=256).withColumn("sse", F.round("sse", 6))


@query(cte("v_gene") + SEGMENTS + """, rc AS (SELECT sample, region, p, b1, s2, CAST(s2 + l + 3 AS INT) AS b2, b3, s4, stop, flag, q, l, l_suppkey % 4 AS k, count(*) AS n FROM sg GROUP BY ALL),
hit AS (SELECT rc.*, g.gene_id FROM rc JOIN (SELECT region, gene_id, gstart * 20 AS gs, gstart * 19 + gend AS ge FROM v_gene) g ON g.region = rc.region WHERE (p * 20 <= ge AND p * 19 + b1 - 1 >= gs) OR (p * 19 + s2 <= ge AND p * 19 + b3 - 1 >= gs) OR (p * 19 + s4 <= ge AND p * 19 + stop - 1 >= gs)),
o AS (SELECT sample, region, p, flag, q, l, k, min(gene_id) AS gene_id, max(gene_id) AS g2, any_value(n) AS n FROM hit GROUP BY sample, region, p, flag, q, l, k) SELECT sample, gene_id, CAST(sum(n) AS BIGINT) AS n FROM o WHERE gene_id = g2 GROUP BY ALL""")
def gene_read_counts(spark, sf):
    """All genes at their real lengths; starts of genes and reads stand 20 times as far apart, since the genes of the table lie on top of one another."""
    exons = view(spark, sf, "v_gene").selectExpr("region", "gene_id", "strand", "gstart * 20 AS gstart", "gstart * 19 + gend AS gend")
    reads = view(spark, sf, "v_read").withColumns({"pos": F.col("pos") * 20, "flag": F.lit(0)})  # strands are not asked for
    return E.gene_counts(E.collapse_reads(reads), exons, bin_width=256)


@query(cte("v_read") + ", r AS (SELECT sample, mapq % 7 * 10 + flag % 3 AS read_length, row_number() OVER (PARTITION BY sample ORDER BY qname) AS rn FROM v_read), g AS (SELECT sample, read_length, count(*) AS n FROM r WHERE rn <= 500 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, read_length DESC) AS k FROM g) SELECT sample, read_length, n FROM b WHERE k = 1")
def common_read_length(spark, sf):
    v = view(spark, sf, "v_read").selectExpr("sample", "qname", "mapq % 7 * 10 + flag % 3 AS read_length")
    return U.common_read_length(v, 500)
