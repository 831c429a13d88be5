"""Queries over sequences, windows, score tracks and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicelake.functions.stats import correlation
from splicelake.functions import sequence as Q
from splicelake.functions import tracks as K
from splicelake.operators import windows as W
from splicelake.operators.pieces import edited_rows
from splicelake.operators.usage import site_statistics
from splicelake.plans.metric_plans import rounded
from splicelake.plans.registry import query
from splicelake.plans.views import cte, table, view

CHUNK = 512
BASES = "regexp_replace(seq, '[^ACGT]', 'N', 'g')"
SQ = f", sq AS (SELECT doc_id, {BASES} AS seq FROM v_seq)"


def _seq(spark, sf):
    return view(spark, sf, "v_seq").select("doc_id", F.regexp_replace("seq", "[^ACGT]", "N").alias("seq"))


def _chunks(spark, sf):
    return W.genome_chunks(_seq(spark, sf).withColumnRenamed("doc_id", "chrom"), CHUNK)


def _on_documents(spark, sf):
    """Orders dealt to documents with a text, fifteen to each, with the document's length."""
    o = table(spark, sf, "orders").withColumn("chrom", F.floor(F.col("o_orderkey") / 15).cast("long"))
    return o.join(_seq(spark, sf).select(F.col("doc_id").alias("chrom"), F.length("seq").alias("n_bases")).filter("n_bases > 0"), "chrom")


# variants on documents, anywhere in their texts: fifteen per document, reference allele read from the text, some wrong on purpose
DV = SQ + """, dv0 AS (SELECT o_orderkey AS k, o_orderkey // 15 AS doc_id, CAST(o_orderkey * 37 % length(seq) + 1 AS INT) AS pos, CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE 1 END AS rl, CASE WHEN o_custkey % 7 = 0 THEN 'GAT' ELSE substring('ACGT', CAST(o_custkey % 4 + 1 AS INT), 1) END AS alt, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_custkey % 11 = 0 AS wrong FROM orders JOIN sq ON sq.doc_id = o_orderkey // 15 WHERE length(seq) > 0),
dv AS (SELECT k, dv0.doc_id, pos, CASE WHEN wrong THEN 'X' ELSE substring(seq, pos, rl) END AS ref, alt, strand, seq FROM dv0 JOIN sq ON sq.doc_id = dv0.doc_id WHERE pos + rl - 1 <= length(seq))"""


def _doc_variants(spark, sf):
    o = _on_documents(spark, sf).selectExpr(
        "o_orderkey AS k", "chrom", "CAST(o_orderkey * 37 % n_bases + 1 AS INT) AS pos", "CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE 1 END AS rl",
        "CASE WHEN o_custkey % 7 = 0 THEN 'GAT' ELSE substring('ACGT', CAST(o_custkey % 4 + 1 AS INT), 1) END AS alt", "CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "o_custkey % 11 = 0 AS wrong",
    ).withColumns({"lo": F.col("pos") - 1, "hi": F.col("pos") - 1 + F.col("rl")})
    f = W.fetch(o, _chunks(spark, sf), CHUNK, ["k"], out="got", pad=False).filter(F.length("got") == F.col("rl"))
    return f.select("k", "chrom", "pos", F.when(F.col("wrong"), "X").otherwise(F.col("got")).alias("ref"), "alt", "strand")


@query(cte("v_seq") + SQ + ", st AS (SELECT o_orderkey AS k, o_orderkey * 31 % length(seq) - 40 AS lo, seq FROM orders JOIN sq ON sq.doc_id = o_orderkey // 15 WHERE length(seq) > 0) SELECT k, rpad(concat(repeat('N', greatest(0, CAST(-lo AS INT))), substring(seq, CAST(greatest(lo, 0) + 1 AS INT), CAST(lo + 940 - greatest(lo, 0) AS INT))), 940, 'N') AS seq FROM st")
def range_fetch(spark, sf):
    r = _on_documents(spark, sf).selectExpr("o_orderkey AS k", "chrom", "CAST(o_orderkey * 31 % n_bases - 40 AS INT) AS lo", "CAST(o_orderkey * 31 % n_bases + 900 AS INT) AS hi")
    return W.fetch(r, _chunks(spark, sf), CHUNK, ["k"], longest=940).select("k", "seq")


# one row per document: strand, interval, sites and a variant list
ROWS = DV + """, vl AS (SELECT doc_id, string_agg(concat('d:', CAST(pos + 1000 AS STRING), ':', ref, ':', alt), ',' ORDER BY pos, ref, alt) AS variant_list FROM dv GROUP BY doc_id),
hr AS (SELECT sq.doc_id AS uid, CASE WHEN sq.doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 1001 AS gstart, CAST(1000 + length(seq) AS INT) AS gend, seq, coalesce(variant_list, 'None') AS variant_list FROM sq LEFT JOIN vl USING (doc_id))"""


def _rows(spark, sf):
    v = _doc_variants(spark, sf)
    key = F.concat_ws(":", F.lit("d"), (F.col("pos") + 1000).cast("string"), "ref", "alt")
    vl = v.groupBy(F.col("chrom").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt", key.alias("vk")))), lambda x: x["vk"]), ",").alias("variant_list"))
    s = _seq(spark, sf).join(vl, "doc_id", "left")
    step = lambda off: F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.length("seq") / 300).cast("int"), F.lit(1))), lambda i: (1000 + i * 300 - off).cast("int"))
    ssu = lambda a: F.transform(a, lambda p: F.when(p % 7 == 0, 777.0).otherwise(p % 10 / 10))
    d = s.select(
        F.col("doc_id").alias("uid"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(1001).alias("gstart"), (1000 + F.length("seq")).cast("int").alias("gend"),
        "seq", F.coalesce("variant_list", F.lit("None")).alias("variant_list"), step(50).alias("exon_ends"), step(0).alias("exon_starts"),
    )
    return d.withColumns({"exon_end_ssus": ssu("exon_ends"), "exon_start_ssus": ssu("exon_starts")})


@query(cte("v_seq") + DV + " SELECT k, CAST(coalesce(sum(length(alt) - length(ref)) OVER (PARTITION BY doc_id ORDER BY pos, ref, alt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM dv")
def variant_shifts(spark, sf):
    v = _doc_variants(spark, sf)
    # a variant listed more than once moves its own later rows, so k fixes their order
    return W.variant_shifts(v, "chrom", ["k"]).select("k", F.col("shift").cast("long").alias("shift"))


@query()
def adjusted_sites(spark, sf):
    a = edited_rows(_rows(spark, sf), seq=None)
    return a.select("uid", "gend", "original_end", "n_dropped", F.array_join("exon_ends", ",").alias("exon_ends"), F.array_join("exon_starts", ",").alias("exon_starts"))


# single-base variants only: the result can be stated position by position
@query(cte("v_seq") + ROWS + """, sv AS (SELECT doc_id, pos, min(ref) AS ref, min(alt) AS alt FROM dv WHERE length(ref) = 1 AND length(alt) = 1 GROUP BY doc_id, pos HAVING count(*) = 1), ok AS (SELECT sv.doc_id, sv.pos, sv.alt FROM sv JOIN sq USING (doc_id) WHERE substring(seq, sv.pos, 1) = sv.ref),
pc AS (SELECT ok.*, lag(pos, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS pv FROM ok), ch AS (SELECT sq.doc_id, concat(coalesce(string_agg(concat(substring(seq, pv + 1, pos - pv - 1), pc.alt), '' ORDER BY pos), ''), substring(any_value(seq), coalesce(max(pos), 0) + 1)) AS s FROM sq LEFT JOIN pc ON pc.doc_id = sq.doc_id GROUP BY sq.doc_id) SELECT doc_id AS uid, s AS seq FROM ch""")
def snv_sequences(spark, sf):
    r = _rows(spark, sf)
    v = F.filter(W.parse_variants(F.col("variant_list")), lambda x: (F.length(x["ref"]) == 1) & (F.length(x["alt"]) == 1))
    # a document without a text is a row too
    d = r.withColumn("seq", F.coalesce("seq", F.lit(""))).withColumn("_v", W.usable_variants(v, F.col("seq"), F.col("gstart")))
    return d.select("uid", W.apply_variants(F.col("_v"), F.col("seq"), F.col("gstart")).alias("seq"))


@query()
def mutated_sequences(spark, sf):
    return edited_rows(_rows(spark, sf), positions=()).select("uid", "seq", "n_variants", "n_applied")


LAB = """, st AS (SELECT uid, strand, gstart, gend, 1000 + i * 300 - 50 AS p, 'e' AS t FROM hr CROSS JOIN LATERAL (SELECT unnest(range(1, CAST(greatest(length(seq) // 300, 1) AS BIGINT) + 1)) AS i) r UNION ALL SELECT uid, strand, gstart, gend, 1000 + i * 300, 's' FROM hr CROSS JOIN LATERAL (SELECT unnest(range(1, CAST(greatest(length(seq) // 300, 1) AS BIGINT) + 1)) AS i) r),
lb AS (SELECT uid, CASE WHEN strand = '+' THEN p - gstart ELSE gend - p END AS off, CASE WHEN p % 7 = 0 THEN 0 WHEN (t = 'e') = (strand = '+') THEN 2 ELSE 1 END AS cls, CASE WHEN p % 7 = 0 THEN 777.0 ELSE round(p % 10 / 10, 1) END AS ssu FROM st WHERE p BETWEEN gstart AND gend)"""


POP = LAB.replace("AS ssu FROM st", "AS ssu, round(p % 9 / 9, 6) AS pop, round(p % 10 / 10 - p % 9 / 9, 6) AS diff FROM st")


@query(cte("v_seq") + ROWS + POP + " SELECT uid, CAST(off AS INT) AS off, cls, CAST(ssu AS DOUBLE) AS ssu, pop, diff FROM lb")
def population_offsets(spark, sf):
    """Labels with two more values for each site: the population's usage and the difference from it."""
    r = _rows(spark, sf)
    for side in ("exon_end", "exon_start"):
        r = r.withColumn(f"{side}_pop", F.transform(f"{side}s", lambda p: p % 9 / 9)).withColumn(f"{side}_diff", F.transform(f"{side}s", lambda p: p % 10 / 10 - p % 9 / 9))
    labels = W.site_labels(r, extra=("pop", "diff"))
    return labels.select("uid", "off", "cls", "ssu", F.round("pop", 6).alias("pop"), F.round("diff", 6).alias("diff"))


@query(cte("v_seq") + ROWS + LAB + " SELECT uid, CAST(off AS INT) AS off, cls, CAST(ssu AS DOUBLE) AS ssu FROM lb")
def site_offsets(spark, sf):
    return W.site_labels(_rows(spark, sf)).select("uid", "off", "cls", F.round("ssu", 1).alias("ssu"))


WIN = """, tr AS (SELECT uid, strand, gstart, gend, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS t FROM hr WHERE length(seq) > 0),
wn AS (SELECT tr.*, CAST(i AS INT) AS window_idx, substring(concat(repeat('N', 5000), t, repeat('N', 10000)), CAST(i * 5000 + 1 AS INT), 15000) AS x FROM tr CROSS JOIN LATERAL (SELECT unnest(range(CAST(ceil(length(t) / 5000) AS BIGINT))) AS i) r),
ws AS (SELECT uid, CAST(off // 5000 AS INT) AS window_idx, string_agg(concat(CAST(off % 5000 AS STRING), ':', CAST(cls AS STRING)), ',' ORDER BY off) AS sites, count(*) AS n_sites FROM lb GROUP BY ALL)"""


def _windows(spark, sf, keep_empty=False):
    r = _rows(spark, sf)
    return W.cut_windows(r.select("uid", "strand", "gstart", "gend", "seq"), W.site_labels(r), "uid", W.BLOCK, W.CONTEXT, keep_empty)


@query(cte("v_seq") + ROWS + LAB + WIN + " SELECT uid, window_idx, x, sites, n_sites FROM wn JOIN ws USING (uid, window_idx)")
def labelled_windows(spark, sf):
    w = _windows(spark, sf)
    txt = F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["off"].cast("string"), s["cls"].cast("string"))), ",")
    return w.select("uid", "window_idx", "x", txt.alias("sites"), F.size("sites").cast("long").alias("n_sites"))


@query(cte("v_seq") + ROWS + LAB + WIN + " SELECT uid, window_idx, CASE WHEN strand = '+' THEN gstart + window_idx * 5000 ELSE gend - window_idx * 5000 END AS first_pos, CASE WHEN window_idx * 5000 + 4999 > gend - gstart THEN -1 WHEN strand = '+' THEN gstart + window_idx * 5000 + 4999 ELSE gend - window_idx * 5000 - 4999 END AS last_pos, coalesce(n_sites, 0) AS n_sites FROM wn LEFT JOIN ws USING (uid, window_idx)")
def window_coordinates(spark, sf):
    w = _windows(spark, sf, True)
    pos = lambda off: W.genomic_position(F.col("strand"), F.col("gstart"), F.col("gend"), F.col("window_idx"), F.lit(off), W.BLOCK)
    return w.select("uid", "window_idx", pos(0).alias("first_pos"), pos(W.BLOCK - 1).alias("last_pos"), F.size("sites").cast("long").alias("n_sites"))


@query(cte("v_seq") + ROWS + LAB + WIN + ", fo AS (SELECT c_custkey % 1000 AS uid, c_nationkey % 4 AS fold FROM customer GROUP BY ALL) SELECT fold, count(*) AS n_windows, count(DISTINCT uid) AS n_rows FROM wn JOIN ws USING (uid, window_idx) JOIN fo USING (uid) GROUP BY fold")
def fold_routing(spark, sf):
    f = table(spark, sf, "customer").selectExpr("c_custkey % 1000 AS uid", "c_nationkey % 4 AS fold")
    return W.route_to_folds(_windows(spark, sf), f).groupBy("fold").agg(F.count("*").alias("n_windows"), F.count_distinct("uid").alias("n_rows"))


# windows of the published sizes; whole sequences are compared by length and digest
VARIANT_WINDOW, FLANK = 20_001, 5_000
_H, _L = VARIANT_WINDOW // 2, 2 * FLANK + 1


def _digests(df, *columns):
    return [e for c in columns for e in (F.length(c).alias(f"{c}_length"), F.md5(c).alias(f"{c}_md5"))]


def _sql_digests(**columns):
    return ", ".join(f"length({e}) AS {c}_length, md5({e}) AS {c}_md5" for c, e in columns.items())


VW = f""", vw AS (SELECT k, ref, alt, strand, seq, pos, pos - {_H + 1} >= 0 AND pos + {_H} + greatest(length(ref) - length(alt), 0) <= length(seq) AS inb, substring(seq, pos, length(ref)) = ref AS okr FROM dv),
vs AS (SELECT k, CASE WHEN NOT inb THEN 'out_of_bounds' WHEN NOT okr THEN 'ref_mismatch' ELSE 'ok' END AS status, strand, substring(seq, pos - {_H}, {VARIANT_WINDOW}) AS r, substring(concat(substring(seq, pos - {_H}, {_H}), alt, substring(seq, pos + length(ref), {_H + 3})), 1, {VARIANT_WINDOW}) AS a FROM vw),
vo AS (SELECT k, status, CASE WHEN status = 'ok' THEN CASE WHEN strand = '-' THEN reverse(translate(r, 'ACGT', 'TGCA')) ELSE r END END AS r, CASE WHEN status = 'ok' THEN CASE WHEN strand = '-' THEN reverse(translate(a, 'ACGT', 'TGCA')) ELSE a END END AS a FROM vs)"""


@query(cte("v_seq") + DV + VW + " SELECT k, status, " + _sql_digests(ref_seq="r", alt_seq="a") + " FROM vo")
def variant_windows(spark, sf):
    w = W.variant_windows(_doc_variants(spark, sf), _chunks(spark, sf), CHUNK, VARIANT_WINDOW, ["k"])
    return w.select("k", "status", *_digests(w, "ref_seq", "alt_seq"))


BW = f""", bw AS (SELECT k, ref, alt, pos, concat(repeat('N', {_L}), seq, repeat('N', {_L})) AS s, CAST(pos + k % 50 - 25 AS INT) AS c, length(seq) AS n, seq FROM dv),
bx AS (SELECT *, pos - (c - {FLANK}) AS idx, greatest(length(ref) - length(alt), 0) AS g, substring(s, c - {FLANK} + {_L}, {_L}) AS r, substring(seq, pos, length(ref)) = ref AS okr FROM bw),
by2 AS (SELECT *, concat(substring(s, c - {FLANK} - g + {_L}, g + idx), alt, substring(s, pos + length(ref) + {_L}, {_L} - idx - length(ref) + g)) AS e FROM bx),
bo AS (SELECT k, CASE WHEN okr THEN 'ok' ELSE 'ref_mismatch' END AS status, CASE WHEN okr THEN r END AS r, CASE WHEN okr THEN CASE WHEN idx < {FLANK} THEN substring(e, CAST(length(e) - g - {_L} + 1 AS INT), {_L}) ELSE substring(e, g + 1, {_L}) END END AS a FROM by2)"""


@query(cte("v_seq") + DV + BW + " SELECT k, status, " + _sql_digests(ref_seq="r", alt_seq="a") + " FROM bo")
def boundary_windows(spark, sf):
    v = _doc_variants(spark, sf).withColumn("centre", (F.col("pos") + F.col("k") % 50 - 25).cast("int"))
    w = W.boundary_windows(v, _chunks(spark, sf), CHUNK, FLANK, ["k"])
    return w.select("k", "status", *_digests(w, "ref_seq", "alt_seq"))


# contigs without the blanks between words, which would act as N in every long window
SITES = f""", sp AS (SELECT doc_id, regexp_replace(regexp_replace(seq, '[ \\n]', '', 'g'), '[^ACGT]', 'N', 'g') AS seq FROM v_seq),
si AS (SELECT o_orderkey AS k, seq, CAST(o_orderkey * 53 % greatest(coalesce(length(seq), 1), 1) + 1 AS INT) AS p, sp.doc_id IS NULL AS unknown FROM orders LEFT JOIN sp ON sp.doc_id = o_orderkey // 14),
sw AS (SELECT k, CASE WHEN unknown THEN 'unknown_chrom' WHEN p - {FLANK + 1} < 0 OR p + {FLANK} > length(seq) THEN 'out_of_bounds' WHEN contains(substring(seq, p - {FLANK}, {_L}), 'N') THEN 'has_n' ELSE 'ok' END AS reason, substring(seq, p - {FLANK}, {_L}) AS w FROM si),
so AS (SELECT k, reason, CASE WHEN reason = 'ok' THEN w END AS w FROM sw)"""


def _site_windows(spark, sf):
    contigs = view(spark, sf, "v_seq").select(F.col("doc_id").alias("chrom"), F.regexp_replace(F.regexp_replace("seq", "[ \\n]", ""), "[^ACGT]", "N").alias("seq"))
    n = contigs.select("chrom", F.length("seq").alias("n_bases"))
    s = table(spark, sf, "orders").withColumn("chrom", F.floor(F.col("o_orderkey") / 14).cast("long")).join(n, "chrom", "left")
    s = s.selectExpr("o_orderkey AS k", "chrom", "CAST(o_orderkey * 53 % greatest(coalesce(n_bases, 1), 1) + 1 AS INT) AS site", "'+' AS strand")
    return W.site_windows(s, W.genome_chunks(contigs, CHUNK), n, CHUNK, FLANK, ["k"])


@query(cte("v_seq") + SQ + SITES + " SELECT k, reason, " + _sql_digests(window="w") + " FROM so")
def site_windows(spark, sf):
    w = _site_windows(spark, sf)
    return w.select("k", "reason", *_digests(w, "window"))


VALUES = ("n", "mean", "min", "max", "iqr", "var", "gini")


@query(cte("v_seq", "v_tissue_site") + SQ + SITES + """, us AS (SELECT pos, sample, avg(ssu) AS ssu FROM v_tissue_site GROUP BY ALL), ur AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY ssu, sample) AS rk FROM us WHERE ssu IS NOT NULL),
ss AS (SELECT pos, count(*) AS n, avg(ssu) AS mean, min(ssu) AS min, max(ssu) AS max, quantile_cont(ssu, 0.75) - quantile_cont(ssu, 0.25) AS iqr, var_pop(ssu) AS var,
CASE WHEN count(*) < 2 OR sum(ssu) = 0 THEN 0 ELSE (2 * sum(rk * ssu) - (count(*) + 1) * sum(ssu)) / (count(*) * sum(ssu)) END AS gini FROM ur GROUP BY pos)
SELECT k, CASE WHEN reason = 'ok' AND n IS NULL THEN 'no_statistics' ELSE reason END AS reason, md5(w) AS window_md5, n, """ + ", ".join(f"round({c}, 6) AS {c}" for c in VALUES[1:]) + " FROM so LEFT JOIN ss ON pos = k % 20000")
def site_windows_with_statistics(spark, sf):
    """Each window with n, mean, range, IQR, variance and Gini of its site's usage over the samples."""
    u = view(spark, sf, "v_tissue_site").groupBy("pos", "sample").agg(F.avg("ssu").alias("ssu"))
    w = _site_windows(spark, sf).withColumn("pos", (F.col("k") % 20000).cast("int"))
    d = W.with_site_statistics(w, site_statistics(u, ["pos"]), ["pos"], VALUES)
    return d.select("k", "reason", F.md5("window").alias("window_md5"), "n", *[F.round(c, 6).alias(c) for c in VALUES[1:]])


@query(cte("v_seq") + SQ + SITES + " SELECT reason, count(*) AS n FROM so GROUP BY 1")
def skip_reasons(spark, sf):
    return W.reason_counts(_site_windows(spark, sf))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), p AS (SELECT i, least(i // (n // 7), 6) AS part FROM r) SELECT CAST(part AS INT) AS part, min(i) AS first_index, max(i) AS last_index, count(*) AS n FROM p GROUP BY part")
def even_split(spark, sf):
    return W.part_ranges(W.even_parts(table(spark, sf, "documents").select("doc_id"), "doc_id", 7))


@query(cte("v_gene") + ", e AS (SELECT brand, region, strand, gstart, gend FROM v_gene WHERE brand <> 'Brand#3' AND paralog = 0), b AS (SELECT brand, min(gstart) AS s, max(gend) AS x FROM e GROUP BY brand), t AS (SELECT DISTINCT e.brand, gstart AS p, 's' AS k FROM e JOIN b USING (brand) WHERE gstart <> s UNION SELECT e.brand, gend, 'e' FROM e JOIN b USING (brand) WHERE gend <> x) SELECT brand AS gene_id, string_agg(CASE WHEN k = 's' THEN CAST(p AS STRING) END, ',' ORDER BY p) AS exon_starts, string_agg(CASE WHEN k = 'e' THEN CAST(p AS STRING) END, ',' ORDER BY p) AS exon_ends, min(p) AS gstart, max(p) AS gend FROM t GROUP BY brand")
def canonical_rows(spark, sf):
    g = view(spark, sf, "v_gene").filter("paralog = 0").drop("gene_id").withColumnRenamed("brand", "gene_id")
    c = W.canonical_rows(g, g.filter("gene_id = 'Brand#3'").select("gene_id"))
    return c.select("gene_id", F.array_join("exon_starts", ",").alias("exon_starts"), F.array_join("exon_ends", ",").alias("exon_ends"), "gstart", "gend")


# --- tracks -----------------------------------------------------------------------------------------------------

D = "list_transform(range(1, 65), lambda i: abs(alt[i]::DOUBLE - ref[i]::DOUBLE))"


@query(cte("v_track") + f", d AS (SELECT var_id, {D} AS d FROM v_track), m AS (SELECT var_id, list_max(d[23:43]) AS mx, d[23:43] AS w, list_max(d) AS full_max FROM d) SELECT var_id, round(mx, 6) AS delta, CAST(list_position(w, mx) - 1 - 10 AS INT) AS off, round(full_max, 6) AS full_delta FROM m")
def delta_scores(spark, sf):
    v = view(spark, sf, "v_track")
    return v.select("var_id", F.round(K.delta_score(F.col("ref"), F.col("alt"), 10), 6).alias("delta"), K.delta_offset(F.col("ref"), F.col("alt"), 10).alias("off"), F.round(K.delta_score_channels(F.array("ref", "ref"), F.array("alt", "alt")), 6).alias("full_delta"))


@query(cte("v_track") + """, r AS (SELECT var_id, CASE var_id % 3 WHEN 0 THEN list_concat(alt[1:32], [list_max(alt[33:35])], alt[36:64]) WHEN 1 THEN alt ELSE list_concat(alt[1:33], [0::FLOAT, 0::FLOAT, 0::FLOAT], alt[34:61]) END AS t FROM v_track) SELECT var_id, string_agg(CAST(CAST(floor(t[i]::DOUBLE * 1000) AS BIGINT) AS STRING), ',' ORDER BY i) AS track, count(*) AS n FROM r CROSS JOIN LATERAL (SELECT unnest(range(1, CAST(len(t) AS BIGINT) + 1)) AS i) x GROUP BY var_id""")
def indel_realignment(spark, sf):
    v = view(spark, sf, "v_track")
    m = F.col("var_id") % 3
    al = F.when(m == 0, 3).when(m == 1, 1).otherwise(1)
    rl = F.when(m == 2, 4).otherwise(1)
    t = K.realign_indel(F.col("alt"), rl, al)
    return v.select("var_id", F.array_join(F.transform(t, lambda x: F.floor(x.cast("double") * 1000)), ",").alias("track"), F.size(t).cast("long").alias("n"))


@query(cte("v_track") + "SELECT var_id, round(CASE WHEN class % 2 = 0 THEN ref[64] ELSE ref[1] END::DOUBLE, 6) AS first_value, round(1 / (1 + exp(-ref[1]::DOUBLE)), 6) AS prob FROM v_track")
def oriented_tracks(spark, sf):
    from splicelake.functions.scalar import sigmoid

    v = view(spark, sf, "v_track").withColumn("strand", F.when(F.col("class") % 2 == 0, "-").otherwise("+"))
    t = K.oriented_track(F.col("ref"), F.col("strand"))
    return v.select("var_id", F.round(F.get(t, F.lit(0)).cast("double"), 6).alias("first_value"), F.round(sigmoid(F.get("ref", F.lit(0)).cast("double")), 6).alias("prob"))


@query(cte("v_pred") + "SELECT region, pos, round(avg(head_a), 6) AS mean_a, round(avg(head_b), 6) AS mean_b, count(*) AS n_replicas FROM v_pred GROUP BY region, pos")
def ensemble_mean(spark, sf):
    v = view(spark, sf, "v_pred")
    return v.groupBy("region", "pos").agg(F.round(F.avg("head_a"), 6).alias("mean_a"), F.round(F.avg("head_b"), 6).alias("mean_b"), F.count("*").alias("n_replicas"))


AT = ", a AS (SELECT seq_id, class, attr, list_sum(list_transform(attr, lambda x: abs(x::DOUBLE))) AS s FROM v_attr)"


@query(cte("v_attr") + AT + """ SELECT seq_id, class, round(list_sum(list_transform(attr, lambda x: abs(x::DOUBLE) / s)), 6) AS norm_total, round(1 - list_sum(list_transform(attr[25:41], lambda x: abs(x::DOUBLE))) / s, 6) AS distal, round(-list_sum(list_transform(attr, lambda x: abs(x::DOUBLE) / s * log2(abs(x::DOUBLE) / s))), 6) AS entropy,
round(list_sum(list_transform(attr, lambda x: greatest(x::DOUBLE, 0))) / s, 6) AS positive_share, round(list_sum(list_transform(attr, lambda x: x::DOUBLE)), 6) AS signed_total FROM a""")
def attribution_spread(spark, sf):
    a = F.col("attr")
    d = view(spark, sf, "v_attr").select(
        "seq_id", "class", K.absolute_total(K.l1_normalised(a)).alias("norm_total"), K.distal_share(a, 8).alias("distal"), K.entropy_bits(a).alias("entropy"),
        K.positive_share(a).alias("positive_share"), K.total(a).alias("signed_total"),
    )
    return rounded(d, ["norm_total", "distal", "entropy", "positive_share", "signed_total"])


@query(cte("v_attr") + ", x AS (SELECT seq_id, unnest(list_sort(list_transform(attr, lambda x: abs(x::DOUBLE)), 'DESC')) AS v, unnest(range(1, 65)) AS i FROM v_attr), c AS (SELECT seq_id, i, sum(v) OVER (PARTITION BY seq_id ORDER BY i) AS cum, sum(v) OVER (PARTITION BY seq_id) AS s FROM x) SELECT seq_id, CAST(min(i) AS INT) AS width FROM c WHERE cum >= 0.9 * s GROUP BY seq_id")
def attribution_width(spark, sf):
    return view(spark, sf, "v_attr").select("seq_id", K.effective_width(F.col("attr")).alias("width"))


@query(cte("v_attr") + ", x AS (SELECT seq_id, class, unnest(attr) AS v, unnest(range(64)) AS i, CASE WHEN seq_id % 11 / 10 <= 0.1 THEN 'low' WHEN seq_id % 11 / 10 >= 0.9 THEN 'high' ELSE 'mid' END AS bin FROM v_attr) SELECT bin, class, CAST(i - 32 AS INT) AS pos, round(avg(v::DOUBLE), 6) AS mean, count(*) AS n FROM x WHERE i BETWEEN 16 AND 48 GROUP BY ALL")
def attribution_profile(spark, sf):
    v = view(spark, sf, "v_attr").withColumn("bin", K.usage_class(F.col("seq_id") % 11 / 10))
    x = v.select("bin", "class", F.posexplode(K.central(F.col("attr"), 16)).alias("i", "v"))
    return x.groupBy("bin", "class", (F.col("i") - 16).alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.count("*").alias("n"))


@query(cte("v_attr") + ", x AS (SELECT unnest(attr) AS v, unnest(range(64)) AS i, seq_id FROM v_attr), y AS (SELECT CAST(i AS INT) AS i, substring('ACGT', CAST((seq_id * 7 + i * 3) % 4 + 1 AS INT), 1) AS base, v::DOUBLE AS v FROM x) SELECT i AS pos, base, round(avg(v), 6) AS mean, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY i), 6) AS freq FROM y GROUP BY i, base")
def attribution_by_base(spark, sf):
    from splicelake.operators.ordered import lookup

    x = view(spark, sf, "v_attr").select("seq_id", F.posexplode("attr").alias("pos", "v"))
    x = x.withColumn("base", F.substring(F.lit("ACGT"), ((F.col("seq_id") * 7 + F.col("pos") * 3) % 4 + 1).cast("int"), F.lit(1)))
    g = x.groupBy("pos", "base").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.count("*").alias("n"))
    t = g.groupBy("pos").agg(F.sum("n").alias("t"))
    return lookup(g, t, ["pos"]).select("pos", "base", F.round("mean", 6).alias("mean"), "n", F.round(F.col("n") / F.col("t"), 6).alias("freq"))


@query(cte("v_attr") + ", o AS (SELECT seq_id, list_transform(range(1, 17), lambda i: attr[(i - 1) * 4 + 1 + CAST((seq_id + i - 1) % 4 AS BIGINT)]::DOUBLE) AS ob FROM v_attr) SELECT seq_id, round(list_sum(ob), 6) AS observed_total, round(list_sum(list_transform(ob, lambda x: abs(x))), 6) AS observed_abs FROM o")
def observed_attribution(spark, sf):
    v = view(spark, sf, "v_attr")
    four = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("attr", i * 4 + 1, 4))
    codes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((F.col("seq_id") + i) % 4 + 1).cast("tinyint"))
    ob = K.observed_attribution(four, codes)
    return v.select("seq_id", F.round(K.total(ob), 6).alias("observed_total"), F.round(K.absolute_total(ob), 6).alias("observed_abs"))


@query(cte("v_attr") + AT + ", t AS (SELECT class, seq_id % 37 / 37 AS pred, list_sum(list_transform(attr, lambda x: x::DOUBLE)) AS st, s, list_sum(list_transform(attr, lambda x: x::DOUBLE)) / s AS nt FROM a) SELECT class, round(corr(pred, st), 6) AS r_signed, round(corr(pred, s), 6) AS r_absolute, round(corr(pred, nt), 6) AS r_normalised, count(*) AS n FROM t GROUP BY class")
def attribution_completeness(spark, sf):
    v = view(spark, sf, "v_attr").select("class", (F.col("seq_id") % 37 / 37).alias("p"), K.total(F.col("attr")).alias("st"), K.absolute_total(F.col("attr")).alias("s"))
    c = v.groupBy("class").agg(correlation("p", "st").alias("r_signed"), correlation("p", "s").alias("r_absolute"), correlation("p", F.col("st") / F.col("s")).alias("r_normalised"), F.count("*").alias("n"))
    return rounded(c, ["r_signed", "r_absolute", "r_normalised"])


@query(cte("v_gene") + "SELECT paralog AS paralog_status, count(*) AS n, min(gene_id) AS first_gene FROM v_gene WHERE paralog = 0 GROUP BY paralog")
def nonparalog_rows(spark, sf):
    g = view(spark, sf, "v_gene").withColumn("paralog_status", F.col("paralog"))
    return W.paralog_subset(g, "0").groupBy("paralog_status").agg(F.count("*").alias("n"), F.min("gene_id").alias("first_gene"))
