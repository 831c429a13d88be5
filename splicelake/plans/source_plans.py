"""Queries that pass the tables through each text format and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicelake.operators import curves as C
from splicelake.operators import windows as W
from splicelake.plans.metric_plans import REG_COLS, rounded, sql_reg
from splicelake.plans.registry import query
from splicelake.plans.sequence_plans import LAB, ROWS, SQ, WIN, _seq, _windows
from splicelake.plans.usage_plans import EDGES, FRAC, _usage
from splicelake.plans.views import cte, table, view
from splicelake.functions import scalar as S
from splicelake.session import scratch_dir
from splicelake.sources import fasta, files
from splicelake.sources import lines as L
from splicelake.streaming import arrivals


def _line(*cols):
    return F.concat_ws("\t", *[c if not isinstance(c, str) else F.lit(c) for c in cols]).alias("value")


def _s(c):
    return F.col(c).cast("string")


def _bed(spark, sf):
    v = view(spark, sf, "v_junction")
    a, b = (F.col("jleft") - 5).cast("string"), (F.col("jright") + 8).cast("string")
    return v.select("sample", _line(F.col("region"), a, b, "JUNC", _s("n"), F.col("strand"), a, b, "255,0,0", "2", "5,8", "0,9"))


@query(cte("v_junction") + "SELECT region, jleft, jright, n, strand, count(*) AS c FROM v_junction GROUP BY ALL")
def junction_scan(spark, sf):
    return L.parse_bed12(_bed(spark, sf)).groupBy("region", "jleft", "jright", "n", "strand").agg(F.count("*").alias("c"))


@query(cte("v_read") + "SELECT qname, flag, region, pos, mapq, cigar, vw, '1' AS nh FROM v_read")
def alignment_scan(spark, sf):
    v = view(spark, sf, "v_read")
    base = _line(_s("qname"), _s("flag"), F.col("region"), _s("pos"), _s("mapq"), F.col("cigar"), "*", "0", "0", "*", "*", "NH:i:1")
    lines = v.select(F.when(F.col("vw").isNull(), base).otherwise(F.concat(base, F.lit("\tvW:i:"), "vw")).alias("value"))
    t = L.parse_sam(lines)
    return t.select("qname", "flag", "region", "pos", "mapq", "cigar", F.col("tags")["vW"].alias("vw"), F.col("tags")["NH"].alias("nh"))


def _info(spark, sf):
    return view(spark, sf, "v_variant").selectExpr("var_key AS var_id", "region", "pos", "ref", "alt", "CASE WHEN orderkey % 3 = 0 THEN tissue END AS ti", "CASE WHEN orderkey % 3 = 0 THEN orderkey % 5000 END AS sd", "CASE WHEN orderkey % 2 = 0 THEN gene_id END AS gene")


VCFQ = "SELECT var_key AS var_id, region, pos, ref, alt, CASE WHEN orderkey % 3 = 0 THEN tissue END AS tissue, CASE WHEN orderkey % 3 = 0 THEN CAST(orderkey % 5000 AS STRING) END AS sd, CASE WHEN orderkey % 2 = 0 THEN gene_id END AS gene FROM v_variant"
INFO = {"TISSUE": "ti", "SD": "sd", "GENE": "gene"}


def _parsed_vcf(t):
    i = F.col("info")
    return t.select("var_id", "region", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), i["TISSUE"].alias("tissue"), i["SD"].alias("sd"), i["GENE"].alias("gene"))


@query(cte("v_variant") + VCFQ)
def variant_scan(spark, sf):
    return _parsed_vcf(L.parse_vcf(L.format_vcf(_info(spark, sf), INFO)))


@query(cte("v_variant") + VCFQ)
def variant_file_round_trip(spark, sf):
    path = scratch_dir(spark, "variants")
    files.write_vcf(_info(spark, sf), path, INFO)
    return _parsed_vcf(files.read_vcf(spark, path))


@query(cte("v_gene") + "SELECT region, gene_id, strand, gstart, gend, CASE WHEN paralog = 1 THEN 'protein_coding' ELSE 'lncRNA' END AS gene_type, CASE WHEN gstart % 3 = 0 THEN '1' ELSE '5' END AS tsl, gstart % 4 = 0 AS mane FROM v_gene WHERE paralog = 1 AND gstart % 3 = 0")
def annotation_scan(spark, sf):
    g = view(spark, sf, "v_gene")
    att = F.concat(
        F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "T1"; gene_type "'), F.when(F.col("paralog") == 1, "protein_coding").otherwise("lncRNA"), F.lit('"; transcript_support_level "'),
        F.when(F.col("gstart") % 3 == 0, "1").otherwise("5"), F.lit('";'), F.when(F.col("gstart") % 4 == 0, ' tag "MANE_Select";').otherwise(""),
    )
    t = L.parse_gtf(g.select(_line(F.col("region"), "SRC", "exon", _s("gstart"), _s("gend"), ".", F.col("strand"), ".", att)), "exon")
    return L.annotation_filter(t, protein_coding=True, best_support=True).select("region", "gene_id", "strand", "gstart", "gend", "gene_type", "tsl", "mane")


@query("SELECT concat('S', CAST(c_custkey AS STRING)) AS sample_id, CASE WHEN c_nationkey % 3 = 0 THEN 'bam' WHEN c_nationkey % 3 = 1 THEN 'fastq' END AS input_type, CASE WHEN c_nationkey % 4 = 0 THEN 'fr' ELSE 'rf' END AS strandness, CASE WHEN c_nationkey % 5 = 0 THEN 100 ELSE 76 END AS read_length, CASE WHEN c_custkey % 17 = 0 THEN 'donor_id missing' WHEN c_nationkey % 3 = 2 THEN 'bam or fastq_1/fastq_2 missing' END AS problem FROM customer")
def sample_sheet_scan(spark, sf):
    c = table(spark, sf, "customer")
    n = F.col("c_nationkey")
    sheet = c.select(
        F.concat(F.lit("S"), _s("c_custkey")).alias("sample_id"), F.when(F.col("c_custkey") % 17 != 0, "D").alias("donor_id"), F.when(n % 3 == 0, "x.bam").alias("bam"), F.when(n % 3 != 0, "1.fq").alias("fastq_1"),
        F.when(n % 3 == 1, "2.fq").otherwise(" ").alias("fastq_2"), F.when(n % 4 == 0, "fr").alias("strandness"), F.when(n % 5 == 0, "100").otherwise("").alias("read_length"),
    )
    return L.parse_sample_sheet(sheet).select("sample_id", "input_type", "strandness", "read_length", "problem")


@query("SELECT s_name AS id FROM supplier WHERE s_suppkey % 6 <> 0 AND s_suppkey % 11 <> 0")
def id_list_scan(spark, sf):
    s = table(spark, sf, "supplier")
    v = F.when(F.col("s_suppkey") % 6 == 0, "   ").when(F.col("s_suppkey") % 11 == 0, "holder").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" ")))
    return L.parse_ids(s.select(v.alias("value")), "holder")


ST = "WITH e AS (SELECT concat('G', CAST(p_partkey AS STRING)) AS gene_id, concat('chr', CAST(p_partkey % 5 + 1 AS STRING)) AS region, CAST(p_partkey * 10 + i AS INT) AS site, p_size, i FROM part CROSS JOIN (SELECT unnest([1, 4, 7]) AS i) x), v AS (SELECT *, CASE i WHEN 1 THEN (p_size / 100 + 0.25) / 2 WHEN 4 THEN 777.0 ELSE 0.5 END AS ssu FROM e)"


def _splice_lines(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    e = F.concat(
        (k * 10 + 1).cast("string"), F.lit(":"), (F.col("p_size") / 100).cast("string"), F.lit(",0.25,-1;"), (k * 10 + 4).cast("string"), F.lit(":,-1.0,;"), (k * 10 + 7).cast("string"), F.lit(":0.5,,;"),
    )
    return p.select(_line(F.concat(F.lit("G"), k.cast("string")), "0", (k % 5 + 1).cast("string"), "+", (k * 10).cast("string"), (k * 10 + 9).cast("string"), e))


@query(ST + " SELECT gene_id, region, site, round(ssu, 6) AS ssu FROM v")
def splice_table_scan(spark, sf):
    return L.parse_splice_table(_splice_lines(spark, sf)).select("gene_id", "region", "site", F.round("ssu", 6).alias("ssu"))


@query(ST + " SELECT concat('D_', gene_id, '_', region) AS uid, string_agg(CAST(site AS STRING), ',' ORDER BY site) AS exon_ends, string_agg(CAST(site AS STRING), ',' ORDER BY site) AS exon_starts, max(CASE WHEN i = 1 THEN printf('%.6f', ssu) END) || ',777.0,0.500000' AS exon_end_ssus FROM v GROUP BY gene_id, region")
def splice_table_rows(spark, sf):
    r = L.haplotype_rows_from_sites(L.parse_splice_table(_splice_lines(spark, sf)), "D")
    return r.select("uid", "exon_ends", "exon_starts", "exon_end_ssus")


@query("SELECT concat('REF_G', CAST(p_partkey AS STRING), '_chr1') AS uid, CAST(p_partkey AS INT) AS gstart, concat(CAST(p_partkey + 1 AS STRING), ',', CAST(p_partkey + 5 AS STRING)) AS exon_ends, CAST(p_partkey + 3 AS STRING) AS exon_starts, '777.0,777.0' AS exon_end_ssus, '777.0' AS exon_start_ssus FROM part")
def canonical_scan(spark, sf):
    k = F.col("p_partkey")
    t = lambda x: x.cast("string")
    lines = table(spark, sf, "part").select(_line(F.concat(F.lit("G"), t(k)), "0", "chr1", "+", t(k), t(k + 9), F.concat(t(k + 1), F.lit(","), t(k + 5), F.lit(",")), F.concat(t(k + 3), F.lit(","))))
    return L.parse_canonical(lines, "REF").select("uid", "gstart", "exon_ends", "exon_starts", "exon_end_ssus", "exon_start_ssus")


@query(cte("v_pred") + f", m AS (SELECT sample, region, {sql_reg('y_ssu', 'head_b')} FROM v_pred WHERE y_ssu <> 777 GROUP BY sample, region) SELECT sample, region, metric, metric_value FROM m UNPIVOT (metric_value FOR metric IN (pearson, r2, mse, mae))")
def metrics_document_round_trip(spark, sf):
    v = view(spark, sf, "v_pred").withColumn("ssu", S.from_sentinel(F.col("y_ssu")))
    m = rounded(C.regression_metrics(v, ["sample", "region"], "ssu", "head_b"), REG_COLS)
    return L.parse_metrics(L.metrics_document(m, ["sample", "region"], REG_COLS), ["sample", "region"], "pearson")


@query(cte("v_seq") + SQ + " SELECT CAST(doc_id AS STRING) AS chrom, CAST(i AS INT) AS chunk_idx, substring(seq, CAST(i * 256 + 1 AS INT), 256) AS seq FROM sq CROSS JOIN LATERAL (SELECT unnest(range(CAST(ceil(length(seq) / 256) AS BIGINT))) AS i) r WHERE length(seq) > 0")
def fasta_round_trip(spark, sf):
    s = _seq(spark, sf)
    n = F.greatest(F.ceil(F.length("seq") / 60).cast("int"), F.lit(1))
    body = s.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("seq", i * 60 + 1, F.lit(60)))).alias("i", "value"))
    head = s.select("doc_id", F.lit(-1).alias("i"), F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" text")).alias("value"))
    path = scratch_dir(spark, "fasta")
    head.unionByName(body).repartition("doc_id").sortWithinPartitions("doc_id", "i").select("value").write.text(path)
    return fasta.read_fasta(spark, path, 256)


@query(cte("v_usage") + FRAC + " SELECT sample, count(*) AS n, round(sum(ssu), 6) AS total FROM us WHERE sample IN ('S1', 'S4') GROUP BY sample")
def partitioned_round_trip(spark, sf):
    path = scratch_dir(spark, "usage")
    files.write_partitioned(_usage(spark, sf), path, ["sample"], 2)
    return spark.read.parquet(path).filter("sample IN ('S1', 'S4')").groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("ssu"), 6).alias("total"))


@query(cte("v_usage") + FRAC + " SELECT sample, count(*) AS n, CAST(sum(num) AS BIGINT) AS alpha FROM us GROUP BY sample")
def many_file_scan(spark, sf):
    """One folder per sample, read back as one table with the sample taken from the path."""
    path = scratch_dir(spark, "counts")
    u = _usage(spark, sf).select("sample", "site", "num", "den")
    u.repartition("sample").write.option("sep", "\t").option("header", "true").partitionBy("sample").csv(path)
    r = files.read_many(spark, path, "site INT, num BIGINT, den BIGINT", "sample", r"sample=([^/]+)/[^/]+$")
    return r.groupBy("sample").agg(F.count("*").alias("n"), F.sum("num").alias("alpha"))


@query(cte("v_seq") + ROWS + LAB + WIN + " SELECT strand, count(*) AS n_windows, CAST(sum(n_sites) AS BIGINT) AS n_sites FROM wn JOIN ws USING (uid, window_idx) GROUP BY strand")
def window_dataset_round_trip(spark, sf):
    path = scratch_dir(spark, "windows")
    W.write_windows(_windows(spark, sf).select("uid", "window_idx", "x", "sites", F.col("strand")), path, ["strand"])
    return spark.read.parquet(path).groupBy("strand").agg(F.count("*").alias("n_windows"), F.sum(F.size("sites")).alias("n_sites"))


@query(cte("v_junction") + EDGES + " SELECT region, strand, site, CAST(sum(n) AS BIGINT) AS alpha FROM ed GROUP BY region, strand, site")
def arriving_junctions(spark, sf):
    """Site counts folded over a stream of per-sample junction files."""
    path = scratch_dir(spark, "junctions")
    _bed(spark, sf).repartition("sample").write.partitionBy("sample").text(path)
    q, updates = arrivals.keep_counts(arrivals.site_counts(arrivals.junction_stream(spark, path)), "arrivals")
    q.awaitTermination()
    return arrivals.latest_counts(spark, updates)


@query(cte("v_gene") + "SELECT region, count(*) AS n, CAST(sum(gstart) AS BIGINT) AS starts FROM v_gene GROUP BY region")
def table_round_trip(spark, sf):
    """Delimited text, compressed, read back with two of its four columns."""
    path = scratch_dir(spark, "table")
    files.write_table(view(spark, sf, "v_gene").select("gene_id", "region", "gstart", "gend"), path, gzip=True)
    r = files.read_table(spark, path, "gene_id STRING, region STRING, gstart INT, gend INT", ["region", "gstart"])
    return r.groupBy("region").agg(F.count("*").alias("n"), F.sum("gstart").alias("starts"))


@query(cte("v_usage") + "SELECT concat('sample=', sample) AS sample, concat('G', CAST(site AS STRING)) AS gene_id, CAST(100 + site % 900 AS INT) AS length, CAST(sum(alpha) AS BIGINT) AS n FROM v_usage GROUP BY sample, site")
def count_file_scan(spark, sf):
    """Count files of one folder per sample, with their comment and column lines."""
    path = scratch_dir(spark, "featurecounts")
    g = view(spark, sf, "v_usage").groupBy("sample", "site").agg(F.sum("alpha").alias("n"))
    row = F.concat_ws("\t", F.concat(F.lit("G"), F.col("site")), F.lit("chr1"), F.col("site"), F.col("site") + 99, F.lit("+"), 100 + F.col("site") % 900, F.col("n"))
    top = g.select("sample").distinct().select("sample", F.explode(F.array(F.lit("# Program:counts"), F.lit("Geneid\tChr\tStart\tEnd\tStrand\tLength\ts.bam"))).alias("value"))
    g.select("sample", row.alias("value")).unionByName(top).write.partitionBy("sample").text(path)
    return files.read_feature_counts(spark, path)


@query(cte("v_gene") + "SELECT gene_id, CAST(tpm AS DOUBLE) AS lung, CAST(gstart AS DOUBLE) AS testis FROM v_gene")
def expression_file_scan(spark, sf):
    """A median expression table with its three leading lines."""
    path = scratch_dir(spark, "gct")
    row = F.concat_ws("\t", "gene_id", F.lit("name"), F.col("tpm").cast("double"), F.col("gstart"))
    top = spark.range(1).select(F.explode(F.array(F.lit("#1.2"), F.lit("9\t2"), F.lit("Name\tDescription\tlung\ttestis"))).alias("value"))
    view(spark, sf, "v_gene").select(row.alias("value")).unionByName(top).write.text(path)
    return files.read_gct(spark, path, ["lung", "testis"])


GTS = ["0|1", "1|1", "./."]


@query(cte("v_variant") + """, d AS (SELECT unnest([0, 1, 2]) AS i) SELECT var_key AS var_id, region, pos, ref, concat('D', CAST(orderkey % 2 * 10 + i AS STRING)) AS donor, CASE WHEN orderkey % 7 <> 0 THEN ['0|1', '1|1', './.'][CAST((orderkey + i) % 3 + 1 AS INT)] END AS gt FROM v_variant CROSS JOIN d""")
def donor_genotypes(spark, sf):
    """Two files with donors of their own; GT stands first or second in FORMAT, or is missing."""
    path = scratch_dir(spark, "genotypes")
    k = F.col("orderkey")
    gt = lambda i: F.get(F.array(*[F.lit(g) for g in GTS]), ((k + i) % 3).cast("int"))
    cell = lambda i: F.when(k % 7 == 0, "9").when(k % 5 == 0, F.concat(F.lit("9:"), gt(i))).otherwise(F.concat(gt(i), F.lit(":9")))
    layout = F.when(k % 7 == 0, "DP").when(k % 5 == 0, "DP:GT").otherwise("GT:DP")
    for odd in (0, 1):
        v = view(spark, sf, "v_variant").filter(k % 2 == odd)
        names = [f"D{odd * 10 + i}" for i in range(3)]
        head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names]),)], "value string")
        rows = v.select(_line(F.col("region"), _s("pos"), F.col("var_key"), F.col("ref"), F.col("alt"), ".", ".", ".", layout, *[cell(i) for i in range(3)]))
        head.unionByName(rows).coalesce(1).write.text(f"{path}/{odd}")
    return files.read_genotypes(spark, path).select("var_id", "region", "pos", "ref", "donor", "gt")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, lang, i AS row_index, CAST(least(i // (n // 7), 6) AS INT) AS part FROM r")
def split_and_combine(spark, sf):
    path = scratch_dir(spark, "parts")
    W.write_parts(W.even_parts(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 7), path)
    return W.combine_parts(spark, path).select("doc_id", "lang", "row_index", "part")


@query("SELECT c_custkey AS k, c_nationkey AS site, c_acctbal AS value, CASE WHEN c_custkey % 3 = 0 THEN 'train' ELSE 'test' END AS split FROM customer WHERE c_custkey % 3 <> 1")
def reporter_tables(spark, sf):
    """Train rows as they are, test rows with their values from a table of their own; doubled rows count once."""
    c = table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_nationkey AS site", "c_acctbal AS value")
    train, test = c.filter("k % 3 = 0"), c.filter("k % 3 = 2")
    return files.reporter_table(train.unionByName(train), test.drop("value"), test.select("k", "value"), ["k"], "value").select("k", "site", "value", "split")
