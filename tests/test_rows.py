"""Small literal frames with results worked out by hand, and the edge rows of each rule."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.functions import sequence as Q
from splicelake.functions import tracks as K
from splicelake.operators import evidence as E
from splicelake.operators import haplotypes as H
from splicelake.operators import reporter as R
from splicelake.operators import sampling as P
from splicelake.operators import usage as U
from splicelake.operators import windows as W


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).collect()[0]


def test_scalars(spark):
    L = F.lit
    r = one(
        spark, bad=S.parse_fraction(L("x/3")), ok=S.parse_fraction(L("3/10")), mask=S.masked_usage(L(2), L(4)), use=S.masked_usage(L(3), L(6)), x=S.chromosome_number(L("chrX")), m=S.chromosome_number(L("chrM")),
        intron=S.parse_intron(L("1:10:20:clu_5_-")), broken=S.parse_intron(L("1:a:20")), key=S.parse_site_key(L("chr1_+_15_exon_end")), mnv=S.variant_type(L("AC"), L("GT")), b6=S.usage_bin(L(0.7)), b7=S.usage_bin(L(0.71)),
        empty=S.all_sentinel(F.array().cast("array<double>")), all7=S.all_sentinel(F.array(L(777.0))), top=S.strongest(F.array(L(0.2), L(-0.9), L(0.9))), donor=S.donor_id(L("HA-1-x"), "GTEX"),
    )
    assert not r.bad.ok and r.bad.den == 0 and (r.ok.num, r.ok.den) == (3, 10)
    assert r.mask is None and r.use == 0.5 and r.x == 23 and r.m is None
    assert (r.intron.chrom, r.intron.start, r.intron.strand) == ("chr1", 10, "-") and r.broken is None
    assert r.key.site_type == "exon_end" and r.mnv == "mnv" and (r.b6, r.b7) == (6, 7)
    assert r.empty is False and r.all7 is True and r.top == -0.9 and r.donor == "HA-1-x"


def test_sequence_codes(spark):
    r = one(spark, c=Q.base_codes(F.lit("acgtnMz"), het=True), rc=Q.reverse_complement_codes(Q.base_codes(F.lit("ACM"), het=True), het=True), hot=Q.one_hot(Q.base_codes(F.lit("CM"), het=True)), s=Q.reverse_complement(F.lit("AACGTN")))
    assert list(r.c) == [1, 2, 3, 4, 0, 5, 0] and list(r.rc) == [10, 3, 4] and r.s == "NACGTT"
    assert r.hot == [[0, 1, 0, 0], [0.5, 0.5, 0, 0]]


def test_track_functions(spark):
    t = F.array(*[F.lit(float(x)) for x in (0, 1, 2, 3, 4)])
    alt = F.array(*[F.lit(float(x)) for x in (0, 1, 5, 3, 1)])
    r = one(spark, d=K.delta_score(t, alt, 1), off=K.delta_offset(t, alt, 2), ins=K.realign_indel(t.cast("array<float>"), F.lit(1), F.lit(2)), dele=K.realign_indel(t.cast("array<float>"), F.lit(2), F.lit(1)), w=K.effective_width(t), zero=K.entropy_bits(F.array(F.lit(0.0))))
    assert (r.d, r.off) == (3.0, 0) and r.ins == [0, 1, 3, 4] and r.dele == [0, 1, 2, 0, 3] and r.w == 3 and r.zero is None


def test_evidence_classes(spark):
    # site 100 with partner 200; 300 competes for partner 200
    sites = spark.createDataFrame([("s", "c", "+", 100, [200], [50])], "sample string, region string, strand string, site int, partners array<int>, competitors array<int>")
    reads = [
        (80, "60M"),  # spans the site: beta1
        (90, "11M99N9M"),  # gap 100..200: uses the site
        (90, "5M300N9M"),  # gap over the site, no partner: mutually exclusive
        (40, "11M149N9M"),  # gap 50..199: end 199 is no partner, spans the site
        (40, "11M150N9M"),  # gap 50..200 joins a competitor and a partner over the site: flanking
        (98, "3M2I5M"),  # no single block holds both the site and the next base: no evidence
    ]
    d = spark.createDataFrame([("s", "c", p, 0, c) for p, c in reads], "sample string, region string, pos int, flag int, cigar string")
    got = {r.cls: r.n for r in E.classify(E.collapse_reads(d), sites, None, bin_width=32).groupBy("cls").agg(F.sum("n_reads").alias("n")).collect()}
    assert got == {"beta1": 1, "mutex": 2, "flank": 1}
    c = E.classify(E.collapse_reads(d), sites, None)
    j = E.evidence_counts(c, "junction").collect()[0]
    r = E.evidence_counts(c, "reads").collect()[0]
    assert (j.beta1, j.beta2, r.beta2) == (1, 2, 3)


def test_partner_evidence_by_hand(spark):
    j = spark.createDataFrame([("s", "c", "+", 10, 50, 4), ("s", "c", "+", 20, 50, 6), ("s", "c", "+", 10, 80, 1)], "sample string, region string, strand string, jleft int, jright int, n int")
    got = {r.site: r for r in U.partner_evidence(U.edges(j)).collect()}
    # 20 -> partner 50 also joins 10, which lies beyond 20: flanking 4, nothing is left as cryptic
    assert (got[20].alpha, got[20].beta2_flank, got[20].cryptic) == (6, 4, 0)
    # 10 -> partner 50 has 6 reads of 20, which is not beyond 10: cryptic 6, weighted 6·4/5
    assert (got[10].beta2_flank, got[10].cryptic, got[10].weighted) == (0, 6, pytest.approx(4.8))


def test_catalogue_and_duplicates(spark):
    e = spark.createDataFrame([("s", "c", "+", 10, 50, 1), ("s", "c", "+", 50, 10, 1), ("s", "c", "+", 50, 90, 1)], "sample string, region string, strand string, site int, partner int, n int")
    s = spark.createDataFrame([("s", "c", "+", x) for x in (10, 50, 70)], "sample string, region string, strand string, site int")
    cat = U.site_catalogue(s, e)
    assert {r.site: r.site_type for r in cat.collect()} == {10: "exon_end", 50: "both", 70: "unknown"}
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert [r.v for r in U.unique_sites(d, ["k"]).collect()] == ["c"]


def test_haplotypes(spark):
    genes = spark.createDataFrame([("c", "+", 100, 200, "g1"), ("c", "-", 300, 400, "g2")], "region string, strand string, gstart int, gend int, gene_id string")
    v = spark.createDataFrame(
        [("c", 100, "A", ["G"], "1|0"), ("c", 150, "A", ["G", "T"], "1|1"), ("c", 160, "A", ["C"], "0|0"), ("c", 199, "ACG", ["A"], "0|1"), ("c", 200, "T", ["C"], "1|1")],
        "region string, pos int, ref string, alts array<string>, gt string",
    )
    p = H.variants_in_genes(v, genes, 64)
    assert {r.pos: r.reason for r in p.collect()} == {100: "kept", 150: "multiallelic", 160: "homref", 199: "deletion_extends", 200: "kept"}
    h = {r.uid: r.variant_list for r in H.phased_haplotypes(p, genes, F.lit("D")).collect()}
    assert h["D_g1_Paternal"] == "c:100:A:G,c:200:T:C" and h["D_g1_Maternal"] == "c:200:T:C" and h["D_g2_Maternal"] == "None"


def _python_mutation(seq, start, variants):
    shift = 0
    for pos, ref, alt in sorted(variants):
        i = pos - start + shift
        seq = seq[: i + 1] + seq[i + len(ref):] if len(ref) > len(alt) else seq[:i] + alt + seq[i + len(ref):]
        shift += len(alt) - len(ref) if len(ref) <= len(alt) else 1 - len(ref)
    return seq


def test_indels_shift_sites_and_sequences(spark):
    seq = "ACGTACGTACGTACGTACGT"
    vs = [(103, "T", "TGG"), (106, "GTA", "G"), (112, "A", "C")]
    text = ",".join(f"c:{p}:{r}:{a}" for p, r, a in vs)
    d = spark.createDataFrame([("u", "+", 100, 119, text, [102, 105, 115], [103], [0.1, 777.0, 0.3], [0.4], seq)], "uid string, strand string, gstart int, gend int, variant_list string, exon_ends array<int>, exon_starts array<int>, exon_end_ssus array<double>, exon_start_ssus array<double>, seq string")
    a = W.adjust_rows(d)
    r = a.withColumn("mut", W.apply_variants(W.usable_variants(F.col("variants"), F.col("seq"), F.lit(100)), F.col("seq"), F.lit(100))).collect()[0]
    assert r.exon_ends == [102, 107, 115] and r.exon_starts == [105] and r.gend == 119 and r.n_dropped == 0
    assert r.mut == _python_mutation(seq, 100, vs) and len(r.mut) == 20
    # a variant that starts inside a kept deletion is dropped, a wrong reference is not applied
    b = d.withColumn("variant_list", F.lit("c:106:GTA:G,c:107:T:A,c:110:T:A"))
    x = W.adjust_rows(b).withColumn("ok", W.usable_variants(F.col("variants"), F.col("seq"), F.lit(100))).collect()[0]
    assert x.n_dropped == 1 and [v.pos for v in x.ok] == [106]


def test_labels_and_windows(spark):
    schema = "uid string, strand string, gstart int, gend int, exon_ends array<int>, exon_starts array<int>, exon_end_ssus array<double>, exon_start_ssus array<double>, seq string"
    d = spark.createDataFrame([("p", "+", 11, 22, [13, 15, 99], [15, 22], [0.5, 0.2, 0.1], [0.9, 777.0], "ACGTACGTACGT"), ("m", "-", 11, 22, [13], [20], [0.5], [0.7], "AACCGGTTACGT")], schema)
    lab = {(r.uid, r.off): (r.cls, r.ssu) for r in W.site_labels(d).collect()}
    assert lab == {("p", 2): (2, 0.5), ("p", 4): (1, 0.9), ("p", 11): (0, 777.0), ("m", 9): (1, 0.5), ("m", 2): (2, 0.7)}
    w = {(r.uid, r.window_idx): r for r in W.cut_windows(d, W.site_labels(d), "uid", 5, 4, True).collect()}
    assert len(w) == 6 and w[("p", 0)].x == "NNACGTACG" and w[("p", 2)].x == "ACGTNNNNN" and w[("m", 0)].x == "NNACGTAAC"
    assert [s.off for s in w[("m", 1)].sites] == [4] and w[("m", 2)].sites == []


def test_fetch_pads_and_joins_chunks(spark):
    g = spark.createDataFrame([("c", "ACGTACGTAA")], "chrom string, seq string")
    ch = W.genome_chunks(g, 4)
    r = spark.createDataFrame([(1, "c", 2, 7), (2, "c", -2, 3), (3, "c", 8, 13), (4, "d", 0, 2)], "k int, chrom string, lo int, hi int")
    got = {x.k: x.seq for x in W.fetch(r, ch, 4, ["k"]).collect()}
    assert got == {1: "GTACG", 2: "NNACG", 3: "AANNN", 4: None}


def test_splits_have_exact_sizes(spark):
    d = spark.range(1000).withColumns({"chrom": F.concat(F.lit("chr"), (F.col("id") % 7 + 1).cast("string")), "par": (F.col("id") % 5 == 0).cast("int")})
    s = P.replicate_splits(d, ["id"], 3, 0.15, 1, F.col("par") == 0, of_all=True)
    n = {r.replicate: (r.v, r.bad) for r in s.groupBy("replicate").agg(F.count_if(F.col("split") == "validation").alias("v"), F.count_if((F.col("split") == "validation") & (F.col("par") == 1)).alias("bad")).collect()}
    assert n == {1: (150, 0), 2: (150, 0), 3: (150, 0)}
    h = P.chromosome_holdout(d, ["id"], "chrom", "par", ["chr7"], 0.01, 3, True)
    c = {r.split: r.n for r in h.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert c["validation"] == 8 and sum(c.values()) == 1000
    assert h.filter("split = 'validation'").select("chrom").distinct().count() == 6
    with pytest.raises(PySparkException):
        P.stratified_pick(d, ["id"], "chrom", {"chr1": 10_000}).collect()
    with pytest.raises(PySparkException):
        P.pick_from_list(d, "id", 2000).collect()


def test_poisson_weights_and_tests(spark):
    w = spark.range(20000).select(R.poisson_weight(1, 2, F.col("id").cast("string")).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).collect()[0]
    assert w.m == pytest.approx(1, abs=0.03) and w.v == pytest.approx(1, abs=0.06)
    r = one(spark, e=R.erfc(F.lit(1.0)), c2=R.chi_square_tail(F.lit(3.0), 2), c3=R.chi_square_tail(F.lit(3.0), 3), c4=R.chi_square_tail(F.lit(3.0), 4))
    assert r.e == pytest.approx(0.157299, abs=1e-6) and r.c2 == pytest.approx(0.223130, abs=1e-6)
    assert r.c3 == pytest.approx(0.391625, abs=1e-5) and r.c4 == pytest.approx(0.557825, abs=1e-6)


def test_rank_test_by_hand(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 4.0)], "g string, v double")
    r = R.mann_whitney(d, "g", "v", "a", "b", chunks=2).collect()[0]
    assert r.u == 1.0
    # ranks 1, 3, 3 | 3, 5: H = 12/30 (49/3 + 64/2) - 18 = 4/3, divided by 1 - 24/120
    k = R.kruskal_wallis(d, "g", "v", 2).collect()[0]
    assert k.h == pytest.approx((4 / 3) / 0.8)


def test_files(spark, tmp_path):
    from splicelake.sources import fasta, files

    p = tmp_path / "g.fa"
    p.write_text(">c1 x\nACGTA\nCG\n>c2\nTTTTT\nGG\n")
    got = {(r.chrom, r.chunk_idx): r.seq for r in fasta.read_fasta(spark, str(p), 3).collect()}
    assert got == {("c1", 0): "ACG", ("c1", 1): "TAC", ("c1", 2): "G", ("c2", 0): "TTT", ("c2", 1): "TTG", ("c2", 2): "G"}
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "x.counts").write_text("# run\nGeneid\tChr\tStart\tEnd\tStrand\tLength\tx.bam\nG1\tc\t1\t2\t+\t50\t7\n")
    r = files.read_feature_counts(spark, str(tmp_path / "s1")).collect()
    assert [(x.sample, x.gene_id, x.length, x.n) for x in r] == [("s1", "G1", 50, 7)]
    (tmp_path / "t.gct").write_text("#1.2\n2\t2\nName\tDescription\tlung\ttestis\nG1.3\tA\t1.5\t0\n")
    g = files.read_gct(spark, str(tmp_path / "t.gct"), ["lung", "testis"]).collect()
    assert [(x.gene_id, x.lung, x.testis) for x in g] == [("G1.3", 1.5, 0.0)]
    (tmp_path / "sheet.tsv").write_text("sample_id\tdonor_id\tbam\tfastq_1\tfastq_2\tstrandness\tread_length\nA\tD\tx.bam\t\t\t\t\nB\tD\t\t1.fq\t\tfr\t100\n")
    s = files.read_sample_sheet(spark, str(tmp_path / "sheet.tsv")).collect()
    assert (s[0].strandness, s[0].read_length, s[0].problem) == ("rf", 76, None) and s[1].problem.startswith("bam or fastq")
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    files.write_table(t, str(tmp_path / "tab"), gzip=True)
    assert sorted(files.read_table(spark, str(tmp_path / "tab"), "k string, v int", ["v"]).collect()) == [(1,), (2,)]
    with pytest.raises(ValueError):
        files.require_columns(t, ["z"])


def test_reporter_table(spark):
    from splicelake.sources.files import reporter_table

    s = "chrom string, pos int"
    train = spark.createDataFrame([("c", 1, 0.1), ("c", 1, 0.1)], s + ", y double")
    test, truth = spark.createDataFrame([("c", 2)], s), spark.createDataFrame([("c", 2, 0.4), ("c", 2, 0.4)], s + ", y double")
    got = sorted(reporter_table(train, test, truth, ["chrom", "pos"], "y").collect())
    assert [tuple(r) for r in got] == [("c", 1, 0.1, "train"), ("c", 2, 0.4, "test")]


def test_each_variant_file_is_whole(spark, tmp_path):
    from splicelake.sources import files
    from splicelake.sources import lines as L

    rows = [(f"chr{i % 3}", 1000 - i, "A", "G", None if i % 4 else f"t{i}") for i in range(200)]
    v = spark.createDataFrame(rows, "region string, pos int, ref string, alt string, tissue string").repartition(4)
    for n, given in ((3, v), (1, v), (2, v.limit(0))):
        path = tmp_path / f"vcf{n}"
        files.write_vcf(given, str(path), {"TISSUE": "tissue"}, n)
        parts = [p.read_text().splitlines() for p in sorted(path.glob("part-*")) if p.stat().st_size]
        body = [r.split("\t") for p in parts for r in p[len(L.VCF_HEADER):]]
        assert 1 <= len(parts) <= n and all(p[: len(L.VCF_HEADER)] == L.VCF_HEADER for p in parts)
        want = sorted((c, x) for c, x, *_ in rows) if n != 2 else []
        assert [(r[0], int(r[1])) for r in body] == want and all(len(r) == 8 for r in body)
        assert files.read_vcf(spark, str(path)).count() == len(want)
