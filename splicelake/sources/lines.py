"""Parsers from text-line DataFrames (column ``value``) to typed tables.

They take any DataFrame of lines — ``spark.read.text`` of plain or gzip files, or a file stream — so readers stay one
line long and every format is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header lines and INFO descriptions of written variant files.
VCF_HEADER = [
    "##fileformat=VCFv4.2",
    '##INFO=<ID=MT,Number=1,Type=String,Description="Molecular trait id">',
    '##INFO=<ID=SD,Number=1,Type=Integer,Description="Splice distance">',
    '##INFO=<ID=PI,Number=1,Type=String,Description="Positive SNP id">',
    '##INFO=<ID=LABEL,Number=1,Type=Integer,Description="1=positive, 0=negative">',
    '##INFO=<ID=TISSUE,Number=1,Type=String,Description="Tissue name">',
    '##INFO=<ID=GENE,Number=1,Type=String,Description="Gene id">',
    '##INFO=<ID=PIP,Number=1,Type=Float,Description="PIP">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
]

# Sample sheet defaults.
DEFAULT_STRANDNESS, DEFAULT_READ_LENGTH = "rf", 76


def _fields(lines: DataFrame, comment: str | None = "#") -> DataFrame:
    d = lines if comment is None else lines.filter(~F.col("value").startswith(comment))
    return d.filter(F.col("value") != "").withColumn("_f", F.split("value", "\t"))


def _at(i: int) -> Column:
    return F.get("_f", F.lit(i))


def parse_bed12(lines: DataFrame) -> DataFrame:
    """Junctions from 12-column lines: left = start + first block, right = end − last block, n = score."""
    d = _fields(lines).filter(F.size("_f") == 12).withColumn("_b", F.split(_at(10), ","))
    block = lambda i: F.get("_b", F.lit(i)).cast("int")
    return d.select(
        _at(0).alias("region"), (_at(1).cast("int") + block(0)).alias("jleft"), (_at(2).cast("int") - block(1)).alias("jright"), _at(4).cast("int").alias("n"), _at(5).alias("strand"),
    )


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment columns with tags as a map (type letter dropped)."""
    # the twelfth field is the rest of the line; the generator keeps the test of the fields from being computed once more on the lines
    fields = F.filter(F.array(F.split("value", "\t", 12)), lambda f: (F.size(f) >= 11) & ~f[0].startswith("@"))
    d = lines.select(F.explode(fields).alias("_f"))
    rest = F.coalesce(F.split(_at(11), "\t"), F.array().cast("array<string>"))
    parts = F.filter(F.transform(rest, lambda t: F.split(t, ":", 3)), lambda p: F.size(p) == 3)
    tags = F.transform(parts, lambda p: F.struct(p[0], p[2]))
    return d.select(
        _at(0).alias("qname"), _at(1).cast("int").alias("flag"), _at(2).alias("region"), _at(3).cast("int").alias("pos"), _at(4).cast("int").alias("mapq"), _at(5).alias("cigar"), F.map_from_entries(tags).alias("tags"),
    )


def parse_vcf(lines: DataFrame, sample_index: int | None = None) -> DataFrame:
    """Variants with INFO as a map, all alternates as an array, and one donor's genotype when asked for."""
    info = F.when(_at(7) != ".", F.str_to_map(_at(7), F.lit(";"), F.lit("=")))
    cols = [
        _at(0).alias("region"), _at(1).cast("int").alias("pos"), _at(2).alias("var_id"), _at(3).alias("ref"), F.split(_at(4), ",").alias("alts"), info.alias("info"),
    ]
    if sample_index is not None:
        cols.append(F.get(F.split(_at(9 + sample_index), ":"), F.lit(0)).alias("gt"))
    return _fields(lines).select(*cols)


def parse_genotypes(lines: DataFrame, file: str | None = None) -> DataFrame:
    """A row per variant and donor: region, pos, var_id, ref, alts, donor and gt.

    Donors are named by the ``#CHROM`` line; with ``file`` (a column that tells files apart) every file has its own. The place of GT
    comes from each record's FORMAT; a record without it has null genotypes. Columns beyond the named donors are left out.
    """
    key = [file] if file else []
    cells = F.split("value", "\t")
    donors = lines.filter(F.col("value").startswith("#CHROM\t")).select(*key, F.slice(cells, 10, F.greatest(F.size(cells) - 9, F.lit(0))).alias("_donors"))
    d = _fields(lines)
    # one header a file; by a shuffle on the file, each file would be one task
    d = d.join(F.broadcast(donors), key) if key else d.withColumn("_donors", donors.scalar())
    gt = F.array_position(F.split(_at(8), ":"), "GT").cast("int")
    d = d.select(
        *key, _at(0).alias("region"), _at(1).cast("int").alias("pos"), _at(2).alias("var_id"), _at(3).alias("ref"), F.split(_at(4), ",").alias("alts"), gt.alias("_gt"), "_f", F.posexplode("_donors").alias("_i", "donor"),
    )
    cell = F.split(F.get("_f", F.col("_i") + 9), ":")
    return d.withColumn("gt", F.when(F.col("_gt") > 0, F.get(cell, F.col("_gt") - 1))).drop("_gt", "_f", "_i")


def format_vcf(variants: DataFrame, info_columns: dict[str, str]) -> DataFrame:
    """Record lines; INFO holds the non-null columns in the given order, ``.`` when none."""
    info = F.concat_ws(";", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}="), F.col(c).cast("string"))) for k, c in info_columns.items()])
    vid = F.coalesce(F.col("var_id"), F.concat_ws("_", "region", F.col("pos").cast("string"), "ref", "alt")) if "var_id" in variants.columns else F.concat_ws("_", "region", F.col("pos").cast("string"), "ref", "alt")
    dot = F.lit(".")
    return variants.select(F.concat_ws("\t", "region", F.col("pos").cast("string"), vid, "ref", "alt", dot, dot, F.when(info == "", dot).otherwise(info)).alias("value"))


def attribute(name: str, source: str = "attribute") -> Column:
    """Quoted (or bare) attribute value; null when absent."""
    v = F.regexp_extract(source, rf'(?:^|;\s*){name} "?([^";]+)"?', 1)
    return F.when(v != "", v)


def parse_gtf(lines: DataFrame, feature: str | None = None) -> DataFrame:
    d = _fields(lines).filter(F.size("_f") == 9)
    if feature is not None:
        d = d.filter(_at(2) == feature)
    d = d.select(
        _at(0).alias("region"), _at(2).alias("feature"), _at(3).cast("int").alias("gstart"), _at(4).cast("int").alias("gend"), _at(6).alias("strand"), _at(8).alias("attribute"),
    )
    return d.select(
        "region", "feature", "gstart", "gend", "strand", attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("transcript_id"), attribute("gene_type").alias("gene_type"),
        attribute("transcript_type").alias("transcript_type"), attribute("transcript_support_level").alias("tsl"), F.col("attribute").contains("MANE_Select").alias("mane"),
    )


def annotation_filter(gtf: DataFrame, protein_coding: bool = False, best_support: bool = False, mane_only: bool = False) -> DataFrame:
    d = gtf
    if protein_coding:
        d = d.filter((F.col("gene_type") == "protein_coding") & (F.coalesce("transcript_type", F.lit("protein_coding")) == "protein_coding"))
    if best_support:
        d = d.filter(F.col("tsl") == "1")
    return d.filter("mane") if mane_only else d


def parse_ids(lines: DataFrame, drop: str | None = None) -> DataFrame:
    """One id per line; blanks and an optional filler id are dropped."""
    d = lines.select(F.trim("value").alias("id")).filter("id <> ''")
    return d if drop is None else d.filter(F.col("id") != drop)


def parse_sample_sheet(rows: DataFrame) -> DataFrame:
    """Typed sample sheet with defaults and a ``problem`` column (null when the row is valid)."""
    has = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    bam, fastq = has("bam"), has("fastq_1") & has("fastq_2")
    problem = F.when(~has("sample_id"), "sample_id missing").when(~has("donor_id"), "donor_id missing").when(~(bam | fastq), "bam or fastq_1/fastq_2 missing")
    return rows.select(
        "sample_id", "donor_id", F.when(bam, "bam").when(fastq, "fastq").alias("input_type"), "bam", "fastq_1", "fastq_2",
        F.when(has("strandness"), F.col("strandness")).otherwise(DEFAULT_STRANDNESS).alias("strandness"), F.coalesce(F.col("read_length").try_cast("int"), F.lit(DEFAULT_READ_LENGTH)).alias("read_length"), problem.alias("problem"),
    )


def parse_splice_table(lines: DataFrame, tissue: int | None = None) -> DataFrame:
    """Sites of ``gene, paralog, chrom, strand, start, end, pos:v,v;pos:v`` lines with one tissue's value or the mean of
    the valid ones; 777 when there is none."""
    d = _fields(lines, None).filter(F.size("_f") >= 7)
    entry = F.explode(F.filter(F.transform(F.split(_at(6), ";"), lambda e: F.trim(e)), lambda e: e != ""))
    d = d.select(_at(0).alias("gene_id"), F.when(_at(2).startswith("chr"), _at(2)).otherwise(F.concat(F.lit("chr"), _at(2))).alias("region"), _at(3).alias("strand"), _at(4).cast("int").alias("gstart"), _at(5).cast("int").alias("gend"), entry.alias("_e"))
    p = F.split("_e", ":")
    vals = F.transform(F.split(F.get(p, F.lit(1)), ","), lambda v: F.when(v == "", -1.0).otherwise(v.try_cast("double")))
    ok = F.filter(vals, lambda v: v >= 0)
    one = F.when(F.get(vals, F.lit(tissue)) >= 0, F.get(vals, F.lit(tissue))) if tissue is not None else F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda a, v: a + v) / F.size(ok))
    return d.select("gene_id", "region", "strand", "gstart", "gend", F.get(p, F.lit(0)).cast("int").alias("site"), F.coalesce(one, F.lit(777.0)).alias("ssu"))


def haplotype_rows_from_sites(sites: DataFrame, donor: str) -> DataFrame:
    """One packed row per gene; both site columns hold all sites."""
    text = F.when(F.col("ssu") == 777.0, "777.0").otherwise(F.format_string("%.6f", "ssu"))
    g = sites.groupBy("gene_id", "region", "strand", "gstart", "gend").agg(F.array_sort(F.collect_list(F.struct("site", text.alias("t")))).alias("_s"))
    pos = F.array_join(F.transform("_s", lambda s: s["site"].cast("string")), ",")
    val = F.array_join(F.transform("_s", lambda s: s["t"]), ",")
    return g.select(
        F.concat_ws("_", F.lit(donor), "gene_id", "region").alias("uid"), "gene_id", "region", "strand", "gstart", "gend",
        pos.alias("exon_ends"), pos.alias("exon_starts"), val.alias("exon_end_ssus"), val.alias("exon_start_ssus"), F.lit("").alias("variant_list"), F.lit(0).alias("paralog_status"),
    )


def parse_canonical(lines: DataFrame, donor: str) -> DataFrame:
    """Haplotype rows of canonical transcripts: listed positions, all values missing."""
    strip = lambda i: F.rtrim(_at(i), F.lit(","))
    count = lambda t: F.size(F.filter(F.split(t, ","), lambda x: x != ""))
    miss = lambda t: F.array_join(F.array_repeat(F.lit("777.0"), count(t)), ",")
    return _fields(lines, None).filter(F.size("_f") == 8).select(
        F.concat_ws("_", F.lit(donor), _at(0), _at(2)).alias("uid"), _at(0).alias("gene_id"), _at(2).alias("region"), _at(3).alias("strand"), _at(4).cast("int").alias("gstart"), _at(5).cast("int").alias("gend"),
        strip(6).alias("exon_ends"), strip(7).alias("exon_starts"), miss(strip(6)).alias("exon_end_ssus"), miss(strip(7)).alias("exon_start_ssus"), F.lit("").alias("variant_list"), _at(1).cast("int").alias("paralog_status"),
    )


def metrics_document(metrics: DataFrame, levels: list[str], values: list[str]) -> DataFrame:
    """One JSON line: nested objects level by level (a metric table is small: subsets × targets × heads)."""
    leaf = F.map_filter(F.create_map(*[x for v in values for x in (F.lit(v), F.col(v).cast("double"))]), lambda k, v: v.isNotNull())
    d = metrics.select(*levels, leaf.alias("_m"))
    for i in range(len(levels) - 1, -1, -1):
        entry = F.struct(F.col(levels[i]).cast("string").alias("k"), F.col("_m").alias("v"))
        d = d.groupBy(*levels[:i]).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    return d.select(F.to_json("_m").alias("value"))


def parse_metrics(documents: DataFrame, levels: list[str], skip_missing: str | None = None) -> DataFrame:
    """Flatten nested metric documents to (levels…, metric, value); rows without the ``skip_missing`` metric are left out."""
    t = "map<string,double>"
    for _ in levels:
        t = f"map<string,{t}>"
    d = documents.select(F.from_json("value", t).alias("_m"))
    done: list[str] = []
    for level in levels:
        d = d.select(*done, F.explode("_m").alias(level, "_m"))
        done.append(level)
    if skip_missing:
        v = F.element_at("_m", F.lit(skip_missing))
        d = d.filter(F.coalesce(~F.isnan(v), F.lit(False)))
    return d.select(*done, F.explode("_m").alias("metric", "metric_value"))
