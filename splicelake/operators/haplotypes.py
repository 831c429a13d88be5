"""Genes, phased variants and sites brought together as one row per gene and allele."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators.intervals import points_in_intervals
from splicelake.operators.ordered import lookup

# Allele names of the two emitted rows, the text of an empty variant list, the id of filler rows.
PATERNAL, MATERNAL = "Paternal", "Maternal"
NO_VARIANTS = "None"
HOLDER_ID = "holder_holder_holder"


def variants_in_genes(variants: DataFrame, genes: DataFrame, bin_width: int = 16384) -> DataFrame:
    """(variant, gene) pairs with pos inside the closed gene interval, labelled kept or with the first drop reason.

    ``variants``: region, pos, ref, alts (array), gt (like ``1|0``); ``genes``: region, gstart, gend, gene_id.
    """
    j = points_in_intervals(variants, genes.select("region", "gstart", "gend", "gene_id"), "pos", "gstart", "gend", ["region"], bin_width)
    alt = F.get("alts", F.lit(0))
    reason = (
        F.when((F.length("ref") > F.length(alt)) & (F.col("pos") + F.length("ref") - 1 > F.col("gend")), "deletion_extends")
        .when(F.size("alts") > 1, "multiallelic")
        .when(F.regexp_replace("gt", "/", "|") == "0|0", "homref")
        .otherwise("kept")
    )
    return j.withColumns({"alt": alt, "reason": reason, "vtype": S.variant_type(F.col("ref"), alt)})


def variant_funnel(pairs: DataFrame) -> DataFrame:
    kept = F.when(F.col("reason") == "kept", F.col("vtype")).otherwise("-")
    return pairs.groupBy("reason", kept.alias("vtype")).agg(F.count("*").alias("n"))


def carried_alleles(gt: Column, require_phase: bool = False) -> Column:
    """Array of allele names that carry the alternate base."""
    a = F.regexp_replace(gt, "/", "|")
    phased = F.lit(True) if not require_phase else gt.contains("|")
    names = F.when(a == "1|0", F.array(F.lit(PATERNAL))).when(a == "0|1", F.array(F.lit(MATERNAL))).when(a == "1|1", F.array(F.lit(PATERNAL), F.lit(MATERNAL)))
    return F.when(phased, names)


def phased_haplotypes(pairs: DataFrame, genes: DataFrame, donor: Column) -> DataFrame:
    """Two rows per gene, each with its ordered distinct variant list (``None`` when empty)."""
    key = S.variant_key(F.col("region"), F.col("pos"), F.col("ref"), F.col("alt"))
    v = pairs.filter("reason = 'kept'").select("gene_id", F.explode(carried_alleles(F.col("gt"))).alias("allele"), "pos", key.alias("vkey")).distinct()
    lists = v.groupBy("gene_id", "allele").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vkey"))), lambda s: s["vkey"]).alias("variants"))
    rows = genes.withColumn("allele", F.explode(F.array(F.lit(PATERNAL), F.lit(MATERNAL))))
    j = lookup(rows, lists, ["gene_id", "allele"], "left")
    return j.select(
        *rows.columns, F.concat_ws("_", donor, "gene_id", "allele").alias("uid"),
        F.coalesce(F.array_join("variants", ","), F.lit(NO_VARIANTS)).alias("variant_list"), F.coalesce(F.size("variants"), F.lit(0)).alias("n_variants"),
    )


def attach_sites(rows: DataFrame, usage: DataFrame, bin_width: int = 16384) -> DataFrame:
    """Add ordered site and usage arrays (by type) of the row's own sample inside [gstart, gend].

    The range join is per sample and distinct gene, so sites of samples that a gene has no row of are never paired with it.
    """
    place = ["sample", "region", "strand"]
    genes = rows.select("gene_id", *place, "gstart", "gend").distinct()
    per = points_in_intervals(usage.select(*place, "site", "site_type", "ssu"), genes, "site", "gstart", "gend", place, bin_width, distinct=False)
    item = F.struct("site", F.coalesce("ssu", F.lit(S.SENTINEL)).alias("ssu"))
    side = lambda t: F.array_sort(F.collect_list(F.when(F.col("site_type") == t, item)))
    g = per.groupBy("gene_id", "sample").agg(side("exon_end").alias("_e"), side("exon_start").alias("_s"))
    j = lookup(rows, g, ["gene_id", "sample"], "left")
    cols = {}
    for name, src in (("exon_end", "_e"), ("exon_start", "_s")):
        arr = F.coalesce(F.col(src), F.array().cast("array<struct<site:int,ssu:double>>"))
        cols[f"{name}s"] = F.transform(arr, lambda x: x["site"])
        cols[f"{name}_ssus"] = F.transform(arr, lambda x: x["ssu"])
    return j.withColumns(cols).drop("_e", "_s")


def drop_unusable(rows: DataFrame) -> DataFrame:
    """Drop rows where either usage list is only the missing marker."""
    return rows.filter(~(S.all_sentinel(F.col("exon_end_ssus")) | S.all_sentinel(F.col("exon_start_ssus"))))


def drop_empty(rows: DataFrame) -> DataFrame:
    """Drop rows without any site of one of the two types (all-missing lists stay)."""
    return rows.filter(S.has_values(F.col("exon_ends")) & S.has_values(F.col("exon_starts")))


def fill_from_annotation(rows: DataFrame, annotation: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Add annotated sites missing from a row's lists (inside its interval) with the missing marker, sorted by position.

    ``annotation``: one row per gene with sorted arrays ``starts`` and ``ends`` (distinct coordinates of one gene).
    """
    j = lookup(rows, annotation.select(gene, "starts", "ends"), [gene], "left")
    for name, src in (("exon_start", "starts"), ("exon_end", "ends")):
        have, vals = F.col(f"{name}s"), F.col(f"{name}_ssus")
        known = F.coalesce(F.col(src), F.array().cast("array<int>"))
        inside = F.filter(known, lambda p: (p >= F.col("gstart")) & (p <= F.col("gend")))
        new = F.transform(F.array_except(inside, have), lambda p: F.struct(p.alias("p"), F.lit(S.SENTINEL).alias("v")))
        both = F.array_sort(F.concat(F.zip_with(have, vals, lambda p, v: F.struct(p.alias("p"), v.alias("v"))), new))
        j = j.withColumn("_all", both).withColumns({f"{name}s": F.transform("_all", lambda x: x["p"]), f"{name}_ssus": F.transform("_all", lambda x: x["v"])})
    return j.drop("_all", "starts", "ends")


def annotation_arrays(features: DataFrame, gene: str = "gene_id") -> DataFrame:
    return features.groupBy(gene).agg(F.array_sort(F.collect_set("gstart")).alias("starts"), F.array_sort(F.collect_set("gend")).alias("ends"))


def holder_rows(filled: DataFrame, annotation: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Genes that still have unused starts AND unused ends, with those positions and the filler id."""
    none = F.array().cast("array<int>")
    marked = lambda c, side: F.transform(F.coalesce(c, none), lambda p: F.struct(F.lit(side).alias("side"), p.alias("p")))
    both = lambda df, starts, ends: df.select(gene, F.inline(F.concat(marked(F.col(starts), "starts"), marked(F.col(ends), "ends"))))
    left = both(annotation.filter(F.col(gene).isNotNull()), "starts", "ends").join(both(filled, "exon_starts", "exon_ends").distinct(), [gene, "side", "p"], "left_anti")
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("p")))).alias(name)
    g = left.groupBy(gene).agg(side("starts"), side("ends"))
    return g.filter(S.has_values(F.col("starts")) & S.has_values(F.col("ends"))).withColumn("uid", F.lit(HOLDER_ID))


def paralog_flag(rows: DataFrame, paralogs: DataFrame, gene: str = "gene_id", require_partner: bool = True) -> DataFrame:
    """1 when the unversioned gene id is in the paralog table (with a partner id, unless told otherwise)."""
    p = paralogs.filter("partner IS NOT NULL AND partner <> ''") if require_partner else paralogs
    ids = p.select(S.strip_version(F.col("gene")).alias("_base")).distinct().withColumn("_hit", F.lit(1))
    j = lookup(rows.withColumn("_base", S.strip_version(F.col(gene))), ids, ["_base"], "left")
    return j.withColumn("paralog_status", F.coalesce("_hit", F.lit(0))).drop("_base", "_hit")


def frequent_variants(rows: DataFrame, min_count: int, uid: str = "uid") -> DataFrame:
    """Keep list members whose (variant, strand) occurs in at least ``min_count`` rows; order is kept."""
    x = rows.select(uid, "strand", F.posexplode(F.split("variant_list", ",")).alias("i", "vkey"))
    n = x.groupBy("vkey", "strand").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).drop("n")
    kept = x.join(n, ["vkey", "strand"], "left_semi").groupBy(uid).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "vkey"))), lambda s: s["vkey"]), ",").alias("_v"))
    return lookup(rows, kept, [uid], "left").withColumn("variant_list", F.coalesce("_v", F.lit(NO_VARIANTS))).drop("_v")
