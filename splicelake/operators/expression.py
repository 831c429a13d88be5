"""Expression tables: counts, TPM, size factors and gene bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.functions.scalar import expression_bin, strip_version
from splicelake.operators.ordered import exact_percentiles, lookup


def complete_counts(counts: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Gene union across samples as one wide row per gene, missing = 0."""
    wide = counts.groupBy("gene_id").pivot("sample", list(samples)).agg(F.sum("n"))
    return wide.na.fill(0)


def tpm(counts: DataFrame) -> DataFrame:
    """Length-normalised counts scaled to a million per sample; 0 where undefined."""
    rpk = F.when(F.col("length") > 0, F.col("n") / (F.col("length") / 1000.0))
    d = counts.withColumn("_rpk", rpk)
    total = d.groupBy("sample").agg(F.sum("_rpk").alias("_t"))
    return lookup(d, total, ["sample"]).withColumn("tpm", F.coalesce(F.when(F.col("_t") > 0, F.col("_rpk") / (F.col("_t") / 1e6)), F.lit(0.0))).drop("_rpk", "_t")


def size_factors(counts: DataFrame, chunks: int | None = None) -> DataFrame:
    """Median over genes of count / geometric mean, where zeros are skipped per gene."""
    pos = counts.filter("n > 0")
    gm = pos.groupBy("gene_id").agg(F.exp(F.avg(F.log("n"))).alias("gm"))
    r = lookup(pos, gm, ["gene_id"]).withColumn("ratio", F.col("n") / F.col("gm"))
    return exact_percentiles(r, ["sample"], "ratio", {"size_factor": 0.5}, chunks)


def normalised_counts(counts: DataFrame, factors: DataFrame) -> DataFrame:
    j = lookup(counts, factors, ["sample"], "left")
    return j.withColumn("norm", F.coalesce(F.when(F.col("size_factor") > 0, F.col("n") / F.col("size_factor")), F.lit(0.0)))


def length_disagreements(lengths: DataFrame, reference_sample: str) -> DataFrame:
    """Genes per sample whose length differs from the reference sample's, nulls being equal."""
    ref = lengths.filter(F.col("sample") == reference_sample).select("gene_id", F.col("length").alias("_ref"))
    j = lookup(lengths.filter(F.col("sample") != reference_sample), ref, ["gene_id"])
    return j.groupBy("sample").agg(F.count_if(~F.col("length").eqNullSafe(F.col("_ref"))).alias("n_different"))


def mean_expression(wide: DataFrame, samples: Sequence[str], order: str) -> DataFrame:
    """Row mean per unversioned gene; the first row of a gene by ``order`` is kept."""
    m = sum(F.col(s) for s in samples) / len(samples)
    d = wide.select(strip_version(F.col("gene_id")).alias("gene_id"), order, m.alias("mean"))
    return d.groupBy("gene_id").agg(F.min_by("mean", F.struct(order, "mean")).alias("mean"))


def tissue_bins(medians: DataFrame, tissues: Sequence[str]) -> DataFrame:
    """(gene_id, tissue, bin) from a wide table of median expression per tissue."""
    long = medians.unpivot(["gene_id"], list(tissues), "tissue", "tpm")
    return long.select(strip_version(F.col("gene_id")).alias("gene_id"), "tissue", expression_bin(F.col("tpm")).alias("bin"))
