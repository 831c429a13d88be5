"""Key joins with the null, duplicate and default rules of usage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators.ordered import lookup


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def allele_frequency(variants: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Look up (region, pos, ref, alt) in a table with alternate-allele and frequency arrays."""
    one = frequencies.select("region", "pos", "ref", F.inline(F.arrays_zip("alts", "afs"))).withColumnsRenamed({"alts": "alt", "afs": "af"})
    one = one.groupBy("region", "pos", "ref", "alt").agg(F.max("af").alias("af"))
    return lookup(variants, one, ["region", "pos", "ref", "alt"], "left")


def merge_labels(df: DataFrame, labels: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Left join on labels reduced to one row per key (the smallest value), so rows never multiply."""
    return lookup(df, labels.groupBy(*on).agg(F.min(value).alias(value)), list(on), "left")


def merge_check(merged: DataFrame, value: str) -> DataFrame:
    """One row with total and unmatched counts, for the caller's assertion."""
    return merged.agg(F.count("*").alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_missing"))


def with_stratum(df: DataFrame, strata: DataFrame, on: Sequence[str], label: str, default="-1") -> DataFrame:
    return lookup(df, strata.select(*on, label), list(on), "left").withColumn(label, F.coalesce(label, F.lit(default)))


def shared_sites(usage: DataFrame, site: Sequence[str], n_samples: int | None = None) -> DataFrame:
    """Sites with a value in every row (and in ``n_samples`` samples when given)."""
    g = usage.groupBy(*site).agg(F.count("*").alias("_n"), F.count("ssu").alias("_v"))
    g = g.filter("_n = _v")
    return (g if n_samples is None else g.filter(F.col("_v") == n_samples)).select(*site)


def with_membership(df: DataFrame, keys: DataFrame, on: Sequence[str], out: str) -> DataFrame:
    return lookup(df, keys.select(*on).distinct().withColumn(out, F.lit(True)), list(on), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def labelled_pairs(pairs: DataFrame, scores: DataFrame, extra: Sequence[str] = ("tissue",)) -> DataFrame:
    """Positive and negative score rows (label 1/0) per pair and head; a pair needs both scores."""
    s = scores.select("var_key", "head", "score")
    p = pairs.join(s.select(F.col("var_key").alias("pos_var_key"), "head", F.col("score").alias("pos_score")), "pos_var_key")
    p = p.join(s.select(F.col("var_key").alias("neg_var_key"), "head", F.col("score").alias("neg_score")), ["neg_var_key", "head"])
    p = p.filter("pos_score IS NOT NULL AND neg_score IS NOT NULL")
    rows = F.inline(F.array(
        F.struct(F.lit(1).alias("label"), F.col("pos_var_key").alias("var_key"), F.col("pos_score").alias("score")),
        F.struct(F.lit(0).alias("label"), F.col("neg_var_key").alias("var_key"), F.col("neg_score").alias("score")),
    ))
    rest = [c for c in p.columns if c not in ("pos_score", "neg_score")]
    return p.select(*rest, rows)


def across_tissues(stats: DataFrame, key: Sequence[str], tissues: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer merge of per-tissue statistics as one grouped pass (columns ``value_tissue``)."""
    aggs = [F.first(F.when(F.col("tissue") == t, F.col(v)), ignorenulls=True).alias(f"{v}_{t}") for t in tissues for v in values]
    return stats.groupBy(*key).agg(*aggs)


def pip_or_zero(df: DataFrame, fine_mapping: DataFrame, on: Sequence[str]) -> DataFrame:
    best = fine_mapping.groupBy(*on).agg(F.max("pip").alias("pip"))
    return lookup(df, best, list(on), "left").withColumn("pip", F.coalesce("pip", F.lit(0.0)))
