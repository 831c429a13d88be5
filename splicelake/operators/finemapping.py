"""Credible sets, variant keys by posterior probability, and counts over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators.ordered import lookup

# Positives and negatives by posterior probability, and the rules of ambiguous sets.
POSITIVE_PIP = 0.9
NEGATIVE_PIP = 0.01
AMBIGUOUS_SIZE = (2, 10)
AMBIGUOUS_REACH = 5000


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]], tie: str) -> DataFrame:
    """First row per key under (column, ascending) orders with a unique tie column; an aggregate, so no group is sorted."""
    rest = [c for c in df.columns if c not in by]
    parts = [F.col(c) if up else -F.col(c) for c, up in order]
    key = F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)], F.col(tie).alias("t"))
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_r")).select(*by, "_r.*")


def pip_classes(df: DataFrame, by: Sequence[str] = ("var_key",), high: float = POSITIVE_PIP, low: float = NEGATIVE_PIP) -> DataFrame:
    """Largest pip per key and whether it makes the key positive, negative or neither."""
    g = df.groupBy(*by).agg(F.max("pip").alias("max_pip"))
    return g.withColumn("cls", F.when(F.col("max_pip") >= high, "positive").when(F.col("max_pip") < low, "negative").otherwise("between"))


def set_summary(df: DataFrame, by: Sequence[str] = ("tissue", "cs_id")) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct("var_key").alias("cs_size"), F.max("pip").alias("max_pip"), F.sum("pip").alias("pip_sum"))


def tissue_summary(df: DataFrame, high: float = POSITIVE_PIP) -> DataFrame:
    return df.groupBy("tissue").agg(
        F.count("*").alias("n_rows"), F.count_distinct("var_key").alias("n_variants"), F.count_distinct("gene_id").alias("n_genes"),
        F.count_if(F.col("pip") >= high).alias("n_high"),
    )


def summary_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Row, variant, phenotype and (variant, phenotype) counts; the distinct counts may be sketches on request."""
    d = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy("tissue").agg(
        F.count("*").alias("n_rows"), d("var_key").alias("n_variants"), d("trait").alias("n_traits"), d(F.struct("var_key", "trait")).alias("n_pairs"),
    )


def ambiguous_sets(members: DataFrame, by: Sequence[str] = ("tissue", "cs_id"), high: float = POSITIVE_PIP, reach: int = AMBIGUOUS_REACH) -> DataFrame:
    """Stage flags per set: no clear winner, 2–10 members, intron inside its gene, only SNVs, all near both intron ends.

    ``members`` carry var_key, pip, pos, is_snv, istart, iend, in_gene.
    """
    lo, hi = AMBIGUOUS_SIZE
    near = (F.abs(F.col("pos") - F.col("istart")) <= reach) & (F.abs(F.col("pos") - F.col("iend")) <= reach)
    g = members.groupBy(*by).agg(
        F.max("pip").alias("max_pip"), F.count("*").alias("n"), F.every("in_gene").alias("gene_ok"), F.every("is_snv").alias("snv_ok"), F.every(near).alias("near_ok"),
    )
    s1 = F.col("max_pip") < high
    s2 = s1 & F.col("n").between(lo, hi)
    s3 = s2 & F.col("gene_ok")
    s4 = s3 & F.col("snv_ok")
    return g.withColumns({"stage1": s1, "stage2": s2, "stage3": s3, "stage4": s4, "stage5": s4 & F.col("near_ok")})


def ambiguous_funnel(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count("*").alias("n_sets"), *[F.count_if(f"stage{i}").alias(f"n_stage{i}") for i in range(1, 6)])


def set_statistics(members: DataFrame, by: Sequence[str] = ("tissue", "cs_id")) -> DataFrame:
    """Size, span, best and second-best pip per set (two running maxima, the pip list is never collected)."""
    g = members.groupBy(*by).agg(
        F.count("*").alias("n"), (F.max("pos") - F.min("pos")).alias("span"), F.max(F.struct("pip", "var_key")).alias("_top"),
    )
    second = lookup(members, g.select(*by, "_top"), list(by)).filter(F.struct("pip", "var_key") != F.col("_top")).groupBy(*by).agg(F.max("pip").alias("second_pip"))
    return lookup(g, second, list(by), "left").select(*by, "n", "span", F.col("_top.pip").alias("max_pip"), F.col("_top.var_key").alias("top_variant"), "second_pip")


def size_distribution(stats: DataFrame, by: Sequence[str] = ("n",)) -> DataFrame:
    return stats.groupBy(*by).agg(F.count("*").alias("n_sets"))


def variant_tissues(members: DataFrame) -> DataFrame:
    """Tissues of each variant as a sorted list (bounded by the number of tissues)."""
    return members.groupBy("var_key").agg(F.array_join(F.array_sort(F.collect_set("tissue")), ",").alias("tissues"), F.count_distinct("tissue").alias("n_tissues"))


def companions(members: DataFrame, positives: DataFrame, by: Sequence[str] = ("tissue", "cs_id")) -> DataFrame:
    """All members of every set that holds a positive, with the set's first positive and a flag for positives."""
    p = positives.select("tissue", "var_key").distinct().withColumn("is_positive", F.lit(True))
    m = lookup(members, p, ["tissue", "var_key"], "left").withColumn("is_positive", F.coalesce("is_positive", F.lit(False)))
    lead = m.filter("is_positive").groupBy(*by).agg(F.min("var_key").alias("positive_key"))
    return lookup(m, lead, list(by))


def same_members(members: DataFrame, across: str = "tissue", by: Sequence[str] = ("cs_id",)) -> DataFrame:
    """Whether a set has the same members in each tissue it occurs in: pairs = tissues × members, no set is collected."""
    d = members.select(*by, across, "var_key").distinct()
    g = d.groupBy(*by).agg(F.count("*").alias("_pairs"), F.count_distinct(across).alias("n_tissues"), F.count_distinct("var_key").alias("n_members"))
    return g.withColumn("same", F.col("_pairs") == F.col("n_tissues") * F.col("n_members")).drop("_pairs")


def membership_codes(sets: dict[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Bit code per key over named sets (first set = bit 1)."""
    out = None
    for i, d in enumerate(sets.values()):
        one = d.select(*key).distinct().withColumn("code", F.lit(1 << i))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*key).agg(F.bit_or("code").alias("code"))


def top_agreement(scored: DataFrame, by: Sequence[str] = ("tissue", "cs_id"), head: str = "head") -> DataFrame:
    """Per set and head: is the member with the best pip also the one with the best score (ties: smallest key)?"""
    d = scored.filter("pip IS NOT NULL AND score IS NOT NULL")
    g = d.groupBy(*by, head).agg(
        F.count("*").alias("n"), F.min_by("var_key", F.struct(-F.col("pip"), F.col("var_key"))).alias("by_pip"), F.min_by("var_key", F.struct(-F.col("score"), F.col("var_key"))).alias("by_score"),
    )
    return g.filter("n >= 2").withColumn("match", F.col("by_pip") == F.col("by_score"))


def calls_per_set(scored: DataFrame, thresholds: dict[str, float], by: Sequence[str] = ("tissue", "cs_id")) -> DataFrame:
    """Members called at the head's threshold, per set."""
    t = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    d = scored.filter("score IS NOT NULL")
    return d.groupBy(*by, "head").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.element_at(t, F.col("head"))).alias("n_called"))


def call_distribution(calls: DataFrame, by: Sequence[str] = ("head",)) -> DataFrame:
    c = F.col("n_called")
    return calls.groupBy(*by).agg(
        F.count("*").alias("n_sets"), F.avg((c == 0).cast("int")).alias("p0"), F.avg((c == 1).cast("int")).alias("p1"), F.avg((c == 2).cast("int")).alias("p2"), F.avg((c >= 3).cast("int")).alias("p3plus"),
    )
