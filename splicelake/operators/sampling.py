"""Reproducible splits and picks: every choice is a rank in a seeded hash order, independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions import scalar as S
from splicelake.operators.ordered import hash_key, hash_rank, lookup, running


def split_by_lists(df: DataFrame, sample: str, chrom: str, train: DataFrame, test: DataFrame, train_chroms: Sequence[str], test_chroms: Sequence[str], paralog: str | None = None) -> DataFrame:
    """Rows of listed samples on the split's chromosomes, with a ``split`` label.

    Test rows come only from test chromosomes; with ``paralog``, paralogs train from every chromosome and are never tested.
    """
    par = F.col(paralog) if paralog else None
    ids = train.select(F.col("sample").alias(sample)).distinct().withColumn("_s", F.lit("train")).unionByName(test.select(F.col("sample").alias(sample)).distinct().withColumn("_s", F.lit("test")))
    j = df.join(ids, sample)
    on_train = S.on_chromosomes(F.col(chrom), list(train_chroms), par)
    on_test = F.col(chrom).isin(*test_chroms) & (F.lit(True) if par is None else par == 0)
    keep = ((F.col("_s") == "train") & on_train) | ((F.col("_s") == "test") & on_test)
    return j.filter(keep).withColumnRenamed("_s", "split")


def _replicate_rank(d: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    h = F.md5(F.concat_ws(":", (F.col("replicate") + seed).cast("string"), *[F.col(k).cast("string") for k in keys]))
    d = d.withColumn("_h", h)
    return running(d, ["replicate"], "_h", {"_rn": F.lit(1).cast("long")}, chunk_expr=F.substring("_h", 1, 3)).drop("_h")


def replicate_splits(df: DataFrame, keys: Sequence[str], n_splits: int, fraction: float, seed: int = 42, eligible: Column | None = None, of_all: bool = False) -> DataFrame:
    """``n_splits`` train/validation labels; validation rows come from eligible rows only, their number is
    floor(fraction × rows), counted over eligible rows or over all rows."""
    ok = F.lit(True) if eligible is None else eligible
    d = df.withColumn("_ok", ok)
    base = (d if of_all else d.filter("_ok")).agg(F.floor(F.count("*") * F.lit(float(fraction))).alias("n")).scalar()
    x = d.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    ranked = _replicate_rank(x.filter("_ok"), keys, seed).withColumn("split", F.when(F.col("_rn") <= base, "validation").otherwise("train")).drop("_rn")
    return ranked.unionByName(x.filter("NOT _ok").withColumn("split", F.lit("train"))).drop("_ok")


def paralog_splits(df: DataFrame, keys: Sequence[str], paralog: str, n_splits: int, fraction: float, seed: int = 42) -> DataFrame:
    """Splits of the non-paralogs, and the paralogs as an output of their own (split ``paralogs``, replicate 0)."""
    apart = df.filter(F.col(paralog) == 1).withColumns({"replicate": F.lit(0), "split": F.lit("paralogs")})
    return replicate_splits(df.filter(F.col(paralog) == 0), keys, n_splits, fraction, seed).unionByName(apart)


def usable_transcripts(df: DataFrame, chrom: str, paralog: str, excluded: Sequence[str], autosomes_only: bool = True) -> DataFrame:
    d = df.filter(S.is_autosome(F.col(chrom))) if autosomes_only else df
    return d.filter(~S.outside_training(F.col(chrom), list(excluded), F.col(paralog))) if excluded else d


def chromosome_holdout(df: DataFrame, keys: Sequence[str], chrom: str, paralog: str, test_chroms: Sequence[str], fraction: float, seed: int = 42, each_chromosome: bool = False) -> DataFrame:
    """test = non-paralogs on the test chromosomes; validation = floor(fraction × rest) non-paralogs, if asked at least one per chromosome; too few rows raise."""
    par = F.col(paralog)
    d = df.withColumn("_h", hash_key(seed, *keys))
    is_test = F.col(chrom).isin(*test_chroms) & (par == 0)
    rest = d.filter(~is_test)
    target = rest.agg(F.floor(F.count("*") * F.lit(float(fraction))).alias("n")).scalar()
    pool = rest.filter(par == 0)
    first = pool.groupBy(chrom).agg(F.min("_h").alias("_first"))
    pool = lookup(pool, first, [chrom]).withColumn("_must", (F.col("_h") == F.col("_first")) & F.lit(each_chromosome)).drop("_first")
    # forced rows sort before all others, so one rank decides both rules
    pool = pool.withColumn("_o", F.concat(F.when(F.col("_must"), "0").otherwise("1"), F.col("_h")))
    pool = running(pool, [], "_o", {"_rn": F.lit(1).cast("long")}, chunk_expr=F.substring("_o", 1, 4), totals=True)
    short = F.when(F.col("_rn_total") < target, F.raise_error(F.lit("not enough non-paralog rows for the validation fraction")))
    pool = pool.withColumn("split", F.coalesce(short.cast("string"), F.when(F.col("_must") | (F.col("_rn") <= target), "validation").otherwise("train")))
    out = [*df.columns, "split"]
    rest_paralogs = rest.filter(par != 0).withColumn("split", F.lit("train"))
    return pool.select(*out).unionByName(rest_paralogs.select(*out)).unionByName(d.filter(is_test).withColumn("split", F.lit("test")).select(*out))


def stratified_pick(df: DataFrame, keys: Sequence[str], stratum: str, quotas: dict[str, int], seed: int = 42, exclude: DataFrame | None = None, require: Sequence[DataFrame] = (), not_null: Sequence[str] = ()) -> DataFrame:
    """Exact quota per stratum after exclusions and required lists; a stratum that is short raises."""
    d = df.filter(F.col(stratum).isin(*quotas))
    for c in not_null:
        d = d.filter(F.col(c).isNotNull())
    if exclude is not None:
        d = d.join(exclude.select(*keys), list(keys), "left_anti")
    for r in require:
        d = d.join(r.select(*keys), list(keys), "left_semi")
    q = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum))
    d = hash_rank(d, [stratum], keys, seed, "_rn")
    n = d.groupBy(stratum).agg(F.max("_rn").alias("_have"))
    d = lookup(d, n, [stratum]).withColumn("_quota", q)
    ok = F.when(F.col("_have") < F.col("_quota"), F.raise_error(F.concat(F.lit("not enough rows in stratum "), F.col(stratum)))).otherwise(F.col("_rn") <= F.col("_quota"))
    return d.filter(ok).drop("_rn", "_have", "_quota")


def pick_from_list(pool: DataFrame, key: str, n: int, seed: int = 42, exclude: DataFrame | None = None, require: Sequence[DataFrame] = (), remove: Sequence[str] = ()) -> DataFrame:
    """``n`` keys of a list after exclusions, required memberships and manual removals; too few raise."""
    d = pool.select(key).distinct()
    if remove:
        d = d.filter(~F.col(key).isin(*remove))
    if exclude is not None:
        d = d.join(exclude.select(key), key, "left_anti")
    for r in require:
        d = d.join(r.select(key), key, "left_semi")
    d = d.withColumn("_h", hash_key(seed, key))
    d = running(d, [], "_h", {"_rn": F.lit(1).cast("long")}, chunk_expr=F.substring("_h", 1, 3), totals=True)
    ok = F.when(F.col("_rn_total") < n, F.raise_error(F.lit("not enough candidates"))).otherwise(F.col("_rn") <= n)
    return d.filter(ok).select(key)


def rows_of_samples(df: DataFrame, uid: str, samples: DataFrame, sample: str = "sample") -> DataFrame:
    """Rows whose id starts with a listed sample."""
    return df.withColumn(sample, S.uid_head(F.col(uid))).join(samples.select(sample).distinct(), sample, "left_semi")
