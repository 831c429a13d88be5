"""Running totals, ranks and exact percentiles that never put a whole group into one task.

A group may hold a third of all rows, so a plain ``Window.partitionBy(group)`` is not safe. Rows are cut into
ordered chunks (quantiles of the ordering value over *all* rows, so a chunk of any group is at most about
``1/chunks`` of the table); each chunk is summed on its own and gets the total of the chunks before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.session import SINGLE_CHUNK_BYTES, estimated_bytes, shuffle_width, written

CHUNK = "_chunk"


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys (still a hash-partitioned equi join)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``right`` (one row per key) to ``left`` on null-safe keys, keeping ``left``'s key columns."""
    l, r = left.alias("l"), right.alias("r")
    cond = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, cond, how).select("l.*", *extra)


def _fit_chunks(df: DataFrame, order: str, n: int) -> list[float]:
    probs = [i / n for i in range(1, n)]
    cuts = df.select(F.col(order).cast("double").alias("v")).approxQuantile("v", probs, 1.0 / (4 * n))
    return [float("-inf"), *sorted(set(c for c in cuts if c == c)), float("inf")]


def with_chunks(df: DataFrame, order: str, chunks: int | None = None) -> tuple[DataFrame, bool]:
    """Add ``_chunk``, monotone in ``order``; the flag says that one chunk holds everything (small input)."""
    if chunks is None:
        chunks = 1 if estimated_bytes(df) < SINGLE_CHUNK_BYTES else shuffle_width(df.sparkSession)
    if chunks > 1:
        cuts = _fit_chunks(df, order, chunks)
        if len(cuts) > 2:
            v = df.withColumn("_v", F.col(order).cast("double"))
            out = Bucketizer(splits=cuts, inputCol="_v", outputCol=CHUNK, handleInvalid="keep").transform(v)
            return out.drop("_v").withColumn(CHUNK, F.col(CHUNK).cast("int")), False
    return df.withColumn(CHUNK, F.lit(0)), True


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    values: dict[str, Column],
    descending: bool = False,
    chunks: int | None = None,
    chunk_expr: Column | None = None,
    agg=F.sum,
    totals: bool = False,
) -> DataFrame:
    """Inclusive running ``agg`` of each value over ``order`` inside ``by``; (by, order) must be unique.

    ``chunk_expr`` names a natural monotone chunk (a coordinate bin, a hash prefix). ``totals`` adds
    ``<name>_total`` over the whole group.
    """
    by = list(by)
    d = df.withColumns({f"_in_{k}": v for k, v in values.items()})
    if chunk_expr is not None:
        d, single = d.withColumn(CHUNK, chunk_expr), False
    else:
        d, single = with_chunks(d, order, chunks)
    o = F.col(order).desc() if descending else F.col(order)
    inner = Window.partitionBy(*by, CHUNK).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    d2 = d.withColumns({k: agg(f"_in_{k}").over(inner) for k in values})
    if single:
        if totals:
            whole = Window.partitionBy(*by, CHUNK)
            d2 = d2.withColumns({f"{k}_total": agg(f"_in_{k}").over(whole) for k in values})
        return d2.drop(CHUNK, *[f"_in_{k}" for k in values])

    per = d.groupBy(*by, CHUNK).agg(*[agg(f"_in_{k}").alias(f"_part_{k}") for k in values])
    co = F.col(CHUNK).desc() if descending else F.col(CHUNK)
    before = Window.partitionBy(*by).orderBy(co).rowsBetween(Window.unboundedPreceding, -1)
    cols = {f"_before_{k}": agg(f"_part_{k}").over(before) for k in values}
    if totals:
        cols |= {f"_all_{k}": agg(f"_part_{k}").over(Window.partitionBy(*by)) for k in values}
    per = per.withColumns(cols).drop(*[f"_part_{k}" for k in values])
    j = lookup(d2, per, [*by, CHUNK])
    join2 = {}
    for k in values:
        b = F.col(f"_before_{k}")
        if agg is F.sum:
            join2[k] = F.coalesce(b + F.col(k), F.col(k), b)
        elif agg is F.max:
            join2[k] = F.greatest(b, F.col(k))
        elif agg is F.min:
            join2[k] = F.least(b, F.col(k))
        else:
            raise ValueError("running supports sum, min and max")
        if totals:
            join2[f"{k}_total"] = F.col(f"_all_{k}")
    j = j.withColumns(join2)
    return j.drop(CHUNK, *[f"_{p}_{k}" for k in values for p in ("in", "before", "all")])


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds the place of every row, from 0, in the order of all rows; ``order`` should tell rows apart, else equal rows follow somehow.

    Range partitions are numbered inside and written once; the counts of the partitions, one number each, give the rest.
    """
    d = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    d = written(d, "numbered").withColumn("_part", F.shiftright("_i", 33))
    per = d.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(per.select("_part", ahead.alias("_ahead")), "_part")
    return d.withColumn(out, F.col("_ahead") + F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_part", "_i", "_ahead")


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str, count: str | None = None, chunks: int | None = None) -> DataFrame:
    """One row per (by, value) with the average rank of its tie group; ``count`` weights rows already grouped."""
    n = F.sum(count) if count else F.count(F.lit(1))
    g = df.groupBy(*by, value).agg(n.cast("long").alias("_n"))
    g = running(g, by, value, {"_cum": F.col("_n")}, chunks=chunks)
    return g.select(*by, value, (F.col("_cum") - (F.col("_n") - 1) / 2).alias(out), F.col("_n").alias(f"{out}_ties"))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float], chunks: int | None = None) -> DataFrame:
    """Linear-interpolated percentiles per group from tie-group counts; memory does not grow with the group."""
    by = list(by)
    g = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    g = running(g, by, value, {"_cum": F.col("_n")}, chunks=chunks, totals=True)
    v = F.col(value).cast("double")
    aggs = []
    for name, q in qs.items():
        h = (F.col("_cum_total") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        start = F.col("_cum") - F.col("_n")
        at = lambda i: F.max(F.when((start <= i) & (i < F.col("_cum")), v))
        frac = F.max(h - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return g.groupBy(*by).agg(*aggs)


def hash_key(seed: int, *keys: str) -> Column:
    """Seeded, engine-independent pseudo-random order key (32 hex digits)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_rank(df: DataFrame, by: Sequence[str], keys: Sequence[str], seed: int, out: str = "rn") -> DataFrame:
    """Row number in seeded hash order inside ``by``: a reproducible shuffle without one sorted task per group."""
    d = df.withColumn("_h", hash_key(seed, *keys))
    d = running(d, by, "_h", {out: F.lit(1).cast("long")}, chunk_expr=F.substring("_h", 1, 3))
    return d.drop("_h")
