"""Position joins: points in intervals, first containing gene, nearest marks, flanking exons, overlap resolution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.operators.ordered import lookup, running
from splicelake.session import written

# Intervals longer than this many fine bins go to the coarse level.
_FINE_SPAN = 16
_COARSE = 64


def _bins(lo: Column, hi: Column, width: int) -> Column:
    fine = (hi - lo) < width * _FINE_SPAN
    spread = lambda w, lvl: F.transform(F.sequence(F.floor(lo / w), F.floor(hi / w)), lambda b: F.struct(F.lit(lvl).alias("lvl"), b.alias("bin")))
    return F.when(fine, spread(width, 0)).otherwise(spread(width * _COARSE, 1))


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, pos: str, start: str, end: str, by: Sequence[str], bin_width: int = 16384, distinct: bool = True,
) -> DataFrame:
    """All (point, interval) pairs with start <= pos <= end and equal ``by``, as an equi join on coordinate bins.

    Intervals are spread over the bins they touch (two bin sizes, so long ones stay cheap). With ``distinct`` the bin
    join runs on distinct positions — a bin then holds at most ``bin_width`` points however deep the coverage — and the
    pairs come back to the rows by an equi join that adaptive execution can split.
    """
    by = list(by)
    p = points.select(*by, pos).distinct() if distinct else points
    at = F.array(*[F.struct(F.lit(i).alias("lvl"), F.floor(F.col(pos) / w).alias("bin")) for i, w in enumerate((bin_width, bin_width * _COARSE))])
    pb = p.select("*", F.inline(at))
    ib = intervals.filter(F.col(start) <= F.col(end)).withColumn("_b", _bins(F.col(start), F.col(end), bin_width))
    ib = ib.select("*", F.inline("_b")).drop("_b")
    pairs = pb.join(ib, [*by, "lvl", "bin"]).filter(F.col(pos).between(F.col(start), F.col(end))).drop("lvl", "bin")
    return points.join(pairs, [*by, pos]) if distinct else pairs


def first_containing(points: DataFrame, intervals: DataFrame, pos: str, start: str, end: str, by: Sequence[str], ident: str, bin_width: int = 16384, pos_end: str | None = None) -> DataFrame:
    """The interval with the smallest start (then id) that holds each distinct point or span; null when none does."""
    by = list(by)
    key = [*by, pos] + ([pos_end] if pos_end else [])
    d = points.select(*key).distinct()
    pairs = points_in_intervals(d, intervals.select(*by, start, end, ident), pos, start, end, by, bin_width, distinct=False)
    if pos_end:
        pairs = pairs.filter(F.col(pos_end) <= F.col(end))
    best = pairs.groupBy(*key).agg(F.min_by(ident, F.struct(start, ident)).alias(ident))
    return lookup(points, best, key, "left")


def nearest_marks(points: DataFrame, marks: DataFrame, pos: str, mark: str, by: Sequence[str], bin_width: int = 1 << 20) -> DataFrame:
    """Previous (<=) and next (>=) mark of every distinct point: two running extremes over coordinate chunks."""
    by = list(by)
    u = points.select(*by, F.col(pos).alias("_p"), F.lit(None).cast("int").alias("_m"), F.lit(True).alias("_pt")).unionByName(
        marks.select(*by, F.col(mark).alias("_p"), F.col(mark).cast("int").alias("_m"), F.lit(False).alias("_pt"))
    )
    u = u.groupBy(*by, "_p").agg(F.max("_m").alias("_m"), F.max("_pt").alias("_pt"))
    chunk = F.floor(F.col("_p") / bin_width)
    u = running(u, by, "_p", {"mark_before": F.col("_m")}, chunk_expr=chunk, agg=F.max)
    u = running(u, by, "_p", {"mark_after": F.col("_m")}, chunk_expr=chunk, agg=F.min, descending=True)
    return u.filter("_pt").select(*by, F.col("_p").alias(pos), "mark_before", "mark_after")


def nearest_distance(points: DataFrame, marks: DataFrame, pos: str, mark: str, by: Sequence[str], max_dist: int | None = None, out: str = "splice_dist") -> DataFrame:
    """Distance to the nearest mark with equal ``by``; null without a mark or beyond ``max_dist``."""
    n = nearest_marks(points, marks, pos, mark, by)
    d = F.least(F.col(pos) - F.col("mark_before"), F.col("mark_after") - F.col(pos))
    if max_dist is not None:
        d = F.when(d <= max_dist, d)
    return lookup(points, n.withColumn(out, d).drop("mark_before", "mark_after"), [*by, pos], "left")


def flanking_introns(tested: DataFrame, exons: DataFrame, by: Sequence[str], start: str = "estart", end: str = "eend") -> DataFrame:
    """Intron lengths to the last exon ending before and the first exon starting after each tested exon.

    ``least``/``greatest`` ignore a missing side; the mean needs both.
    """
    by = list(by)
    ends = exons.select(*by, (F.col(end) + 1).alias("m"))
    starts = exons.select(*by, (F.col(start) - 1).alias("m"))
    up = nearest_marks(tested, ends, start, "m", by).select(*by, start, (F.col(start) - F.col("mark_before") + 1).alias("up_intron"))
    down = nearest_marks(tested, starts, end, "m", by).select(*by, end, (F.col("mark_after") + 1 - F.col(end)).alias("down_intron"))
    j = lookup(lookup(tested, up, [*by, start], "left"), down, [*by, end], "left")
    u, d = F.col("up_intron"), F.col("down_intron")
    return j.withColumns({"min_intron": F.least(u, d), "max_intron": F.greatest(u, d), "mean_intron": (u + d) / 2})


def gene_bounds(features: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Smallest start and largest end per gene; region and strand from its first feature by position."""
    first = F.min(F.struct("gstart", "gend", "region", "strand"))
    g = features.groupBy(gene).agg(F.min("gstart").alias("gstart"), F.max("gend").alias("gend"), first.alias("_f"))
    return g.select(gene, "_f.region", "_f.strand", "gstart", "gend")


def boundary_positions(features: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sorted distinct boundary positions (starts and ends) per gene or chromosome, one row each."""
    return features.select(*by, F.explode(F.array("gstart", "gend")).alias("pos")).distinct()


def overlap_islands(intervals: DataFrame, by: Sequence[str], start: str, end: str, bin_width: int = 1 << 22) -> DataFrame:
    """Number maximal runs of overlapping intervals; intervals of different islands never touch."""
    by = list(by)
    pos = intervals.groupBy(*by, start).agg(F.max(end).alias("_e"))
    chunk = F.floor(F.col(start) / bin_width)
    pos = running(pos, by, start, {"_reach": F.col("_e")}, chunk_expr=chunk, agg=F.max)
    # reach strictly before this start = running maximum of the previous start position
    shifted = running(pos, by, start, {"_prev_start": F.lit(1)}, chunk_expr=chunk)
    prev = shifted.select(*by, (F.col("_prev_start") + 1).alias("_prev_start"), F.col("_reach").alias("_reach_before"))
    head = lookup(shifted.drop("_reach", "_e"), prev, [*by, "_prev_start"], "left")
    new = F.when(F.col("_reach_before") > F.col(start), 0).otherwise(1)
    isl = running(head.drop("_prev_start"), by, start, {"island": new}, chunk_expr=chunk).drop("_reach_before")
    return lookup(intervals, isl, [*by, start])


def resolve_overlaps(intervals: DataFrame, by: Sequence[str], start: str = "gstart", end: str = "gend", ident: str = "gene_id", chunk_rows: int = 200_000) -> DataFrame:
    """Trim or drop overlapping intervals until none is left.

    A pass settles each interval against the last one before it, in order of the starts; passes go on until one finds no overlap. The order
    is cut into chunks of about ``chunk_rows`` intervals, however crowded a stretch is.
    """
    by = list(by)
    cols = [*by, start, end, ident]
    d, order = intervals.select(*cols), [start, end, ident]
    n_chunks = max(1, -(-d.count() // chunk_rows))
    while True:
        d, n_settled = _settle_once(d, by, cols, order, n_chunks)
        if not n_settled:
            return d.select(*cols)
        # equal starts keep the order of the pass before
        order = [start, "_chunk", "_idx"]


def _settle_once(d: DataFrame, by: list[str], cols: list[str], order: list[str], n_chunks: int) -> tuple[DataFrame, int]:
    """One pass over all chunks, and the number of overlaps it has settled.

    What a chunk needs to know of the rows before it is one interval, the last one kept. All chunks first start without it. Where the chunk
    before ends in an interval that reaches into a chunk, that chunk alone is settled again from there, until no chunk begins with
    another interval than it was settled from. Only these last intervals, one for each chunk, come to the driver.
    """
    k = len(by)
    placed = d.repartitionByRange(n_chunks, *by, *order).sortWithinPartitions(*by, *order).select(*cols, F.monotonically_increasing_id().alias("_place"))
    placed = written(placed.withColumn("_chunk", F.shiftright("_place", 33)), "intervals")
    first_row = F.min_by(F.struct(*cols), "_place")
    heads = {r["_chunk"]: tuple(r["first"]) for r in placed.groupBy("_chunk").agg(first_row.alias("first")).collect()}
    chunks, begins, todo, rounds, lasts = sorted(heads), {}, sorted(heads), [], {}
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in placed.select(*cols).schema)}, _chunk long, _idx long, _last boolean, _n long"
    while todo:
        out = placed.filter(F.col("_chunk").isin(todo)).groupBy("_chunk").applyInPandas(_chunk_fold(dict(begins), cols, k), schema)
        out = written(out, "settled")
        rounds.append(out)
        for r in out.filter("_last").collect():
            lasts[r["_chunk"]] = (len(rounds) - 1, tuple(r[c] for c in cols), r["_n"])
        reached = {}
        for before, chunk in zip(chunks, chunks[1:]):
            last, head = lasts[before][1], heads[chunk]
            if last[:k] == head[:k] and head[k] < last[k + 1]:
                reached[chunk] = last
        todo = [c for c in chunks if reached.get(c) != begins.get(c)]
        begins = reached
    handed_on = [before for before, chunk in zip(chunks, chunks[1:]) if chunk in begins]
    parts = [out.filter(F.col("_chunk").isin([c for c in chunks if lasts[c][0] == i])) for i, out in enumerate(rounds)]
    result = reduce(DataFrame.unionByName, parts) if parts else d.select(*cols, *[F.lit(0).cast("long").alias(c) for c in ("_chunk", "_idx")], F.lit(False).alias("_last"))
    return result.filter(~(F.col("_last") & F.col("_chunk").isin(handed_on))).drop("_last", "_n"), sum(n for _, _, n in lasts.values())


def _chunk_fold(begins: dict[int, tuple], cols: list[str], k: int):
    """Settles the rows of a chunk in order, from the interval that reaches into it, if there is one."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, done, group, n = [], [], None, 0
        if key[0] in begins:
            group, done = begins[key[0]][:k], [begins[key[0]][k:]]
        for row in pdf.sort_values("_place")[cols].itertuples(index=False, name=None):
            if row[:k] != group:
                out += [(*group, *x) for x in done] if group is not None else []
                group, done = row[:k], []
            n += bool(done) and row[k] < done[-1][1]
            done = _add_interval(done, row[k:])
        out += [(*group, *x) for x in done]
        res = pd.DataFrame(out, columns=cols)
        idx = range(len(res))
        return res.assign(_chunk=key[0], _idx=idx, _last=[i == len(res) - 1 for i in idx], _n=n)

    return fold


def _add_interval(done: list[tuple], new: tuple) -> list[tuple]:
    """``done`` with one interval more, after an overlap with the last one is settled.

    The interval for which the overlap is the smaller share, so the longer one, gives it up; the last one does so when both are
    equally long. What lies inside another interval, or has nothing left, goes.
    """
    pair = [new]
    if done and new[0] < done[-1][1]:
        start, end, ident = done.pop()
        if start <= new[0] and new[1] <= end:
            pair = [(start, end, ident)]
        elif end - start >= new[1] - new[0]:
            pair = [(start, new[0], ident), new]
        else:
            pair = [(start, end, ident), (end, new[1], new[2])]
    done += [x for x in pair if x[0] < x[1]]
    return done
