"""One-to-one matching of positive and negative variants by expression, gene, alleles and splice distance.

Positives: tissue, var_key, gene_id, ref, alt, splice_dist, pip. Negatives: the same without pip. Both carry ``bin``
(null when the gene has none). All candidates of a positive share its (tissue, bin), or its gene when there is no
bin, so groups are independent. Larger groups are first cut, exactly, to the negatives that any positive can reach:
with P positives in a group no positive ever looks past its P nearest candidates on either side in any tier.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators.ordered import CHUNK, exact_percentiles, lookup, running, with_chunks
from splicelake.session import written

# Tier numbers of the candidate classes, and the number used for optimal matching.
TIERS = {1: ("gene_id", "ref", "alt"), 2: ("gene_id",), 3: ("grp", "ref", "alt"), 4: ("grp",)}
OPTIMAL_TIER = 99
#: Negatives of a group that a task takes whole, with a few hundred bytes each.
GROUP_ROWS = 1 << 22


def match_order(var_key):
    """Ties in distance are broken by the hash of the key: spread evenly, so tied rows can be numbered in chunks."""
    return F.md5(var_key)


def with_group(df: DataFrame) -> DataFrame:
    grp = F.when(F.col("bin").isNotNull(), F.concat(F.lit("b"), F.col("bin").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("gene_id")))
    return df.withColumns({"grp": grp, "_k": match_order(F.col("var_key"))})


def best_rows(df: DataFrame, by: Sequence[str], first: str, ascending: bool = True) -> DataFrame:
    """One row per key: smallest (or largest) ``first``, then key hash."""
    rest = [c for c in df.columns if c not in by]
    order = F.struct(F.col(first) if ascending else -F.col(first), match_order(F.col("var_key")), F.col("gene_id"))
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def exclude_positives(neg: DataFrame, pos: DataFrame) -> DataFrame:
    return neg.join(pos.select("tissue", "var_key").distinct(), ["tissue", "var_key"], "left_anti")


def reachable(pos: DataFrame, neg: DataFrame, by: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Negatives within P places of some positive of the same class, P = positives of the whole group.

    Works on counts per distinct distance; only ties need places inside the tie, numbered by key hash.
    """
    by, group = list(by), list(group)
    size = pos.groupBy(*group).agg(F.count("*").alias("_P"))
    extra = [c for c in group if c not in by]
    cls = [*by, *extra]
    u = pos.select(*cls, "splice_dist", F.lit(1).alias("p"), F.lit(0).alias("n")).unionByName(neg.select(*cls, "splice_dist", F.lit(0).alias("p"), F.lit(1).alias("n")))
    g = u.groupBy(*cls, "splice_dist").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # cut points are found once and kept as a column for all four passes
    g, single = with_chunks(g, "splice_dist")
    g = g.withColumnRenamed(CHUNK, "_part")
    how = {"chunks": 1} if single else {"chunk_expr": F.col("_part")}
    for name, desc in (("r", False), ("l", True)):
        g = running(g, cls, "splice_dist", {f"_c{name}": F.col("n")}, descending=desc, **how)
        start = F.col(f"_c{name}") - F.col("n")
        g = running(g, cls, "splice_dist", {f"_m{name}": F.when(F.col("p") > 0, start)}, descending=desc, agg=F.max, **how)
        g = g.withColumn(f"_gap{name}", start - F.col(f"_m{name}"))
    g = g.select(*cls, "splice_dist", F.least("_gapr", "_gapl").alias("_gap")).filter("_gap IS NOT NULL")
    g = lookup(g, size, group).filter("_gap < _P").withColumn("_room", F.col("_P") - F.col("_gap")).drop("_gap", "_P")
    d = lookup(neg, g, [*cls, "splice_dist"])
    d = running(d, [*cls, "splice_dist"], "_k", {"_place": F.lit(1)}, chunk_expr=F.substring("_k", 1, 2))
    return d.filter("_place <= _room").select(*neg.columns)


def cut_candidates(pos: DataFrame, neg: DataFrame, classes: Sequence[Sequence[str]], force: bool = False) -> DataFrame:
    """Union of the reachable negatives of all classes; where no group has more than ``GROUP_ROWS``, all pass (the result is the same)."""
    if not force and (neg.groupBy("tissue", "grp").count().agg(F.max("count")).first()[0] or 0) <= GROUP_ROWS:
        return neg
    parts = [reachable(pos, neg, ["tissue", *c], ["tissue", "grp"]) for c in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


PAIR_SCHEMA = "tissue string, pos_var_key string, gene_id string, neg_var_key string, neg_var_key_ideal string, tier int, ideal_tier int, pos_pip double, pos_dist long, neg_dist long"


def _fresh(df: DataFrame) -> DataFrame:
    """New column identities, so that two frames of one origin can be grouped together."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


class _Line:
    """Candidates of all classes of a tier, each class a stretch of the distance line; taken ones are skipped through path-compressed links.

    ``right`` goes up from a distance, ``left`` down from it; classes below 0 take no part.
    """

    def __init__(self, classes: np.ndarray, dist: np.ndarray, place: np.ndarray, low: int, high: int):
        self.low, self.high, self.width = low, high, high - low + 1
        own = np.flatnonzero(classes >= 0)
        classes, near = classes[own], dist[own] - low
        self.rows, self.at, self.skip = {}, {}, {}
        for side, along in ((True, near), (False, high - low - near)):
            at = classes * self.width + along
            order = np.lexsort((place[own], at))
            self.rows[side], self.at[side] = own[order].astype(np.int32), at[order]
            self.skip[side] = np.arange(len(own) + 1, dtype=np.int32)

    def starts(self, side: bool, classes: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each positive the first candidate of its class on a side (equal distances are on the right), and where the class ends."""
        along = dist - self.low if side else self.high - dist + 1
        first = np.searchsorted(self.at[side], classes * self.width + along, "left")
        end = np.searchsorted(self.at[side], (classes + 1) * self.width, "left")
        return first, np.where(classes >= 0, end, 0)


def _classes(pp: pa.Table, nn: pa.Table, tiers: Sequence[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Class numbers of positives and negatives for each tier; -1 where a value is missing."""
    codes = {}
    for c in ("gene_id", "ref", "alt"):
        values = pa.chunked_array([*pp.column(c).chunks, *nn.column(c).chunks], pp.schema.field(c).type).combine_chunks()
        codes[c] = pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for tier in tiers:
        total, missing = np.zeros(len(pp) + len(nn), np.int64), np.zeros(len(pp) + len(nn), bool)
        for c in TIERS[tier]:
            if c in codes:
                total, missing = total * (codes[c].max(initial=0) + 1) + codes[c], missing | (codes[c] < 0)
        total[missing] = -1
        out[tier] = (total[: len(pp)], total[len(pp) :])
    return out


def _greedy(pp: pa.Table, nn: pa.Table, tiers: Sequence[int], cap: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of the partner and its tier, and the same without earlier picks, for positives in their order; -1 and 0 where there is none."""
    d, dist = (t.column("splice_dist").to_numpy().astype(np.int64) for t in (pp, nn))
    n = len(d)
    real, tier_of, ideal, ideal_tier = np.full(n, -1), np.zeros(n, np.int32), np.full(n, -1), np.zeros(n, np.int32)
    if not n or not len(dist):
        return real, tier_of, ideal, ideal_tier
    # equal keys have one place
    order = pc.sort_indices(nn.column("_k")).to_numpy()
    keys = nn.column("_k").take(pa.array(order)).combine_chunks()
    place = np.empty(len(nn), np.int64)
    place[order] = np.concatenate([[0], np.cumsum(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))])
    low, high = int(min(d.min(), dist.min())), int(max(d.max(), dist.max()))
    lines, starts = {}, {}
    for tier, (mine, theirs) in _classes(pp, nn, tiers).items():
        line = lines[tier] = _Line(theirs, dist, place, low, high)
        best, far = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
        for side in (True, False):
            first, end = starts[tier, side] = line.starts(side, mine, d)
            ok = np.flatnonzero(first < end)
            i = line.rows[side][first[ok]]
            gap = np.abs(dist[i] - d[ok])
            nearer = (gap < far[ok]) | ((gap == far[ok]) & (place[i] < place[best[ok]]))
            best[ok[nearer]], far[ok[nearer]] = i[nearer], gap[nearer]
        line.at.clear()
        found = (best >= 0) & (ideal_tier == 0) & (True if cap is None else far <= cap)
        ideal[found], ideal_tier[found] = best[found], tier

    used, dist_of, place_of = bytearray(len(nn)), memoryview(dist), memoryview(place)
    rows = {(t, s): memoryview(lines[t].rows[s]) for t in lines for s in (True, False)}
    skip = {(t, s): memoryview(lines[t].skip[s]) for t in lines for s in (True, False)}
    starts = {k: (memoryview(first), memoryview(end)) for k, (first, end) in starts.items()}

    def free(at: tuple[int, bool], q: int) -> int | None:
        own, nxt = rows[at], skip[at]
        i, end, path = starts[at][0][q], starts[at][1][q], []
        while i < end and used[own[i]]:
            path.append(i)
            i = max(i + 1, nxt[i])
        for j in path:
            nxt[j] = i
        return own[i] if i < end else None

    for q, (i, first) in enumerate(zip(ideal.tolist(), ideal_tier.tolist())):
        if not first:
            continue
        # below the tier of the ideal nothing is near enough, taken or not
        for tier in (t for t in lines if t >= first):
            if used[i]:
                found = [x for x in (free((tier, True), q), free((tier, False), q)) if x is not None]
                if not found:
                    continue
                best = min(found, key=lambda x: (abs(dist_of[x] - int(d[q])), place_of[x]))
                if cap is not None and abs(dist_of[best] - int(d[q])) > cap:
                    continue
            else:
                best = i
            used[best], real[q], tier_of[q] = 1, best, tier
            break
    return real, tier_of, ideal, ideal_tier


def tiered_matches(pos: DataFrame, neg: DataFrame, max_diff: float | None = None, force_cut: bool = False) -> DataFrame:
    """Greedy matching without replacement, positives by falling pip; unmatched positives stay with a null partner.

    ``neg_var_key_ideal`` ignores earlier picks. A candidate beyond ``max_diff`` sends the positive to the next tier.
    """
    p, n = with_group(pos), with_group(exclude_positives(neg, pos))
    n = cut_candidates(p, n, list(TIERS.values()), force_cut)
    p = p.select("tissue", "grp", "var_key", "gene_id", "ref", "alt", F.col("splice_dist").cast("long").alias("splice_dist"), "pip", "_k", F.col("pip").cast("double").alias("_pip"))
    n = n.select("tissue", "grp", "var_key", "gene_id", "ref", "alt", F.col("splice_dist").cast("long").alias("splice_dist"), "_k")

    def match(key: tuple[pa.Scalar, ...], pp: pa.Table, nn: pa.Table) -> pa.Table:
        pp = pp.take(pc.sort_indices(pp, [("pip", "descending"), ("_k", "ascending")])).combine_chunks()
        has_bin = str(key[1].as_py()).startswith("b")
        real, tier, ideal, ideal_tier = _greedy(pp, nn, [t for t in TIERS if t <= 2 or has_bin], max_diff)
        some = lambda x, missing: pa.array(x, mask=missing)
        picked, best = some(real, real < 0), some(ideal, ideal < 0)
        return pa.table({
            "tissue": pa.array([key[0].as_py()] * len(pp), pa.string()), "pos_var_key": pp.column("var_key"), "gene_id": pp.column("gene_id"), "neg_var_key": nn.column("var_key").take(picked),
            "neg_var_key_ideal": nn.column("var_key").take(best), "tier": some(tier, tier == 0), "ideal_tier": some(ideal_tier, ideal_tier == 0), "pos_pip": pp.column("_pip"),
            "pos_dist": pp.column("splice_dist"), "neg_dist": nn.column("splice_dist").take(picked),
        })

    return _fresh(p).groupBy("tissue", "grp").cogroup(_fresh(n).groupBy("tissue", "grp")).applyInArrow(match, PAIR_SCHEMA)


def optimal_matches(pos: DataFrame, neg: DataFrame, max_diff: float | None = None, force_cut: bool = False) -> DataFrame:
    """Most pairs first, then the least total |log10(d + 1)| difference, inside (tissue, bin); one row per variant."""
    nobin = lambda d: with_group(d).withColumn("grp", F.coalesce(F.col("bin").cast("string"), F.lit("-1")))
    p = nobin(best_rows(pos, ["tissue", "var_key"], "splice_dist"))
    n = nobin(best_rows(exclude_positives(neg, pos), ["tissue", "var_key"], "splice_dist"))
    n = cut_candidates(p, n, [("grp",)], force_cut)

    def match(key: tuple, pp: pd.DataFrame, nn: pd.DataFrame) -> pd.DataFrame:
        cols = ["tissue", "pos_var_key", "gene_id", "neg_var_key", "neg_var_key_ideal", "tier", "ideal_tier", "pos_pip", "pos_dist", "neg_dist"]
        pp = pp.sort_values(["splice_dist", "_k"]).reset_index(drop=True)
        nn = nn.sort_values(["splice_dist", "_k"]).reset_index(drop=True)
        pairs = line_assignment(pp["splice_dist"].to_numpy(float), nn["splice_dist"].to_numpy(float), max_diff)
        out = [
            (key[0], pp["var_key"][i], pp["gene_id"][i], nn["var_key"][j], nn["var_key"][j], OPTIMAL_TIER, OPTIMAL_TIER, pp["pip"][i], pp["splice_dist"][i], nn["splice_dist"][j])
            for i, j in pairs
        ]
        return pd.DataFrame(out, columns=cols)

    return _fresh(p).groupBy("tissue", "grp").cogroup(_fresh(n).groupBy("tissue", "grp")).applyInPandas(match, PAIR_SCHEMA)


#: Cells of the decision table that a line assignment keeps at once; longer lines are halved first.
CELLS = 1 << 22


def line_assignment(a: np.ndarray, b: np.ndarray, cap: float | None) -> list[tuple[int, int]]:
    """Assignment of two sorted lists: most pairs first, then the least total log difference.

    Without a cap, equal values are paired up first, and what is left falls into stretches that no pair has to leave. Where all pairs of
    that keep the cap, no capped assignment is better; else one table of the whole lists decides.
    """
    if len(a) == 0 or len(b) == 0:
        return []
    # equal values, by the triangle inequality no total gets worse: the first of the left list with the last of the right one, as the table does
    first, start = np.searchsorted(b, a, "left"), np.searchsorted(a, a, "left")
    there = np.searchsorted(b, a, "right") - first
    many, nth = np.minimum(np.searchsorted(a, a, "right") - start, there), np.arange(len(a)) - start
    equal = nth < many
    partner = (first + there - many + nth)[equal]
    pairs = list(zip(np.flatnonzero(equal).tolist(), partner.tolist()))
    left, right = np.flatnonzero(~equal), np.setdiff1d(np.arange(len(b)), partner)
    fewer = len(left) <= len(right)
    for some, rest in _stretches(a[left], b[right]) if fewer else _stretches(b[right], a[left]):
        own, other = (left[some], right[rest]) if fewer else (left[rest], right[some])
        pairs += [(int(own[x]), int(other[y])) for x, y in table_assignment(a[own], b[other], None)]
    if cap is not None and any(abs(a[i] - b[j]) > cap for i, j in pairs):
        return table_assignment(a, b, cap)
    return sorted(pairs)


def _stretches(a: np.ndarray, b: np.ndarray) -> list[tuple[slice, slice]]:
    """Stretches of two sorted lists (the first no longer than the second) between which no pair is needed.

    Going up, an item of ``a`` waits for the next free one of ``b``; beyond the place where nobody waits, none has to look. The same holds going
    down. A gap that nobody waits at in either direction parts two stretches.
    """
    if len(a) == 0:
        return []
    values = np.concatenate([a, b])
    order = np.lexsort((np.arange(len(values)) >= len(a), values))
    mine = order < len(a)
    step = np.where(mine, 1, -1)

    def waiting(step: np.ndarray) -> np.ndarray:
        total = np.cumsum(step)
        return total - np.minimum(np.minimum.accumulate(total), 0)

    joined = (waiting(step)[:-1] > 0) | (waiting(step[::-1])[::-1][1:] > 0)
    edges = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(values)]])
    seen = np.concatenate([[0], np.cumsum(mine)])[edges]
    rest = edges - seen
    some = np.flatnonzero(seen[1:] > seen[:-1])
    return [(slice(seen[k], seen[k + 1]), slice(rest[k], rest[k + 1])) for k in some.tolist()]


def table_assignment(a: np.ndarray, b: np.ndarray, cap: float | None) -> list[tuple[int, int]]:
    """Non-crossing assignment of two sorted lists: most pairs first, then the least total log difference.

    Dynamic programming with skips, a row of the table for each left item. Only small tables keep their decisions; a large one is solved
    from both ends up to the middle left item, split where the two halves meet best, and each half is solved alone. Memory follows the
    two lists, not their product; time is that of the table, about twice.
    """
    if len(a) == 0 or len(b) == 0:
        return []
    la, lb = np.log10(a + 1.0), np.log10(b + 1.0)
    reward = (max(la.max(), lb.max()) - min(la.min(), lb.min()) + 1.0) * (min(len(a), len(b)) + 1)
    # sums of rewards leave differences of 1e-9 visible
    kind = np.float64 if reward * min(len(a), len(b)) < 1e6 else np.longdouble

    def row(i: int, lo: int, hi: int) -> np.ndarray:
        cost = np.abs(la[i] - lb[lo:hi]).astype(kind) - kind(reward)
        return cost if cap is None else np.where(np.abs(a[i] - b[lo:hi]) > cap, kind(np.inf), cost)

    def totals(items, lo: int, hi: int, back: bool) -> np.ndarray:
        """Best total for every number of right items, counted from the left, or from the right."""
        best = np.zeros(hi - lo + 1, kind)
        for i in items:
            cost = row(i, lo, hi)
            best[1:] = np.minimum(best[1:], best[:-1] + (cost[::-1] if back else cost))
            np.minimum.accumulate(best, out=best)
        return best

    def table(first: int, last: int, lo: int, hi: int) -> list[tuple[int, int]]:
        prev = np.zeros(hi - lo + 1, kind)
        decide = np.zeros((last - first, hi - lo + 1), np.int8)  # 0 leave the left item, 1 pair up, 2 leave the right item
        for i in range(first, last):
            take = np.concatenate([[np.inf], prev[:-1] + row(i, lo, hi)])
            best = np.minimum(take, prev)
            run = np.minimum.accumulate(best)
            decide[i - first] = np.where(run < best, 2, np.where(take < prev, 1, 0))
            prev = run
        pairs, i, j = [], last - first - 1, hi - lo
        while i >= 0 and j > 0:
            step = decide[i, j]
            if step == 1:
                pairs.append((first + i, lo + j - 1))
            i, j = i - (step != 2), j - (step != 0)
        return pairs[::-1]

    pairs, open_parts = [], [(0, len(a), 0, len(b))]
    while open_parts:
        first, last, lo, hi = open_parts.pop()
        if last - first <= 1 or (last - first) * (hi - lo + 1) <= CELLS:
            pairs += table(first, last, lo, hi)
            continue
        middle = (first + last) // 2
        split = int(np.argmin(totals(range(first, middle), lo, hi, False) + totals(range(last - 1, middle - 1, -1), lo, hi, True)[::-1]))
        open_parts += [(first, middle, lo, lo + split), (middle, last, lo + split, hi)]
    return sorted(pairs)


def matched_only(pairs: DataFrame) -> DataFrame:
    return pairs.filter("neg_var_key IS NOT NULL")


def match_report(pairs: DataFrame) -> DataFrame:
    """Matched counts by tissue and tier."""
    m = F.col("neg_var_key").isNotNull()
    tiers = [F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (*TIERS, OPTIMAL_TIER)]
    return pairs.groupBy("tissue").agg(F.count("*").alias("n_pos"), F.count_if(m).alias("n_matched"), *tiers)


def match_quality(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often the actual partner is not the ideal one, and the distance differences (mean, exact median, shares)."""
    by = list(by)
    m = matched_only(pairs).select(*by, "neg_var_key", "neg_var_key_ideal", F.abs(F.col("pos_dist") - F.col("neg_dist")).alias("_d"))
    # the median takes several passes, none of which should match again
    m = written(m, "matched")
    d = F.col("_d")
    q = m.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("neg_var_key") != F.col("neg_var_key_ideal")).alias("n_not_ideal"),
        F.avg(d).alias("mean_diff"), F.avg((d <= 10).cast("int")).alias("share_10"), F.avg((d <= 500).cast("int")).alias("share_500"),
    )
    # the whole table has one row on either side
    one = F.lit(0).alias("_one")
    median = exact_percentiles(m.select(*(by or [one]), "_d"), by or ["_one"], "_d", {"median_diff": 0.5})
    return lookup(q if by else q.select("*", one), median, by or ["_one"], "left").drop("_one")
