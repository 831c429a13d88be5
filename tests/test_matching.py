import itertools
import math
import random
from hashlib import md5

import numpy as np
import pytest

from splicelake.operators import matching as M
from splicelake.operators import strata as T
from splicelake.session import written

COLS = "tissue string, var_key string, gene_id string, ref string, alt string, splice_dist long, bin int"


def _world(seed, n_pos=14, n_neg=40, span=30):
    r = random.Random(seed)
    genes = {f"g{i}": (None if i % 4 == 0 else i % 2) for i in range(6)}
    row = lambda k: ("t" + str(r.randrange(2)), k, g := r.choice(list(genes)), r.choice("AC"), r.choice("GT"), r.randrange(span), genes[g])
    pos = [(*row(f"p{i}"), round(r.random(), 2)) for i in range(n_pos)]
    neg = [row(f"n{i}") for i in range(n_neg)]
    return pos, neg


def _stored(spark, rows, schema):
    # a stored table has a known small size, so the plans stay short
    return written(spark.createDataFrame(rows, schema), "match")


def _h(k):
    return md5(k.encode()).hexdigest()


def _greedy(pos, neg, cap):
    used, out = set(), {}
    for t, k, g, ref, alt, d, b, pip in sorted(pos, key=lambda p: (-p[7], _h(p[1]))):
        for tier in (1, 2, 3, 4):
            c = [n for n in neg if n[0] == t and n[1] not in used and ((n[2] == g) if tier < 3 else (b is not None and n[6] == b)) and (tier % 2 == 0 or (n[3], n[4]) == (ref, alt))]
            if c:
                best = min(c, key=lambda n: (abs(n[5] - d), _h(n[1])))
                if cap is None or abs(best[5] - d) <= cap:
                    used.add(best[1])
                    out[(t, k)] = (best[1], tier)
                    break
    return out


@pytest.mark.parametrize("seed,cap,cut", [(1, None, False), (2, 4, False), (5, 2, True)])
def test_tiered_equals_sequential_greedy(spark, seed, cap, cut):
    pos, neg = _world(seed)
    p, n = _stored(spark, pos, COLS + ", pip double"), _stored(spark, neg, COLS)
    got = M.tiered_matches(p, n, cap, force_cut=cut).collect()
    assert {(r.tissue, r.pos_var_key): (r.neg_var_key, r.tier) for r in got if r.neg_var_key} == _greedy(pos, neg, cap)
    partners = [(r.tissue, r.neg_var_key) for r in got if r.neg_var_key]
    assert len(partners) == len(set(partners))


def _best(a, b, cap):
    cost = lambda x, y: abs(math.log10(x + 1) - math.log10(y + 1))
    best = (0, 0.0)
    small, big, flip = (a, b, False) if len(a) <= len(b) else (b, a, True)
    for perm in itertools.permutations(range(len(big)), len(small)):
        pairs = [(x, big[j]) for x, j in zip(small, perm) if cap is None or abs(x - big[j]) <= cap]
        best = min(best, (-len(pairs), sum(cost(x, y) for x, y in pairs)))
    return -best[0], best[1]


@pytest.mark.parametrize("cap", [None, 3, 10])
def test_line_assignment_is_optimal(cap):
    r = random.Random(7)
    for _ in range(60):
        a, b = sorted(r.randrange(30) for _ in range(r.randrange(1, 5))), sorted(r.randrange(30) for _ in range(r.randrange(1, 6)))
        import numpy as np

        pairs = M.line_assignment(np.array(a, float), np.array(b, float), cap)
        n, c = _best(a, b, cap)
        assert len(pairs) == n and len({j for _, j in pairs}) == n
        assert sum(abs(math.log10(a[i] + 1) - math.log10(b[j] + 1)) for i, j in pairs) == pytest.approx(c)


@pytest.mark.parametrize("cut", [False, True])
def test_optimal_matches_are_one_to_one(spark, cut):
    pos, neg = _world(11, 20, 60)
    p, n = _stored(spark, pos, COLS + ", pip double"), _stored(spark, neg, COLS)
    got = M.optimal_matches(p, n, None, force_cut=cut).collect()
    assert len({(r.tissue, r.neg_var_key) for r in got}) == len(got) == len({(r.tissue, r.pos_var_key) for r in got})
    total = sum(abs(math.log10(r.pos_dist + 1) - math.log10(r.neg_dist + 1)) for r in got)
    other = M.optimal_matches(p, n, None, force_cut=not cut).collect()
    assert len(other) == len(got)
    assert sum(abs(math.log10(r.pos_dist + 1) - math.log10(r.neg_dist + 1)) for r in other) == pytest.approx(total)


def test_cut_drops_rows_but_keeps_reach(spark):
    pos = [("t", "p1", "g1", "A", "G", 500, 1, 0.9)]
    neg = [("t", f"n{i}", "g1", "A", "G", i, 1) for i in range(1000)]
    p, n = (M.with_group(d) for d in (_stored(spark, pos, COLS + ", pip double"), _stored(spark, neg, COLS)))
    kept = {r.splice_dist for r in M.cut_candidates(p, n, [("grp",), ("gene_id",)], True).collect()}
    # one positive: its own distance is a nearest candidate on both sides, nothing else can be reached
    assert kept == {500}


@pytest.mark.parametrize("cap", [None, 30])
def test_halved_tables_match_as_well_as_whole_ones(monkeypatch, cap):
    g = np.random.default_rng(4)
    for _ in range(20):
        a, b = np.sort(g.integers(0, 300, g.integers(1, 40))).astype(float), np.sort(g.integers(0, 300, g.integers(1, 60))).astype(float)
        totals = []
        for cells in (1 << 22, 8):
            monkeypatch.setattr(M, "CELLS", cells)
            pairs = M.line_assignment(a, b, cap)
            i, j = [p[0] for p in pairs], [p[1] for p in pairs]
            assert len(set(i)) == len(i) and len(set(j)) == len(j) and (cap is None or all(abs(a[x] - b[y]) <= cap for x, y in pairs))
            totals.append((len(pairs), round(float(np.abs(np.log10(a[i] + 1) - np.log10(b[j] + 1)).sum()), 9)))
        assert totals[0] == totals[1]


def test_long_lines_keep_little_memory():
    import tracemalloc

    g = np.random.default_rng(5)
    a, b = np.sort(g.integers(0, 10**6, 3000)).astype(float), np.sort(g.integers(0, 10**6, 9000)).astype(float)
    tracemalloc.start()
    pairs = M.line_assignment(a, b, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == 3000 and peak < 20e6  # the table has 27 million cells


def test_report_and_scheme_comparison(spark):
    cols = "tissue string, pos_var_key string, gene_id string, neg_var_key string, neg_var_key_ideal string, tier int, ideal_tier int, pos_pip double, pos_dist long, neg_dist long"
    rows = [("t", f"p{i}", "g", f"n{i}" if k else None, f"n{i}" if k else None, k or None, k or None, 0.9, 1, 1 if k else None) for i, k in enumerate([1, 1, 2, 3, 4, 99, 0, 0])] + [("u", "p9", "g", None, None, None, None, 0.9, 1, None)]
    got = {r.tissue: r.asDict() for r in M.match_report(spark.createDataFrame(rows, cols)).collect()}
    assert got["t"] == {"tissue": "t", "n_pos": 8, "n_matched": 6, "tier_1": 2, "tier_2": 1, "tier_3": 1, "tier_4": 1, "tier_99": 1}
    assert (got["u"]["n_pos"], got["u"]["n_matched"], got["u"]["tier_1"]) == (1, 0, 0)
    area = lambda values: spark.createDataFrame(values, "head string, median_pr_area double")
    both = {r.head: (r.first_area, r.second_area, round(r.delta, 12)) for r in T.scheme_comparison(area([("a", 0.5), ("b", 0.7), ("c", 0.1)]), area([("a", 0.6), ("b", 0.4)])).collect()}
    assert both == {"a": (0.5, 0.6, 0.1), "b": (0.7, 0.4, -0.3)}
