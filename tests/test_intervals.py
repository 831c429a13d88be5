import random

import pytest
from pyspark.sql import functions as F

from splicelake.operators import intervals as I


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(5)
    pts = [("c1" if r.random() < 0.8 else "c2", r.randrange(0, 3000)) for _ in range(400)]
    ivs = []
    for i in range(120):
        a = r.randrange(0, 3000)
        # a few intervals are far longer than the rest
        ivs.append((r.choice(["c1", "c2"]), a, a + (r.randrange(2000) if i % 15 == 0 else r.randrange(60)), f"g{i}"))
    p = spark.createDataFrame(pts, "region string, pos int")
    v = spark.createDataFrame(ivs, "region string, gstart int, gend int, gene_id string")
    return pts, ivs, p, v


@pytest.mark.parametrize("distinct", [True, False])
@pytest.mark.parametrize("width", [8, 64, 4096])
def test_range_join_equals_nested_loop(world, distinct, width):
    pts, ivs, p, v = world
    want = sorted((c, x, g) for c, x in pts for d, a, b, g in ivs if c == d and a <= x <= b)
    got = I.points_in_intervals(p, v, "pos", "gstart", "gend", ["region"], width, distinct)
    assert sorted((r.region, r.pos, r.gene_id) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_containing(world):
    pts, ivs, p, v = world
    got = {(r.region, r.pos): r.gene_id for r in I.first_containing(p, v, "pos", "gstart", "gend", ["region"], "gene_id", 64).collect()}
    for c, x in pts:
        hits = sorted((a, g) for d, a, b, g in ivs if c == d and a <= x <= b)
        assert got[(c, x)] == (hits[0][1] if hits else None)


@pytest.mark.parametrize("width", [50, 1 << 20])
def test_nearest(world, width):
    pts, ivs, p, v = world
    got = I.nearest_marks(p, v, "pos", "gstart", ["region"], width).collect()
    for r in got:
        s = [a for d, a, _, _ in ivs if d == r.region]
        assert r.mark_before == max((a for a in s if a <= r.pos), default=None)
        assert r.mark_after == min((a for a in s if a >= r.pos), default=None)


CASES = [
    # the longer one gives up the overlap
    ([(0, 100, "a"), (90, 120, "b")], [(0, 90, "a"), (90, 120, "b")]),
    ([(0, 30, "a"), (20, 120, "b")], [(0, 30, "a"), (30, 120, "b")]),
    # equally long: the first one does
    ([(0, 50, "a"), (40, 90, "b")], [(0, 40, "a"), (40, 90, "b")]),
    # inside another, or equal to it
    ([(0, 100, "a"), (10, 20, "b"), (0, 100, "c")], [(0, 100, "a")]),
    # touching is no overlap
    ([(0, 10, "a"), (10, 20, "b")], [(0, 10, "a"), (10, 20, "b")]),
    # a chain, where each cut decides the next
    ([(0, 100, "a"), (80, 110, "b"), (105, 300, "c")], [(0, 80, "a"), (80, 110, "b"), (110, 300, "c")]),
]


@pytest.mark.parametrize("given, want", CASES)
def test_overlap_resolution_by_hand(spark, given, want):
    d = spark.createDataFrame([("c1", "+", *r) for r in given], "region string, strand string, gstart int, gend int, gene_id string")
    assert sorted((x.gstart, x.gend, x.gene_id) for x in I.resolve_overlaps(d, ["region", "strand"]).collect()) == want


def test_overlap_resolution(spark):
    r = random.Random(9)
    ivs = [("c1", "+", a, a + r.randrange(5, 90), f"g{i:03d}") for i, a in enumerate(r.sample(range(2500), 90))]
    d = spark.createDataFrame(ivs, "region string, strand string, gstart int, gend int, gene_id string")
    given = {g: (a, b) for _, _, a, b, g in ivs}
    got = sorted((x.gstart, x.gend, x.gene_id) for x in I.resolve_overlaps(d, ["region", "strand"]).collect())
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert all(given[g][0] <= a < b <= given[g][1] for a, b, g in got)
    alone = {g for g, (a, b) in given.items() if not any(h != g and c < b and a < e for h, (c, e) in given.items())}
    assert all((a, b) == given[g] for a, b, g in got if g in alone) and alone <= {g for _, _, g in got}


def _one_list(rows):
    """The rule on whole lists: passes over all intervals of a group until nothing overlaps."""
    before, rows = None, sorted(rows)
    while rows != before:
        before, done = rows, []
        for x in sorted(rows, key=lambda x: x[0]):
            done = I._add_interval(done, x)
        rows = done
    return rows


@pytest.mark.parametrize("chunk_rows", [3, 40])
def test_overlap_resolution_in_chunks(spark, chunk_rows):
    r = random.Random(31)
    groups = {("c1", "+"): (2000, 150), ("c1", "-"): (400, 60), (None, "+"): (300, 20)}
    ivs = [(c, s, a, a + r.randrange(1, 120), f"g{i:03d}") for (c, s), (span, n) in groups.items() for i, a in enumerate(r.randrange(span) for _ in range(n))]
    # a chain that hands an interval on through many chunks, and one interval over all of it
    ivs += [("c2", "+", 10 * i, 10 * i + 15 + i % 3, f"h{i:03d}") for i in range(40)] + [("c3", "+", 0, 1000, "whole")] + [("c3", "+", 5 * i, 5 * i + 9, f"k{i:03d}") for i in range(30)]
    d = spark.createDataFrame(ivs, "region string, strand string, gstart int, gend int, gene_id string").repartition(3)
    got = sorted(((*x,) for x in I.resolve_overlaps(d, ["region", "strand"], chunk_rows=chunk_rows).collect()), key=str)
    want = [(*g, *x) for g in {v[:2] for v in ivs} for x in _one_list([v[2:] for v in ivs if v[:2] == g])]
    assert got == sorted(want, key=str)


def test_overlap_resolution_of_nothing(spark):
    d = spark.createDataFrame([], "region string, strand string, gstart int, gend int, gene_id string")
    assert I.resolve_overlaps(d, ["region", "strand"]).collect() == []


def test_touching_intervals_are_separate_islands(spark):
    d = spark.createDataFrame([("c", 1, 10, "a"), ("c", 10, 20, "b"), ("c", 15, 30, "d"), ("c", 16, 18, "e"), ("c", 40, 50, "f")], "region string, gstart int, gend int, gene_id string")
    for w in (8, 1 << 22):
        got = {r.gene_id: r.island for r in I.overlap_islands(d, ["region"], "gstart", "gend", w).collect()}
        assert got == {"a": 1, "b": 2, "d": 2, "e": 2, "f": 3}


def test_flanking_introns_nulls(spark):
    t = spark.createDataFrame([("c", "+", 100, 120), ("c", "+", 5, 8)], "region string, strand string, estart int, eend int")
    e = spark.createDataFrame([("c", "+", 50, 60), ("c", "+", 100, 110), ("c", "+", 150, 160)], "region string, strand string, estart int, eend int")
    got = {r.estart: r for r in I.flanking_introns(t, e, ["region", "strand"]).collect()}
    assert (got[100].up_intron, got[100].down_intron, got[100].min_intron, got[100].mean_intron) == (40, 30, 30, 35.0)
    assert (got[5].up_intron, got[5].down_intron, got[5].min_intron, got[5].mean_intron) == (None, 42, 42, None)
