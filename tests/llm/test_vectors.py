"""Operators on embeddings against brute force, the odd rows included."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splicelake.llm import negatives, topsearch, vectors, whitening

EXTRA = ("id", "row", "x", "size", "query", "label_", "score", "rank", "place", "anchor", "n")


@pytest.fixture(scope="module")
def make(spark):
    fields = [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in EXTRA])

    def frame(rows, partitions=3):
        return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], l, *("x" for _ in EXTRA)) for i, v, l in rows], schema).repartition(partitions)

    return frame


def whole(rows):
    """(place, id, label, vector of whole numbers) of the rows that take part."""
    return [(r, i, l, [math.floor(256 * float(np.float32(c))) for c in v]) for r, (i, v, l) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def order(hits):
    return sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] or 0))


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k):
    out = []
    for r, i, _, x in whole(rows):
        if i is not None and i % 5 == 0:
            hits = order([(dot(x, y), j) for s, j, _, y in whole(rows) if s != r and len(x) == len(y)])[:k]
            out += [(i, n + 1, j, score) for n, (score, j) in enumerate(hits)]
    return sorted(out, key=repr)


def brute_negatives(rows):
    out, used = [], [w for w in whole(rows) if w[2] is not None]
    for r, i, l, x in used:
        if i is None or i % 5:
            continue
        others = [(dot(x, y), j, m) for s, j, m, y in used if s != r and len(x) == len(y)]
        for p, j, _ in order([h for h in others if h[2] == l])[:5]:
            band = order([h for h in others if h[2] != l and 50 * p <= 100 * h[0] <= 95 * p])[:3]
            out += [(i, j, n + 1, h[1], p, h[0]) for n, h in enumerate(band)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cloud(seed, n, size, spread=1.0, scale=1.0):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, size))
    v = centres[g.integers(0, 6, n)] + spread * g.normal(size=(n, size))
    return scale * v * np.exp(g.normal(size=(n, 1)) / 2) / np.linalg.norm(v, axis=1)[:, None]


def labelled(v, seed=0):
    g = np.random.default_rng(seed)
    return [(int(i), list(x), int(g.integers(0, 3))) for i, x in enumerate(v)]


ODD = [
    (5, None, 1), (10, [0.1, None], 1), (15, [0.1, math.nan], 1), (20, [math.inf, 0.2], 2), (25, [], 1), (30, [], 2), (35, [0.5], 1), (40, [0.5, -0.5], 1), (40, [0.5, -0.5], 1), (45, [0.5, -0.5], None),
    (None, [0.5, 0.4], 1), (None, [0.5, 0.4], 2), (50, [0.0, 0.0], 1), (51, [0.5, -0.4], 2), (52, [-0.5, 0.5], 2), (53, [0.5, -0.4], 2), (55, [0.1, 0.7, 0.2], 3), (60, [0.49, -0.45], 1),
]
CASES = {
    "spread": labelled(cloud(1, 300, 16)), "tight": labelled(cloud(2, 300, 8, 0.05)), "large": labelled(cloud(3, 120, 5, 0.5, 3e4)), "one": labelled(cloud(4, 1, 4)),
    "copies": labelled(np.repeat(cloud(5, 12, 6, 0.3), 25, axis=0)), "odd": ODD, "coarse": labelled(np.round(cloud(6, 200, 3) * 2) / 2),
}
ROUNDS = [(c, False) for c in CASES] + [(c, True) for c in ("tight", "copies", "odd")]


@pytest.mark.parametrize("name, small", ROUNDS)
def test_top_products(make, monkeypatch, name, small):
    if small:  # many waves; buckets and groups that end inside the data
        monkeypatch.setattr(vectors, "WAVE_BYTES", 700)
        monkeypatch.setattr(vectors, "CHUNK_BITS", 3)
    rows = CASES[name]
    assert got(topsearch.top_products(make(rows), F.col("vec_id") % 5 == 0, 4)) == brute_top(rows, 4)


@pytest.mark.parametrize("name", ["spread", "tight", "copies", "coarse"])
def test_small_buckets(monkeypatch, name):
    """Many buckets and groups, coordinate lists from low thresholds on: the same best scores."""
    monkeypatch.setattr(topsearch, "BUCKET_ROWS", 20)
    monkeypatch.setattr(topsearch, "QUERY_ROWS", 7)
    monkeypatch.setattr(topsearch, "COORDINATES_FROM", 0.3)
    calls = []
    feasible = topsearch.Bucket.feasible
    monkeypatch.setattr(topsearch.Bucket, "feasible", lambda self, q, c: calls.append(1) or feasible(self, q, c))
    x = np.array([w[3] for w in whole(CASES[name])])
    keys = np.arange(len(x))
    search = topsearch.Search(x, keys, 3)
    lengths = vectors.lengths_of(x)
    by_length = np.argsort(-lengths, kind="stable")
    for a, b in topsearch.buckets(lengths[by_length]):
        places = by_length[a:b]
        search.meet(topsearch.Bucket(x[places], lengths[places], keys[places], keys[places]))
    score = x @ x.T
    np.fill_diagonal(score, vectors.NO_SCORE)
    want = np.array([np.lexsort((keys, ~s))[:3] for s in score])
    assert (search.best.id == want).all() and (search.best.score == np.take_along_axis(score, want, 1)).all()
    assert calls


@pytest.mark.parametrize("name, small", ROUNDS)
def test_hard_negatives(make, monkeypatch, name, small):
    if small:
        monkeypatch.setattr(vectors, "WAVE_BYTES", 900)
        monkeypatch.setattr(vectors, "CHUNK_BITS", 4)
    rows = CASES[name]
    assert got(negatives.hard_negatives(make(rows), F.col("vec_id") % 5 == 0, F.col("label"))) == brute_negatives(rows)


@pytest.mark.parametrize("high, fields", [(2, 8), (140, 3), (20_000, 1), (1 << 23, 1), (0, 32)])
def test_packed_products(high, fields):
    g = np.random.default_rng(high)
    x, a = g.integers(-high, high + 1, (101, 9)), g.integers(-high, high + 1, (7, 9))
    packed = negatives.Packed(x, float(vectors.lengths_of(a).max()))
    assert (packed.scores(a) == a @ x.T).all()
    assert packed.per >= min(fields, 3) if high < 1000 else packed.per == fields


def test_no_rows(make):
    for rows in ([], [(5, None, 1)]):
        assert got(topsearch.top_products(make(rows), F.col("vec_id") % 5 == 0)) == []
        assert got(negatives.hard_negatives(make(rows), F.col("vec_id") % 5 == 0, F.col("label"))) == []
        assert got(whitening.whitened(make(rows))) == []


def test_too_large_components_are_refused(make):
    with pytest.raises(Exception, match="32 bits"):
        topsearch.top_products(make([(5, [1e30], 1)]), F.col("vec_id") % 5 == 0).collect()


def check_whitening(make, rows, components=4):
    used = whole(rows)
    size = max(len(w[3]) for w in used)
    used = [w for w in used if len(w[3]) == size]
    fit = np.unique(np.array([w[3] for w in used], object).astype(np.int64), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    y = fit - total / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    real = [v > values[0] * 1e-12 and v > 0 for v in values]
    out = whitening.whitened(make(rows), components).collect()
    assert len(out) == len(used) * min(components, size)
    left = {}
    for r in out:
        left.setdefault((r.id, r.deviation), {}).setdefault(r.component, []).append(r)
    scores = np.full((len(used), min(components, size)), np.nan)
    for at, (_, i, _, x) in enumerate(used):
        own = left[i, sum((n * c - int(s)) ** 2 for c, s in zip(x, total))]
        for c in range(min(components, size)):
            r = own[c + 1].pop()
            assert r.n == n
            if values[0] > 0:
                assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-6, abs=1e-12)
            else:
                assert r.explained is None
            assert r.identity_error is None if not real[0] else r.identity_error < 1e-6
            scores[at, c] = np.nan if r.whitened is None else r.whitened
    for c in range(min(components, size)):
        if not real[c]:
            assert np.isnan(scores[:, c]).all()
            continue
        want = (np.array([w[3] for w in used]) - total / n) @ axes[:, c] / np.sqrt(values[c])
        sign = np.sign(want @ scores[:, c])
        assert np.abs(want * sign - scores[:, c]).max() < 1e-7


@pytest.mark.parametrize("name", ["spread", "tight", "large", "copies", "one"])
def test_whitening(make, name):
    check_whitening(make, CASES[name])


def test_whitening_of_odd_rows(make):
    g = np.random.default_rng(9)
    rows = [r for r in ODD if r[1] is None or len(r[1]) < 3] + [(100 + i, list(v), 1) for i, v in enumerate(g.normal(size=(9, 3)) * [1, 2, 4])]
    check_whitening(make, rows)


def test_whitening_without_full_rank(make):
    """A constant component, a repeated one, fewer vectors than components."""
    v = cloud(7, 60, 4)
    check_whitening(make, labelled(np.column_stack([v, np.ones(60), v[:, 0]])), 6)
    check_whitening(make, labelled(cloud(8, 3, 10)), 5)


def test_whitening_keeps_sums_of_any_size(make):
    rows = labelled(np.round(cloud(10, 40, 3, 1.0, 2e6)))
    check_whitening(make, rows)
