"""Components against all pairs."""

import random

import pytest

from samples import ODD, prose
from splicelake.llm import nearcopies


def shingles(text, k):
    words = (text or "").translate({65 + i: 97 + i for i in range(26)}).replace(" ", " ")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, similarity=80):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(text, seed, n):
    own, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[own.randrange(len(words))] = f"e{seed}x{own.randrange(99)}"
    return " ".join(words)


@pytest.mark.parametrize("group", [2048, 5])
def test_components(make_docs, monkeypatch, group):
    monkeypatch.setattr(nearcopies, "GROUP", group)
    base = [prose(i, 150) for i in range(4)]
    rows = [(i, edited(base[i % 4], i, [0, 1, 3, 5, 6, 9][i % 6])) for i in range(70)]  # about 0.95 to 0.6 alike
    rows += [(100 + i, edited(base[0], 7, 6)) for i in range(3)] + [(200 + i, prose(50 + i, 2)) for i in range(3)] + [(300, base[1].upper()), (301, "one two"), (302, "ONE  two"), *ODD[:7]]
    out = nearcopies.near_copies(make_docs(rows), k=4).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows, 4)
    assert all(r.kept == (r.id == r.component_id) for r in out if r.id is not None)


def test_chains_are_joined(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in nearcopies.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in (100, 101, 102))


def test_empty_and_odd_tables(make_docs):
    assert nearcopies.near_copies(make_docs([])).count() == 0
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in nearcopies.near_copies(make_docs(ODD)).collect()), key=str)
    assert got == brute(ODD, 5)


def test_lower_similarities_are_refused(make_docs):
    with pytest.raises(ValueError, match="80 percent"):
        nearcopies.near_copies(make_docs([(1, "a b c")]), similarity=79)
