"""Removed bytes against a count of all strings."""

import hashlib
import random

import numpy as np
import pytest
from samples import ODD
from splicelake.llm import repeats


def brute(rows, length):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def corpus(seed, n=40):
    own = random.Random(seed)
    letters = lambda k: "".join(own.choice("abé") for _ in range(k))
    shared = [letters(k) for k in (20, 30, 70, 200)]
    rows = [(i, "".join(own.choice(shared) if own.random() < 0.5 else letters(own.randint(0, 60)) for _ in range(own.randint(0, 7)))) for i in range(n)]
    rows += [(n + i, rows[own.randrange(n)][1]) for i in range(5)] + [(90, "a" * 300), (91, "ab" * 90 + "c" + "ab" * 20), (92, shared[3][:24]), (93, shared[3][1:26])]
    return rows


@pytest.mark.parametrize("group", [4096, 1])
def test_all_copies_go(make_docs, group):
    rows = corpus(1) + ODD[:9]
    assert got(repeats.without_repeats(make_docs(rows), length=24, gram=9, group=group)) == brute(rows, 24)


def test_long_texts_are_sliced(make_docs, monkeypatch):
    data = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint8)
    whole = repeats.stretches(data, np.array([0, 5001]), 24, 9, repeats.Powers())
    assert (np.diff(whole[1]) > 0).all() and (whole[2] >= whole[1]).all() and int((whole[2] - whole[1] + 1).sum()) == 5000 - 24 + 1


def test_the_first_copy_can_stay(make_docs):
    rows = [(3, "x" + "0123456789" * 3), (1, "0123456789" * 3 + "y"), (2, "unique text of some length, really"), (5, "unique text of some length, really"), (7, None)]
    out = {r.id: (r.n_removed, bytes(r.kept).decode()) for r in repeats.without_repeats(make_docs(rows, 1), length=24, gram=9, keep="first").collect()}
    assert out[2][0] == 0 and out[5][0] == 34 and out[7] == (0, "")
    assert sorted([out[3][1], out[1][1]], key=len)[0] in ("x", "y")  # one of the two loses what they share


def test_suffix_runs_are_sorted_and_exact():
    own = random.Random(4)
    data = np.frombuffer("".join(own.choice("ab") for _ in range(300)).encode(), np.uint8)
    starts = np.arange(300 - 20)
    order, first = repeats.suffix_runs(data, starts, 20)
    strings = [data[s : s + 20].tobytes() for s in order]
    assert strings == sorted(strings)
    assert first.tolist() == [i for i in range(len(order)) if i == 0 or strings[i] != strings[i - 1]]


def test_production_length(make_docs):
    own = random.Random(8)
    text = lambda n: "".join(own.choice("abcdefgh ") for _ in range(n))
    shared = [text(399), text(400), text(401), text(2500)]
    rows = [(i, text(own.randint(0, 900)) + shared[i % 4] + text(own.randint(0, 300))) for i in range(16)]
    assert got(repeats.without_repeats(make_docs(rows))) == brute(rows, 400)


def test_empty_table(make_docs):
    assert repeats.without_repeats(make_docs([])).count() == 0
