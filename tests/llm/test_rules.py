"""Base counts against plain Python, and the bands."""

import base64
import random
import re

import numpy as np
import zstandard
from samples import ODD, prose
from splicelake.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words, places = WORD.findall(text), {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k : k + 3]), []).append(k)
    again = {k + j for own in places.values() if len(own) > 1 for k in own for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_counts(make_docs):
    own = random.Random(2)
    rows = [(i, "".join(own.choice(["a", "bb", "é#", "$"]) + own.choice([" ", "\n", "\n\n", "\t", "\x0b", " "]) for _ in range(own.randint(1, 90)))) for i in range(120)] + ODD
    got = sorted(((r.id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed) for r in rules.judged(make_docs(rows)).collect()), key=str)
    want = [(i, c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, c in ((i, brute(t)) for i, t in rows)]
    assert got == sorted(want, key=str)


def test_bands_reject_repeats_and_noise(make_docs):
    noise = base64.encodebytes(np.random.default_rng(1).bytes(5000)).decode()
    repeats = "\n".join(f"{i} {prose(7, 120)}" for i in range(40))  # no window of three words stands twice in a line, but lines do
    rows = [(1, prose(3, 400)), (2, noise), (3, repeats), (4, prose(4, 4000)), (5, prose(5, 900) + (" " + prose(6, 40)) * 60)]
    kept = {r.id: r.kept for r in rules.judged(make_docs(rows)).collect()}
    assert kept[1] and kept[4] and not kept[2] and not kept[3] and not kept[5]


def test_ratio_is_that_of_the_library(make_docs):
    text = prose(9, 2000)
    row = rules.judged(make_docs([(1, text)])).first()
    press = zstandard.ZstdCompressor(level=rules.LEVEL, write_content_size=False, write_checksum=False)
    assert row.ratio == len(press.compress(text.encode())) / len(text.encode())


def test_limits_change_with_length():
    lo, hi = rules.limits(np.array([0, 127, 128, 511, 512, 10**6]))
    assert lo.tolist() == [0, 0, 0.30, 0.30, 0.28, 0.20] and hi[0] == np.inf and hi[-1] == 0.70


def test_empty_table(make_docs):
    assert rules.judged(make_docs([])).count() == 0
