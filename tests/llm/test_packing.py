"""Pieces against the tokenizer's own ids; the curve."""

import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
from samples import ODD, prose
from splicelake.llm import packing
from splicelake.llm.curve import hilbert_index, positions
from tokenizers import Tokenizer


def test_each_id_lies_in_one_piece(make_docs):
    own = random.Random(6)
    parts = ["It's", "we'll ", "don't,", "'s", " ", "\n\n", " ", "é,", "É!", "é", "<", "̸", "ß;", "×", "3", "42.", "-a", "a-", ",'s", "İ", "<|endoftext|>", "word", "Mixed", "|", "漢字", "…"]
    rows = [(i, "".join(own.choice(parts) for _ in range(own.randint(1, 60)))) for i in range(150)] + [(200 + i, prose(i, 3000)) for i in range(4)] + ODD
    own_ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(tuple(own_ids.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in rows)
    pieces = packing.packed(make_docs(rows)).collect()
    by_sequence = {}
    for p in pieces:
        ids = np.frombuffer(p.tokens, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.tokens) == p.ids_crc32
        by_sequence.setdefault(p.sequence_id, []).append(p)
    stream = []
    for s in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            stream.append(p)
        assert at == 4096 or s == max(by_sequence)
    documents, now = [], []
    for p in stream:  # pieces of a document follow one another
        assert p.start == len(now)
        now += np.frombuffer(p.tokens, "<u4").tolist()
        if len(now) == p.doc_tokens:
            documents.append(tuple(now))
            now = []
    assert not now and sorted(documents) == want


def test_neighbours_on_the_curve_touch():
    for d, bits in ((2, 4), (3, 3), (4, 2), (1, 5)):
        cells = np.array(list(product(range(1 << bits), repeat=d)))
        index = hilbert_index(cells, bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_positions_are_running_sums(spark):
    own = random.Random(1)
    rows = [(own.randint(0, 20), i, own.randint(0, 9)) for i in range(500)] + [(None, 500, 3)]
    got = positions(spark.createDataFrame(rows, "a int, b int, w long"), ["a", "b"], "w", "positions").collect()
    at = 0
    for r in sorted(got, key=lambda r: (-1 if r.a is None else r.a, r.b)):
        assert r.before == at
        at += r.w


def test_empty_table(make_docs):
    assert packing.packed(make_docs([])).count() == 0
