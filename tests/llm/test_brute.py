"""Whole results of operators without SQL against plain Python, and the pipeline on tables that are empty or hold very long texts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from samples import ODD, prose
from splicelake.llm import rules, shards
from splicelake.llm.curve import hilbert_index
from test_rules import brute


def verdict(text):
    """kept, from the rules as stated: base counts, the ratio of the whole text, the share of chunks outside their limits."""
    data = (text or "").encode()
    n_words, _, _, _, again = brute(text)
    press = zstandard.ZstdCompressor(level=rules.LEVEL, write_content_size=False, write_checksum=False)

    def inside(part):
        bounds = [(lo, hi) for at, lo, hi in rules.BANDS if len(part) >= at]
        lo, hi = bounds[-1] if bounds else (0.0, float("inf"))
        return lo <= (len(press.compress(part)) / len(part) if part else 1.0) <= hi

    chunks = [data[i : i + rules.CHUNK] for i in range(0, len(data), rules.CHUNK)] if len(data) > rules.CHUNK else []
    bad = sum(not inside(c) for c in chunks) / len(chunks) if chunks else 0.0
    return n_words >= 50 and 100 * again <= 50 * n_words and inside(data) and bad < rules.BAD_CHUNKS


def test_kept_is_the_stated_verdict(make_docs):
    noise = lambda seed, n: "".join(chr(33 + x % 90) + (" " if x % 7 == 0 else "") for x in np.random.default_rng(seed).integers(0, 1 << 30, n))
    rows = [(100 + i, prose(i, 20 + 40 * i)) for i in range(30)] + [(200 + i, noise(i, 300 * (i + 1))) for i in range(12)] + [(300 + i, prose(i, 300) + (" " + prose(50 + i, 30 + i)) * (5 * i)) for i in range(12)]
    rows += [(400 + i, (prose(i, 60) + "\n") * i + prose(i, 3000)) for i in range(8)] + ODD
    got = rules.judged(make_docs(rows)).collect()
    assert Counter((r.id, r.kept) for r in got) == Counter((i, verdict(t)) for i, t in rows)
    assert 20 < sum(r.kept for r in got) < len(rows) - 20


def test_shards_are_runs_of_the_curve(spark):
    own = np.random.default_rng(8)
    rows = [(i, None if i % 29 == 0 else "y" * int(own.integers(0, 400)), [None, "de", "en", "fr"][own.integers(0, 4)], f"s{own.integers(0, 9)}") for i in range(700)]
    rows += [(1000 + i, "same text", "en", "s1") for i in range(150)]
    got = shards.sharded(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()

    def buckets(values):
        n, out, before = Counter(values), {}, 0
        for v in sorted(n, key=lambda v: (v is not None, v)):
            out[v] = before * (1 << shards.BITS) // len(values)
            before += n[v]
        return [out[v] for v in values]

    size = [len((t or "").encode()) + 1 for _, t, _, _ in rows]
    cells = np.array([buckets([r[2] for r in rows]), buckets([r[3] for r in rows]), buckets([int(np.floor(np.log2(1 + s) * 4)) for s in size])]).T
    curve = hilbert_index(cells, shards.BITS)
    keys = [(int(c), zlib.crc32((t or "").encode())) for c, (_, t, _, _) in zip(curve, rows)]
    assert {r.id: (r.curve, r.text_crc32) for r in got} == {i: k for (i, *_), k in zip(rows, keys)}
    n, want, places = len(rows), defaultdict(Counter), Counter()
    for at, k in enumerate(sorted(keys)):  # rows with one key follow one another in any order
        shard = at * 8 // n
        want[k][shard, places[shard]] += 1
        places[shard] += 1
    have = defaultdict(Counter)
    for r in got:
        have[r.curve, r.text_crc32][r.shard, r.slot] += 1
    assert have == want


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, docs, labels, benchmark):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_pipeline_without_documents(spark, tmp_path):
    assert written(spark, tmp_path, [], [(1, 1, 0)], [(1, "a b c")]).count() == 0


def test_pipeline_without_labels_and_items(spark, tmp_path):
    docs = [(i, prose(i, 60), "en", "s", 1) for i in range(12)] + [(20, prose(3, 60), "en", "s", 1), (None, None, None, None, None)]
    assert {r.doc_id for r in written(spark, tmp_path, docs, [], []).select("doc_id").collect()} == {*range(12), None}


def test_pipeline_with_very_long_texts(spark, tmp_path):
    item, long = prose(77, 40), [prose(500 + i, 60_000) for i in range(3)]
    docs = [(1, long[0], "en", "s", 1), (2, long[0] + " more", "en", "s", 1), (3, long[1] + " " + item, "en", "s", 1), (4, long[2] + " joe@mail.example " + prose(9, 50), "en", "s", 1), (5, prose(1, 60) + " " + item, "en", "s", 1)]
    out = written(spark, tmp_path, docs, [(i, 1, 0) for i in range(1, 6)], [(1, item)]).collect()
    tokens = defaultdict(int)
    for r in out:
        tokens[r.doc_id] += r.length
    # 2 is a copy of 1, 5 is a benchmark passage for the most part, 3 holds it in a thousandth of its words
    assert set(tokens) == {1, 3, 4} and all(n > 60_000 for n in tokens.values())
