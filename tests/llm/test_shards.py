"""Shards: sizes, slots and how well they prune."""

import zlib
from collections import defaultdict

from samples import ODD, prose
from splicelake.llm import shards


def test_shards_are_even_and_gapless(make_docs):
    rows = [(i, prose(i % 7, 3 + i % 50)) for i in range(101)] + ODD
    got = shards.sharded(make_docs(rows)).collect()
    assert sorted(((r.id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_cover_small_boxes(spark):
    rows = [(i, "x" * (4 ** (i % 4)), f"l{i // 4 % 4}", f"s{i // 16 % 8}") for i in range(2048)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = shards.sharded(docs).join(docs, shards.F.col("id") == docs["doc_id"]).collect()
    seen = defaultdict(set)
    for r in got:
        seen[r.shard].add((r.lang, r.source))
    assert sum(map(len, seen.values())) / 8 <= 16  # of 32 pairs; an order by any one column has 32, 8 or 32


def test_one_and_no_row(make_docs):
    assert shards.sharded(make_docs([])).count() == 0
    assert [(r.shard, r.slot) for r in shards.sharded(make_docs([(1, None)])).collect()] == [(0, 0)]
