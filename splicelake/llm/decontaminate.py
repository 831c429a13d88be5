"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns every batch of documents into one stored segment: the words of the segment and, for each, the positions at
which it stands. Positions run through all documents of the segment with ``GAP`` between two documents, so no window spans two.
``matches`` takes the benchmark in bounded blocks. In every segment a window is looked up by its rarest word there; each place of
that word proposes a start, and the lists of the other words, shifted by their offset in the window, are intersected with the
proposals from the rarest to the most frequent. ``slop`` makes proximity matches: some start from which each word of the window stands
at most so many places off its own place. All starts that the rarest word allows are tried, so it doesn't matter which word that is; one
place may serve equal words. A word that is left out altogether is no proximity match.

A segment is worked on where it lies, so no posting is shuffled. Each block of the benchmark is a job of its own that adds its matches to
a stored table: with the benchmark grows the number of passes, not the plan, and one block at a time is held.

Null or empty texts have no words and match nothing. Repeated rows each get a row of their own. Rows of the benchmark with a null
id mark words as hit and are not listed. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from splicelake.llm.blocks import ALNUM, Block, Words, broadcast_bounded, covered, lists, pieces, prepared, ranges, row_keys, runs, stored
from splicelake.session import scratch_dir

WINDOW = 13
MAX_SLOP = 8
GAP = WINDOW + 2 * MAX_SLOP + 2
#: Bytes of benchmark texts of one pass, and proposals that are intersected at once.
BLOCK_BYTES = 8 << 20
PROPOSALS = 1 << 20


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per segment: segment, ids and word counts of its documents, words, number of places of each, gaps between places."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_words", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("n_places", T.BinaryType()), T.StructField("places", T.BinaryType()),
    ])
    arrow_id = to_arrow_type(id_type)

    def segments(batches):
        keys = row_keys()
        for batch in pieces(batches):
            words = Words(Block(batch.column("text")), ALNUM, lower=True)
            place = np.arange(len(words.ids)) + GAP * words.text
            order = np.argsort(words.ids, kind="stable")
            counts = np.bincount(words.ids, minlength=len(words.dictionary))
            step = np.diff(place[order], prepend=0).astype("<i4")
            yield pa.record_batch({
                "segment": pa.array([next(keys)], pa.int64()), "ids": pa.array([batch.column("id").to_pylist()], pa.list_(arrow_id)), "n_words": pa.array([words.counts.astype(np.int32)], pa.list_(pa.int32())),
                "words": pa.array([words.dictionary.to_pylist()], pa.list_(pa.binary())), "n_places": pa.array([counts.astype("<i4").tobytes()], pa.binary()), "places": pa.array([step.tobytes()], pa.binary()),
            })

    return prepared(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(segments, schema)


@dataclass
class Windows:
    """Distinct windows of some items. words: all words; grid: for each window its words' numbers, -1 after the last; items of each window."""

    words: pa.Array
    grid: np.ndarray
    items: list
    first: np.ndarray
    owners: np.ndarray


def windows_of(rows: list[tuple], window: int = WINDOW) -> Windows:
    words = Words(Block(pa.array([t for _, t in rows], pa.string())), ALNUM, lower=True)
    starts, owners = [], []
    for i, (a, n) in enumerate(zip(words.first, words.counts)):
        own = np.arange(a, a + max(1, n - window + 1)) if n else np.zeros(0, np.int64)
        starts.append(own)
        owners.append(np.full(len(own), i))
    starts, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, owners))
    grid = np.full((len(starts), window), -1, np.int64)
    for k in range(window):
        inside = starts + k < words.first[owners + 1]
        grid[inside, k] = words.ids[starts[inside] + k]
    grid, which = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
    order = np.argsort(which.ravel(), kind="stable")
    first = np.searchsorted(which.ravel()[order], np.arange(len(grid) + 1))
    return Windows(words.dictionary, grid, [x for x, _ in rows], first, owners[order])


def found(block: Windows, words: pa.Array, n_places: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all matches in a segment, with slop for each possible start. places: sorted within each word."""
    if not len(block.grid) or not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = pc.index_in(block.words.cast(pa.binary()), value_set=words.cast(pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    used, length = block.grid >= 0, (block.grid >= 0).sum(axis=1)
    grid = np.where(used, own[block.grid], -1)
    alive = np.flatnonzero(((grid >= 0) == used).all(axis=1))  # each word occurs in the segment
    grid, length = grid[alive], length[alive]
    rank = np.argsort(np.where(grid >= 0, n_places[grid], np.iinfo(np.int64).max), axis=1, kind="stable")
    first = np.concatenate([[0], np.cumsum(n_places)])
    span = int(places.max(initial=0)) + 2 * GAP
    keys = np.repeat(np.arange(len(n_places)), n_places) * span + places  # sorted: word by word, place by place
    rare = grid[np.arange(len(grid)), rank[:, 0]]
    off = np.arange(-slop, slop + 1)
    total = np.cumsum(n_places[rare]) * len(off)
    out_w, out_s = [], []
    lo = 0
    while lo < len(grid):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PROPOSALS, "right")))
        count = n_places[rare[lo:hi]]
        w = np.repeat(np.arange(lo, hi), count)
        s = ((places[ranges(first[rare[lo:hi]], count)] - rank[w, 0])[:, None] + off).ravel()
        w = np.repeat(w, len(off))
        for k in range(1, grid.shape[1]):
            more = length[w] > k
            if not more.any():
                break
            at = rank[w, k]
            word, want = grid[w, at], s + at
            low = np.searchsorted(keys, word * span + np.maximum(want - slop, 0))
            hit = (low < len(keys)) & (want + slop >= 0)
            hit[hit] = keys[low[hit]] <= (word * span + want + slop)[hit]
            keep = hit | ~more
            w, s = w[keep], s[keep]
        out_w.append(alive[w])
        out_s.append(s)
        lo = hi
    return np.concatenate(out_w or [np.zeros(0, np.int64)]), np.concatenate(out_s or [np.zeros(0, np.int64)])


def matches(index: DataFrame, bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """segment, ordinal, spans of hit words (exact), items with exact and with proximity matches; rows only for documents with any."""
    if not 0 <= slop <= MAX_SLOP or not 0 < window <= WINDOW:
        raise ValueError(f"slop must be 0 to {MAX_SLOP}, window 1 to {WINDOW}")
    spark = index.sparkSession
    bench = bench.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.length("text") > 0).distinct()
    item_type = bench.schema["item"].dataType
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("ordinal", T.IntegerType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(item_type)), T.StructField("near", T.ArrayType(item_type)),
    ])
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_BYTES)
    path = scratch_dir(spark, "matches")
    for i in range(n_blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == i).collect()  # about BLOCK_BYTES
        shared = broadcast_bounded(spark, windows_of([tuple(r) for r in rows], window))
        hits = index.select("segment", "n_words", "words", "n_places", "places").mapInArrow(_probe(shared, slop, item_type), schema)
        hits.write.mode("append").option("compression", "zstd").parquet(path)
        shared.unpersist()
    return spark.read.schema(schema).parquet(path) if n_blocks else spark.createDataFrame([], schema)


def _probe(shared, slop: int, item_type: T.DataType):
    arrow_item = to_arrow_type(item_type)

    def items_of(block: Windows, w: np.ndarray, ordinal: np.ndarray, n: int) -> pa.Array:
        if not len(w):
            return pa.array([[] for _ in range(n)], pa.list_(arrow_item))
        w, ordinal = np.unique(np.stack([w, ordinal]), axis=1)
        count = block.first[w + 1] - block.first[w]
        pairs = np.unique(np.stack([np.repeat(ordinal, count), block.owners[ranges(block.first[w], count)]]), axis=1)
        rows = [[] for _ in range(n)]
        for o, x in pairs.T.tolist():
            if block.items[x] is not None:
                rows[o].append(block.items[x])
        return pa.array([list(dict.fromkeys(x)) for x in rows], pa.list_(arrow_item))

    def probe(batches):
        block = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                n_words = batch.column("n_words")[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                n_places = np.frombuffer(batch.column("n_places")[row].as_py(), "<i4").astype(np.int64)
                places = np.cumsum(np.frombuffer(batch.column("places")[row].as_py(), "<i4"), dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(n_words)])[:-1] + GAP * np.arange(len(n_words))
                w, s = found(block, batch.column("words")[row].values, n_places, places, slop)
                if not len(w):
                    continue
                # an occurrence belongs to the document of the window's first rarest word; with slop its start may lie before it
                text = np.clip(np.searchsorted(first - MAX_SLOP, s, "right") - 1, 0, len(first) - 1)
                exact_w, exact_s, exact_text = w, s, text
                if slop:
                    w0, s0 = found(block, batch.column("words")[row].values, n_places, places, 0)
                    exact_w, exact_s, exact_text = w0, s0, np.searchsorted(first, s0, "right") - 1
                texts, which = np.unique(text, return_inverse=True)
                hit = covered(exact_s, (block.grid[exact_w] >= 0).sum(axis=1), int(first[-1] + n_words[-1]) + 1) if len(exact_s) else np.zeros(1, bool)
                step = np.diff(hit.astype(np.int8), prepend=0, append=0)
                a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                owner = np.searchsorted(first, a, "right") - 1
                cut = np.searchsorted(owner, np.concatenate([texts, [len(first)]]))
                spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(a - first[owner], pa.int32()), pa.array(b - first[owner], pa.int32())], ["a", "b"]))
                yield pa.record_batch({
                    "segment": pa.array(np.full(len(texts), batch.column("segment")[row].as_py()), pa.int64()), "ordinal": pa.array(texts, pa.int32()), "spans": spans,
                    "items": items_of(block, exact_w, np.searchsorted(texts, exact_text), len(texts)), "near": items_of(block, w, which.ravel(), len(texts)),
                })

    return probe


def report(index: DataFrame, found_rows: DataFrame) -> DataFrame:
    """Per document: id, n_words, n_hit, items, near_items. Spans of several passes are merged."""
    texts = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ordinal", "x")).select("segment", "ordinal", F.col("x.ids").alias("id"), F.col("x.n_words").cast("long").alias("n_words"))
    per_text = found_rows.groupBy("segment", "ordinal").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near_items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate("spans", start, lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, s.end))).alias("n"), F.greatest(s.end, x.b).alias("end")), lambda s: s.n)
    none = F.array().cast(found_rows.schema["items"].dataType)
    return texts.join(per_text.withColumn("n_hit", n_hit), ["segment", "ordinal"], "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
    )


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", slop: int = 2) -> DataFrame:
    """Index, match and judge: a document is contaminated when at least a twentieth of its words is hit."""
    index = stored(build_index(docs, id_col, text_col), "postings")
    out = report(index, matches(index, bench, slop=slop))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
