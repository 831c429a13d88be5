"""Vectors as whole numbers: the shared ground of the operators on embeddings.

A vector's component x becomes floor(scale * x). Rows with a null vector, a null component or one that is not finite take no part;
an empty vector is a vector without components. Scaled components have to fit into 32 bits, else a ValueError says so.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.llm.blocks import broadcast_bounded, prepared, row_keys, runs, stored

#: Bytes of the query vectors that one job broadcasts.
WAVE_BYTES = 16 << 20
#: A chunk is the smallest unit of a wave: the rows of a partition whose keys agree but for so many bits.
CHUNK_BITS = 12
NO_SCORE = np.iinfo(np.int64).min
#: Stands for a null id inside tasks; it orders after all others.
NO_ID = np.iinfo(np.int64).max


def integer_vectors(df: DataFrame, vec: Column, scale: int, **columns: Column) -> DataFrame:
    """Rows with a vector: ``row`` (unique key), ``columns`` (longs and flags), ``size`` and ``x`` (little-endian 32 bits a component)."""
    narrow = df.select(vec.cast("array<double>").alias("vec"), *[c.alias(k) for k, c in columns.items()])
    others = [f for f in narrow.schema.fields if f.name != "vec"]
    schema = ", ".join(["row long", "size int", "x binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in others]])

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = row_keys()
        for batch in batches:
            vecs = batch.column("vec")
            lengths = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(vecs.flatten(), np.nan).to_numpy(zero_copy_only=False)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            ends = np.cumsum(lengths)
            good = (wrong[ends] == wrong[ends - lengths]) & pc.is_valid(vecs).to_numpy(zero_copy_only=False)
            own = values[np.repeat(good, lengths)]
            x = np.floor(scale * own)
            if len(x) and np.abs(x).max() >= 1 << 31:
                raise ValueError("scaled components have to fit into 32 bits")
            sizes = lengths[good]
            offsets = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(x.astype("<i4"))])
            kept = batch.filter(pa.array(good))
            row = np.fromiter((next(keys) for _ in range(len(sizes))), np.int64, len(sizes))
            yield pa.record_batch([pa.array(row), pa.array(sizes, pa.int32()), packed, *[kept.column(f.name) for f in others]], ["row", "size", "x", *[f.name for f in others]])

    return stored(prepared(narrow).mapInArrow(quantise, schema), "vectors")


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of components in a batch: places of its rows, and their components as a matrix of longs."""
    sizes = batch.column("size").to_numpy(zero_copy_only=False)
    x = batch.column("x")
    _, offsets, data = x.buffers()
    off = np.frombuffer(offsets, np.int32)[x.offset : x.offset + len(x) + 1]
    flat = np.frombuffer(data, "<i4")[off[0] // 4 : off[-1] // 4] if data is not None else np.zeros(0, "<i4")
    first = (off[:-1] - off[0]) // 4
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[first[at][:, None] + np.arange(size)].astype(np.int64)


def ids_of(rows: pa.RecordBatch | pa.Table, name: str = "id") -> np.ndarray:
    return np.asarray(pc.fill_null(rows.column(name), NO_ID))


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def lengths_of(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, rounded up by far more than an ulp: products of two are upper bounds of inner products."""
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)


def check_products(most: float) -> None:
    if most >= 1 << 55:
        raise ValueError("inner products have to fit into 55 bits")


def waves(queries: DataFrame, other_bytes: int = 64) -> Iterator[Broadcast]:
    """The rows of ``queries`` (row, size, x and about ``other_bytes`` more) as broadcast Arrow tables of at most WAVE_BYTES, or of one chunk of 2 ** CHUNK_BITS rows.

    Row keys are numbered inside partitions, so a chunk of keys can't hold more. The driver sees a row per chunk and one
    wave at a time.
    """
    spark = queries.sparkSession
    found = queries.groupBy(F.shiftright("row", CHUNK_BITS).alias("chunk")).agg(F.sum(F.col("size") * 4 + other_bytes).alias("bytes")).orderBy("chunk").toLocalIterator()
    group, total = [], 0

    def ship(chunks: Sequence[int]) -> Broadcast:
        own = queries.where(F.col("row").between(chunks[0] << CHUNK_BITS, ((chunks[-1] + 1) << CHUNK_BITS) - 1))
        return broadcast_bounded(spark, own.toArrow())

    for number, size in found:
        if group and total + size > WAVE_BYTES:
            yield ship(group)
            group, total = [], 0
        group.append(number)
        total += size
    if group:
        yield ship(group)


class Best:
    """The first ``k`` offers of each slot: higher scores first, ties by smaller id. ``extra`` values ride along."""

    def __init__(self, slots: int, k: int, extra: int = 0):
        self.k = k
        self.score = np.full((slots, k), NO_SCORE)
        self.id = np.full((slots, k), NO_ID)
        self.extra = [np.zeros((slots, k), np.int64) for _ in range(extra)]

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, *extra: np.ndarray) -> None:
        if not len(slot):
            return
        touched, place = np.unique(slot, return_inverse=True)
        slots = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        columns = [np.concatenate([old[touched].ravel(), new]) for old, new in zip([self.score, self.id, *self.extra], [score, ids, *extra])]
        order = np.lexsort((columns[1], ~columns[0], slots))
        start, length = runs(slots[order])
        rank = np.arange(len(order)) - np.repeat(start, length)
        first = order[rank < self.k]  # every touched slot has k old places at least
        for into, values in zip([self.score, self.id, *self.extra], columns):
            into[touched] = values[first].reshape(len(touched), self.k)

    def offer_rows(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offers a row of scores to each slot; NO_SCORE is none. Only what can be among the best is sorted."""
        n, least = score.shape[1], self.least[slots]
        if n > self.k:
            least = np.maximum(least, np.partition(score, n - self.k, axis=1)[:, n - self.k])
        q, c = np.nonzero((score >= least[:, None]) & (score > NO_SCORE))
        self.offer(slots[q], score[q, c], ids[c])

    def filled(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.score > NO_SCORE)

    @property
    def least(self) -> np.ndarray:
        """Score that an offer has to reach to be of use."""
        return self.score[:, -1]


def without_own(score: np.ndarray, rows: np.ndarray, others: np.ndarray) -> None:
    """Takes out the scores of a row with itself: row keys of the lines and of the columns."""
    order = np.argsort(others)
    own = order[np.minimum(np.searchsorted(others, rows, sorter=order), len(others) - 1)]
    same = np.flatnonzero(others[own] == rows)
    score[same, own[same]] = NO_SCORE


def by_size(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and components of the queries of a wave, by number of components."""
    parts: dict[int, list] = {}
    start = 0
    for batch in table.to_batches():
        for at, x in matrices(batch):
            parts.setdefault(x.shape[1], []).append((at + start, x))
        start += batch.num_rows
    return {size: (np.concatenate([a for a, _ in p]), np.concatenate([x for _, x in p])) for size, p in parts.items()}
