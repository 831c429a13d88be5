"""Exact search of the highest inner products, in buckets of vectors of similar length.

Candidates stay in the partitions of their scan. A task sorts a batch of them by length and cuts buckets in which lengths differ by a
tenth at most. For a query with k scores so far, the k-th gives a local threshold for each bucket: the cosine that a vector of the
bucket has to reach. Above one, the bucket is passed over. From ``COORDINATES_FROM`` on, only vectors are looked at whose components
at the query's largest ones lie where that cosine is possible (sorted lists give them). Below, only vectors are looked at that are
long enough. Either way the products of what is left are computed exactly and compared with the threshold.

Queries come in waves of bounded size (``vectors.waves``), each one job that appends its k best of each task to a scratch table.

Defined cases: rows of null or unusable vectors take no part; a query meets vectors with as many components as its own, empty ones
score 0; equal scores go to the smaller id, a null id comes last; a repeated row is a query and a candidate of its own, and only the
row itself is left out; a query without candidates has no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.blocks import prepared
from splicelake.llm.vectors import NO_ID, Best, by_size, check_products, id_array, ids_of, integer_vectors, lengths_of, matrices, waves, without_own
from splicelake.session import scratch_dir

BUCKET_ROWS, QUERY_ROWS = 4096, 512
#: Shortest length in a bucket, as a share of the longest.
SAME_LENGTH = 0.9
#: Local thresholds from here on are narrow enough for coordinate lists (an angle of 26 degrees).
COORDINATES_FROM = 0.9
#: Components of a query that are looked up in the lists.
FOCUS = 4
SLACK = 1e-9


def buckets(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``lengths`` (falling) that hold BUCKET_ROWS at most and lengths of SAME_LENGTH of the first at least."""
    start = 0
    while start < len(lengths):
        near = int(np.searchsorted(-lengths, -SAME_LENGTH * lengths[start], "right"))
        end = min(max(near, start + 1), start + BUCKET_ROWS)
        yield start, end
        start = end


def first_of_equal(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of rows without those that have ``most`` equal vectors of smaller id ahead: they can't be among the best."""
    if x.shape[1] == 0:
        order, same = np.lexsort((ids,)), np.zeros(len(x), np.int64)
    else:
        _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_inverse=True)
        order = np.lexsort((ids, same))
    grouped = same[order]
    rank = np.arange(len(order)) - np.searchsorted(grouped, grouped)
    return order[rank < most]


class Bucket:
    """Vectors of similar length: components, lengths (falling), ids and row keys; sorted component lists once they are asked for."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.lengths, self.ids, self.rows = x, lengths, ids, rows
        self.unit = self.lists = None

    def products(self, q: np.ndarray, longest: float, prefix: int) -> np.ndarray:
        """Inner products with the first ``prefix`` vectors; partial sums are bounded by the lengths, so floats are exact below their precision."""
        most = longest * float(self.lengths[0])
        check_products(most)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        return (q.astype(kind) @ self.x[:prefix].astype(kind).T).astype(np.int64)

    def feasible(self, unit_query: np.ndarray, cosine: float) -> np.ndarray:
        """Places of vectors whose components allow that cosine at all the query's FOCUS largest components."""
        if self.lists is None:
            self.unit = self.x / np.maximum(self.lengths, 1e-300)[:, None]
            order = np.argsort(self.unit, axis=0)
            self.lists = order, np.take_along_axis(self.unit, order, axis=0)
        order, ordered = self.lists
        focus = np.argsort(-np.abs(unit_query))[:FOCUS]
        at, reach = np.arccos(np.clip(unit_query[focus], -1, 1)), np.arccos(min(cosine, 1.0))
        low, high = np.cos(np.minimum(at + reach, np.pi)) - SLACK, np.cos(np.maximum(at - reach, 0)) + SLACK
        bounds = [(np.searchsorted(ordered[:, f], a), np.searchsorted(ordered[:, f], b, "right")) for f, a, b in zip(focus, low, high)]
        narrow = min(range(len(focus)), key=lambda i: bounds[i][1] - bounds[i][0])
        places = order[bounds[narrow][0] : bounds[narrow][1], focus[narrow]]
        own = self.unit[places][:, focus]
        return places[((own >= low) & (own <= high)).all(axis=1)]


class Search:
    """Best candidates of the queries of one wave that have equally many components."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, k: int):
        self.x, self.rows, self.k = x, rows, k
        self.lengths = lengths_of(x)
        self.best = Best(len(x), k)

    def meet(self, bucket: Bucket) -> None:
        for start in range(0, len(self.x), QUERY_ROWS):
            group = np.arange(start, min(start + QUERY_ROWS, len(self.x)))
            least, reach = self.best.least[group], self.lengths[group] * bucket.lengths[0]
            bound = (least > 0) & (reach > 0)
            cosine = np.where(bound, least * (1 - SLACK) / np.where(bound, reach, 1), np.where((least > 0) & (reach == 0), 2.0, -1.0))
            alike = (cosine >= COORDINATES_FROM) & (cosine <= 1)
            for q in group[alike]:
                self._verify(q, bucket, bucket.feasible(self.x[q] / self.lengths[q], cosine[q - start]))
            self._by_length(group[cosine < COORDINATES_FROM], bucket)

    def _verify(self, q: int, bucket: Bucket, places: np.ndarray) -> None:
        places = places[bucket.rows[places] != self.rows[q]]
        check_products(self.lengths[q] * float(bucket.lengths[0]))
        score = bucket.x[places] @ self.x[q]
        good = score >= self.best.least[q]
        self.best.offer(np.full(int(good.sum()), q), score[good], bucket.ids[places[good]])

    def _by_length(self, group: np.ndarray, bucket: Bucket) -> None:
        if not len(group):
            return
        least = self.best.least[group]
        shortest = np.where(least > 0, least * (1 - SLACK) / np.maximum(self.lengths[group], 1e-300), 0.0)
        prefix = int(np.searchsorted(-bucket.lengths, -shortest.min(), "right"))
        if not prefix:
            return
        score = bucket.products(self.x[group], float(self.lengths[group].max()), prefix)
        without_own(score, self.rows[group], bucket.rows[:prefix])
        self.best.offer_rows(group, score, bucket.ids)


def top_products(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), id and score of the ``k`` highest integer inner products of each query row with all other rows."""
    if k < 1:
        raise ValueError("k starts at 1")
    rows = integer_vectors(df, F.col(vec_col), scale, id=F.col(id_col).cast("long"), query=F.coalesce(is_query, F.lit(False)))
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "found")
    schema = "query_row long, query_id long, id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for wave in waves(rows.where("query").select("row", "id", "size", "x")):

        def search(batches: Iterator[pa.RecordBatch], wave=wave) -> Iterator[pa.RecordBatch]:
            table = wave.value
            keys, names = table.column("row").to_numpy(), ids_of(table)
            parts = {size: (at, Search(x, keys[at], k)) for size, (at, x) in by_size(table).items()}
            for batch in batches:
                own_rows, own_ids = batch.column("row").to_numpy(), ids_of(batch)
                for at, x in matrices(batch):
                    if x.shape[1] not in parts:
                        continue
                    kept = first_of_equal(x, own_ids[at], k + 1)  # one more: the query itself may be among them
                    lengths = lengths_of(x[kept])
                    order = kept[np.argsort(-lengths, kind="stable")]
                    lengths = -np.sort(-lengths)
                    for a, b in buckets(lengths):
                        places = order[a:b]
                        parts[x.shape[1]][1].meet(Bucket(x[places], lengths[a:b], own_ids[at[places]], own_rows[at[places]]))
            for at, done in parts.values():
                slot, place = done.best.filled()
                yield pa.record_batch([pa.array(keys[at[slot]]), id_array(names[at[slot]]), id_array(done.best.id[slot, place]), pa.array(done.best.score[slot, place])], ["query_row", "query_id", "id", "score"])

        prepared(rows.select("row", "id", "size", "x")).mapInArrow(search, schema).write.mode("append").parquet(path)
        wave.unpersist()
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    found = spark.read.schema(schema).parquet(path).withColumn("rank", place)
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")
