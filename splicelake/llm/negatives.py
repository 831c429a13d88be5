"""Hard negatives: rows of another label that score nearly as high as an anchor's positives, by packed products.

Several candidates share one 64-bit word per component: their biased components stand in fields of their own, and one multiplication
by the anchor's component serves them all (Kronecker substitution). Sums of words are taken modulo 2 ** 64; the share of the bias is
known from the anchor alone, so what is left in each field is the exact score. A field needs one bit more than the largest score
that the lengths allow; where two fields don't fit, a word holds one.

Candidates stay in the partitions of their scan, anchors come in waves of bounded size (``vectors.waves``). One pass finds the
positives of each anchor, a second one the negatives below them. What a task returns is bounded by the anchors of the wave.

Defined cases: rows with a null label or an unusable vector take no part; an anchor meets vectors with as many components as its own;
equal scores go to the smaller id, a null id comes last; a repeated row is a row of its own; an anchor without positives, and a
positive without negatives in its band, have no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.blocks import prepared, stored
from splicelake.llm.vectors import NO_SCORE, Best, by_size, check_products, id_array, ids_of, integer_vectors, lengths_of, matrices, waves, without_own
from splicelake.session import scratch_dir

PACKED_ROWS, ANCHOR_ROWS = 6144, 256


class Packed:
    """Candidates in words: ``per`` fields of ``bits`` bits, made for anchors of length ``longest`` at most."""

    def __init__(self, x: np.ndarray, longest: float):
        most = longest * float(lengths_of(x).max(initial=0.0))
        check_products(most)
        self.n, size = x.shape
        self.bits = int(most).bit_length() + 2
        self.per = max(1, 64 // self.bits)
        self.bias = int(np.abs(x).max(initial=0))
        padded = np.zeros((-(-self.n // self.per) * self.per, size), np.int64)
        padded[: self.n] = x
        fields = (padded + self.bias).astype(np.uint64).reshape(len(padded) // self.per, self.per, size)
        self.words = np.zeros((len(fields), size), np.uint64)
        for f in range(self.per):
            self.words += fields[:, f] << np.uint64(f * self.bits)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products of the anchors with all candidates."""
        total = anchors.astype(np.uint64) @ self.words.T
        ones = sum(1 << f * self.bits for f in range(self.per))  # a one in each field
        shares = anchors.sum(axis=1).astype(np.uint64) * np.uint64(self.bias * ones % (1 << 64))
        total -= shares[:, None]
        if self.per == 1:
            return total.view(np.int64)[:, : self.n]
        half, mask = 1 << self.bits - 1, np.uint64((1 << self.bits) - 1)
        total += np.uint64(half * ones)  # fields are positive now, none borrows from the next
        out = np.empty((*total.shape, self.per), np.int64)
        for f in range(self.per):
            out[:, :, f] = ((total >> np.uint64(f * self.bits)) & mask).astype(np.int64) - half
        return out.reshape(len(anchors), len(self.words) * self.per)[:, : self.n]


def _groups(batches: Iterator[pa.RecordBatch], anchors: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """Scores of each group of anchors (their places in the wave) with each lot of candidates (ids, labels, row keys)."""
    longest = {size: float(lengths_of(x).max(initial=0.0)) for size, (_, x) in anchors.items()}
    for batch in batches:
        ids, labels, rows = ids_of(batch), batch.column("label").to_numpy(), batch.column("row").to_numpy()
        for at, x in matrices(batch):
            if x.shape[1] not in anchors:
                continue
            places, own = anchors[x.shape[1]]
            for a in range(0, len(at), PACKED_ROWS):
                some = at[a : a + PACKED_ROWS]
                packed = Packed(x[a : a + PACKED_ROWS], longest[x.shape[1]])
                for b in range(0, len(places), ANCHOR_ROWS):
                    yield places[b : b + ANCHOR_ROWS], packed.scores(own[b : b + ANCHOR_ROWS]), ids[some], labels[some], rows[some]


def _positives(wave, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wave.value
        keys, own = table.column("row").to_numpy(), table.column("label").to_numpy()
        best = Best(len(keys), k)
        for slots, score, ids, labels, rows in _groups(batches, by_size(table)):
            score[own[slots][:, None] != labels[None, :]] = NO_SCORE
            without_own(score, keys[slots], rows)
            best.offer_rows(slots, score, ids)
        slot, place = best.filled()
        yield pa.record_batch([pa.array(keys[slot]), id_array(best.id[slot, place]), pa.array(best.score[slot, place])], ["anchor_row", "id", "score"])

    return search


def _negatives(wave, k: int, n: int, low: int, high: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wave.value
        keys, own, positives = table.column("row").to_numpy(), table.column("label").to_numpy(), table.column("positives").to_pylist()
        floor, ceiling = np.zeros((len(keys), k), np.int64), np.full((len(keys), k), -1, np.int64)  # an empty band where there is no positive
        for i, scores in enumerate(positives):
            p = np.array(scores, np.int64)
            floor[i, : len(p)], ceiling[i, : len(p)] = -(-low * p // 100), high * p // 100
        best = Best(len(keys) * k, n)
        for slots, score, ids, labels, _ in _groups(batches, by_size(table)):
            bands = slots[:, None] * k + np.arange(k)
            lowest, highest = np.maximum(floor[slots], best.least[bands]), ceiling[slots]
            real = lowest <= highest
            bottom = np.where(real, lowest, np.iinfo(np.int64).max).min(axis=1)
            top = np.where(real, highest, NO_SCORE).max(axis=1)
            a, c = np.nonzero((score >= bottom[:, None]) & (score <= top[:, None]) & (own[slots][:, None] != labels[None, :]))
            order = np.lexsort((ids[c], -score[a, c], a))
            a, c = a[order], c[order]
            found = score[a, c]
            edge = np.searchsorted(a, np.arange(len(slots) + 1))
            at, band = [], []
            for i in np.flatnonzero(np.diff(edge)):
                first = edge[i] + np.searchsorted(-found[edge[i] : edge[i + 1]], -highest[i])  # of each band the first row not above it
                place = first[:, None] + np.arange(n)
                good = (place < edge[i + 1]) & real[i][:, None]
                good[good] = found[place[good]] >= np.broadcast_to(lowest[i][:, None], good.shape)[good]
                at.append(place[good])
                band.append(np.broadcast_to(bands[i][:, None], good.shape)[good])
            if at:
                at, band = np.concatenate(at), np.concatenate(band)
                best.offer(band, found[at], ids[c[at]])
        band, place = best.filled()
        yield pa.record_batch([pa.array(keys[band // k]), pa.array((band % k + 1).astype(np.int32)), id_array(best.id[band, place]), pa.array(best.score[band, place])], ["anchor_row", "place", "id", "score"])

    return search


def _ranked(spark, path: str, schema: str, by: list[str], name: str, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return spark.read.schema(schema).parquet(path).withColumn(name, place).where(F.col(name) <= most)


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Of each anchor the first ``positives`` other rows of its label; of each of those the first ``negatives`` rows of another label whose
    score is ``low`` to ``high`` percent of the positive's. Labels are whole numbers.
    """
    if min(positives, negatives) < 1 or not 0 <= low <= high:
        raise ValueError("counts start at 1, and low is at most high")
    labelled = label.cast("long")
    rows = integer_vectors(df.where(labelled.isNotNull()), F.col(vec_col), scale, id=F.col(id_col).cast("long"), label=labelled, anchor=F.coalesce(is_anchor, F.lit(False)))
    spark = df.sparkSession
    narrow = prepared(rows.select("row", "id", "label", "size", "x"))
    anchors = rows.where("anchor").select("row", "id", "label", "size", "x")

    def passes(queries: DataFrame, task, schema: str, name: str, other_bytes: int) -> str:
        path = scratch_dir(spark, name)
        spark.createDataFrame([], schema).write.parquet(path)
        for wave in waves(queries, other_bytes):
            narrow.mapInArrow(task(wave), schema).write.mode("append").parquet(path)
            wave.unpersist()
        return path

    schema = "anchor_row long, id long, score long"
    path = passes(anchors, lambda wave: _positives(wave, positives), schema, "positives", 64)
    near = stored(_ranked(spark, path, schema, ["anchor_row"], "place", positives).select("anchor_row", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "near")
    lists = near.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # ``positives`` entries at most
    banded = stored(anchors.join(lists, "row").withColumn("positives", F.col("p.positive_score")).drop("p"), "anchors")
    schema = "anchor_row long, place int, id long, score long"
    path = passes(banded, lambda wave: _negatives(wave, positives, negatives, low, high), schema, "negatives", 64 + 16 * positives)
    found = _ranked(spark, path, schema, ["anchor_row", "place"], "rank", negatives).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    names = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    out = found.join(near, ["anchor_row", "place"]).join(names, "anchor_row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
