"""Whitening of embeddings by shifted CholeskyQR over the rows' distinct integer vectors.

A pass over the centred vectors gives a Gram matrix, whose Cholesky factor turns the rows towards an orthonormal basis by a triangular
solve. The first Gram matrix is shifted, so that its factor exists and is well-conditioned whatever the data (Fukaya et al., 2020);
two more passes remove what the shift left. The product of the factors is R of a QR decomposition of the centred vectors, and the
singular values and right vectors of R are those of the vectors. Nothing but d * (d + 1) / 2 sums and d * d factors leaves the tasks.

Defined cases: rows of null or unusable vectors take no part, nor do rows with fewer components than the longest vector; repeated
vectors count once in the fit, every row gets its values; a component without variance (of rank beyond the vectors', or all vectors
equal) has a null ``whitened``, and counts for nothing in ``identity_error``; ``explained`` is null where nothing varies; an empty table
gives no rows; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.llm.blocks import broadcast_bounded, prepared, stored
from splicelake.llm.vectors import id_array, ids_of, integer_vectors, matrices

PASSES = 3
UNIT_ROUNDOFF = 2.0**-53
#: A singular value below this share of the largest is no variance but rounding.
RANK_SHARE = 1e-10
OUT = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def solved(y: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """y times the inverse of an upper triangular matrix, by forward substitution along the columns."""
    out = np.empty_like(y)
    for j in range(y.shape[1]):
        out[:, j] = (y[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def gram(fit: DataFrame, size: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of outer products of ``rows_of`` (the components as longs), summed in tasks first and then by Spark."""
    i, j = np.triu_indices(size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((size, size)), False
        for batch in batches:
            for _, x in matrices(batch):
                y = rows_of(x)
                total += y.T @ y
                any_rows = True
        if any_rows:
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    sums = prepared(fit).mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    out[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    return np.triu(out) + np.triu(out, 1).T


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of each component."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in matrices(batch):
                yield pa.record_batch([pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, len(x)), pa.int64()), pa.array(x.sum(axis=0))], ["i", "n", "v"])

    found = prepared(fit).mapInArrow(partial, "i int, n long, v long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    total = {r.i: int(r.v) for r in found}
    return (found[0].n if found else 0), [total[i] for i in range(size)] if found else []


def triangle(fit: DataFrame, size: int, n: int, centre: np.ndarray) -> np.ndarray:
    """R of the centred vectors: the product of the factors of PASSES Gram passes."""
    spark, factors, r = fit.sparkSession, [], np.eye(size)
    for step in range(PASSES):
        sent = broadcast_bounded(spark, (centre, list(factors)))

        def rows_of(x: np.ndarray, sent=sent) -> np.ndarray:
            middle, done = sent.value
            y = x - middle
            for factor in done:
                y = solved(y, factor)
            return y

        g = gram(fit, size, rows_of)
        shift = 11 * (n * size + size * (size + 1)) * UNIT_ROUNDOFF * max(float(np.trace(g)), np.finfo(float).tiny)
        factors.append(_cholesky(g, shift, step == 0))
        r = factors[-1] @ r
    return r


def _cholesky(g: np.ndarray, shift: float, shifted: bool) -> np.ndarray:
    """Upper factor; the shift comes in where it is asked for, or where vectors without full rank need it."""
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(g + shift * np.eye(len(g))).T


def whitened(df: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """A row per row and component: id, component, n, deviation (exact), whitened, explained, identity_error.

    The fit list holds each distinct integer vector once: ``n`` vectors with sums S. deviation is the sum over dimensions of
    (n * x - S) ** 2; whitened is x - S / n along the component's unit vector, over its standard deviation; explained is the
    component's share of all variance; identity_error is the largest entry of the whitened fit list's covariance minus the identity.
    """
    if components < 1:
        raise ValueError("components start at 1")
    spark = df.sparkSession
    rows = integer_vectors(df, F.col(vec_col), scale, id=F.col(id_col).cast("long"))
    size = rows.agg(F.max("size")).first()[0]
    if not size:
        return spark.createDataFrame([], OUT)
    rows = rows.where(F.col("size") == size)
    fit = stored(rows.select("size", "x").distinct(), "fit")
    n, total = sums(fit, size)
    centre = np.array([s / n for s in total])
    _, sigma, axes = np.linalg.svd(triangle(fit, size, n, centre))
    kept = min(components, size)
    real = (sigma > sigma[0] * RANK_SHARE)[:kept] & (sigma[0] > 0)
    spread = sigma[:kept] / np.sqrt(n)
    projection = np.where(real, axes[:kept].T / np.where(real, spread, 1), np.nan)
    power = sigma**2
    explained = [float(p / power.sum()) if power.sum() > 0 else None for p in power[:kept]]
    sent = broadcast_bounded(spark, (centre, projection, np.array(total, object)))

    def white(x: np.ndarray) -> np.ndarray:
        middle, along, _ = sent.value
        return (x - middle) @ along[:, real]

    count = int(real.sum())
    error = float(np.abs(gram(fit, count, white) / n - np.eye(count)).max()) if count else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, along, s = sent.value
        for batch in batches:
            ids = ids_of(batch)
            for at, x in matrices(batch):
                y = (x - middle) @ along
                # sums of x * x and of x * S; whole numbers of any size where 62 bits don't do
                small = float(np.abs(x).max(initial=0)) * max(1.0, float(sum(abs(v) for v in s)), float(np.abs(x).max(initial=0)) * size) < 1 << 62
                own = x if small else x.astype(object)
                squares, crossed = (own * own).sum(axis=1), own @ (s.astype(np.int64) if small else s)
                number = pa.decimal128(38, 0)
                as_decimal = (lambda v: pa.array(v, pa.int64()).cast(number)) if small else (lambda v: pa.array([Decimal(int(e)) for e in v], number))
                k = np.tile(np.arange(kept), len(x))
                yield pa.record_batch(
                    [id_array(np.repeat(ids[at], kept)), pa.array((k + 1).astype(np.int32)), as_decimal(np.repeat(squares, kept)), as_decimal(np.repeat(crossed, kept)), pa.array(y.ravel(), from_pandas=True)],
                    ["id", "component", "squares", "crossed", "whitened"],
                )

    long = prepared(rows).mapInArrow(project, "id long, component int, squares decimal(38,0), crossed decimal(38,0), whitened double")
    number = lambda v: F.lit(Decimal(v)).cast("decimal(38,0)")
    deviation = number(n * n) * F.col("squares") - number(2 * n) * F.col("crossed") + number(sum(v * v for v in total))
    share = F.element_at(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("component"))
    return long.select(
        "id", "component", F.lit(n).cast("long").alias("n"), deviation.cast("decimal(38,0)").alias("deviation"), "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
