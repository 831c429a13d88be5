"""Hilbert curve indices of whole batches (the transpose form of Skilling, 2004), and exact positions along an order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.blocks import prepared, stored


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """cells: rows of coordinates below 2 ** bits; bits times columns is 62 at most. Neighbours on the curve are neighbours in space."""
    x = [c.astype(np.int64) for c in cells.T]
    if bits * len(x) > 62:
        raise ValueError("the index has 62 bits at most")
    for b in reversed(range(1, bits)):
        low = (1 << b) - 1
        for i in range(len(x)):
            on = (x[i] >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap  # for i = 0 both are the same array: nothing is swapped then
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[-1])
    for b in reversed(range(1, bits)):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    index = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for c in x:
            index = index << 1 | (c ^ turn) >> b & 1
    return index


def positions(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over all rows ahead in ``order``. Rows equal in ``order`` follow one another somehow.

    Rows are range-partitioned, summed up inside their partition and stored with its number; the totals of the partitions, one
    number each, give the rest. ``order`` should tell rows apart, else equal rows share a partition.
    """
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, part long, inside long"

    def number(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            inside = total + np.cumsum(w) - w
            total += int(w.sum())
            yield batch.append_column("part", pa.array(np.full(len(w), part), pa.int64())).append_column("inside", pa.array(inside, pa.int64()))

    rows = stored(prepared(df).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, schema), name)
    totals = rows.groupBy("part").agg(F.sum(weight).alias("total"))  # as many rows as partitions
    ahead = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("ahead"))
    return rows.join(ahead, "part").withColumn("before", F.col("inside") + F.col("ahead")).drop("part", "inside", "ahead")
