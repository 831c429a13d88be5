"""Shards along a Hilbert curve through several metadata columns.

Each column is cut into buckets of about equally many rows, in the order of its values; the bucket numbers are the coordinates.
Rows are sorted by their index on the curve, equal texts of one cell next to one another (with other metadata they lie in other
cells), and the order is cut into runs of equal length: a shard covers a small box in every column, so the smallest and largest values kept for a file exclude it from most searches.

Null values form the lowest bucket. Null texts count as no bytes. Repeated rows keep a place each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splicelake.llm.blocks import prepared, stored
from splicelake.llm.curve import hilbert_index, positions

BITS = 5


def _level(df: DataFrame, c: str) -> tuple[Column, Column]:
    """(number, text): numbers in steps of a quarter of a power of two, others as they are; the part that doesn't apply is null."""
    if isinstance(df.schema[c].dataType, T.NumericType):
        return F.floor(F.log2(1 + F.greatest(F.lit(0), F.col(c))) * 4).cast("long"), F.lit(None).cast("string")
    return F.lit(None).cast("long"), F.col(c).cast("string")


def bucketed(df: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """Adds bucket_<column>: floor of the share of rows with a smaller level, times 2 ** bits.

    The levels of all columns are counted in one pass and placed in one order: column i begins after i times the rows. ``df`` is read twice.
    """
    levels = [F.struct(F.lit(i).alias("dim"), number.alias("number"), text.alias("text")) for i, (number, text) in enumerate(_level(df, c) for c in columns)]
    counts = df.select(F.inline(F.array(*levels))).groupBy("dim", "number", "text").agg(F.count("*").alias("rows"))
    placed = positions(counts, ["dim", "number", "text"], "rows", "levels")
    total = placed.where("dim = 0").agg(F.sum("rows").alias("total"))
    placed = placed.withColumn("total", total.scalar())
    for i, c in enumerate(columns):
        number, text = _level(df, c)
        code = placed.where(F.col("dim") == i).select(F.col("number").alias("own_number"), F.col("text").alias("own_text"), F.expr(f"((before - {i} * total) * {1 << bits}) div total").cast("int").alias(f"bucket_{c}"))
        df = df.join(code, number.eqNullSafe(F.col("own_number")) & text.eqNullSafe(F.col("own_text")), "left").drop("own_number", "own_text")
    return df


def along_curve(df: DataFrame, buckets: list[str], bits: int = BITS) -> DataFrame:
    """Adds curve: the Hilbert index of the bucket columns."""
    schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, curve long"

    def index(batches):
        for batch in batches:
            cells = np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in buckets], axis=1)
            yield batch.append_column("curve", pa.array(hilbert_index(cells, bits), pa.int64()))

    return prepared(df).mapInArrow(index, schema)


def sharded(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("lang", "source", "size")) -> DataFrame:
    """id, size, text_crc32, curve, shard, slot; shards differ by one row at most (law ``rows``)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[F.col(c) for c in dimensions if c != "size"])
    rows = stored(rows, "narrow")  # the texts are read once
    placed = along_curve(bucketed(rows, list(dimensions)), [f"bucket_{c}" for c in dimensions])
    placed = placed.select("id", "size", "text_crc32", "curve", F.lit(1).cast("long").alias("one"), F.xxhash64("id").alias("tie"))
    placed = positions(placed, ["curve", "text_crc32", "tie"], "one", "curve")
    total = placed.agg(F.sum("one").alias("total"))
    placed = placed.withColumn("total", total.scalar()).withColumn("shard", F.expr(f"(before * {n_shards}) div total").cast("int"))
    return placed.withColumn("slot", F.expr(f"before - (shard * total + {n_shards - 1}) div {n_shards}")).select("id", "size", "text_crc32", "curve", "shard", "slot")
