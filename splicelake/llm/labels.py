"""Labelled rows for training: the held-out rule and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str) -> Column:
    """True for the fold that is never learned from: CRC-32 of the id as text, modulo 4, is 2. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """All rows, or about ``most`` of them chosen by a hash of ``key`` (never more); the same rows in every run."""
    total = df.count()
    if total <= most:
        return df
    code = F.xxhash64(key, F.lit(7))
    return df.where(F.pmod(code, F.lit(1 << 30)) < most * (1 << 30) // total).orderBy(code).limit(most)
