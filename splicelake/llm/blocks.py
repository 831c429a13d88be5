"""Blocks of texts as NumPy arrays: the shared ground of the operators that work on Arrow batches.

A block is the UTF-8 of a batch's texts, one separator byte after each, with the offsets of the texts. Words and bytes of a
whole batch are then found with a few array operations. Null texts count as empty. A batch holds about ``BATCH_BYTES`` or one
longer text, so the memory of a task depends on the longest text, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.session import scratch_dir

BATCH_BYTES = 6 << 20
_ALL = np.arange(256)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: Bytes of words [^\\x20\\x09-\\x0D]+
NO_SPACE = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+
ALNUM = ~((_ALL <= 0x2F) | ((_ALL >= 0x3A) & (_ALL <= 0x60)) | ((_ALL >= 0x7B) & (_ALL <= 0x7F)))


def prepared(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of this session by bytes as well as by rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: computed once, not lost with an executor."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_bounded(spark: SparkSession, value):
    """For values whose size a documented parameter bounds."""
    return spark.sparkContext.broadcast(value)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of ``column``, should the session hand out larger ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def row_keys() -> Iterator[int]:
    """Keys that are unique over all tasks; they are stable once the rows are stored."""
    key = TaskContext.get().partitionId() << 36
    while True:
        yield key
        key += 1


class Block:
    """buf: bytes; off: start of each text and the end; text i is buf[off[i]:off[i + 1] - 1]."""

    def __init__(self, texts: pa.Array, separator: bytes = b"\n"):
        big = pa.large_binary()
        whole = pc.binary_join_element_wise(pc.fill_null(texts.cast(big), b""), pa.scalar(b"", big), pa.scalar(separator, big))
        if isinstance(whole, pa.ChunkedArray):
            whole = whole.combine_chunks()
        _, offsets, data = whole.buffers()
        off = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        self.buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.n = len(whole)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.off) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte, by text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]


def coded(joined: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Strings that stand one after the other: a number for each, equal for equal strings, and the strings by number."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    found = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


class Words:
    """Words of a block: byte ranges, text of each, and numbers that are equal for equal words."""

    def __init__(self, block: Block, table: np.ndarray, lower: bool):
        buf = LOWER[block.buf] if lower else block.buf
        mask = table[buf]
        step = np.diff(mask.view(np.int8))
        starts, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        if len(mask) and mask[0]:
            starts = np.concatenate([[0], starts])
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, block.off)  # of each text, and the number of all
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(block.n), self.counts)
        self.ids, self.dictionary = coded(buf[mask], ends - starts)

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.dictionary.to_pylist()), np.uint64, len(self.dictionary))
        return own[self.ids] if len(own) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.concatenate([start, [len(sorted_values)]]))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair of start and count, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return ahead + np.arange(total)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Flags of 0 .. n - 1: inside any of the ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def text_key(text: str = "text"):
    """Equal for equal texts (null counts as empty): 128 bits of SHA-256."""
    return F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 32)


def without_rows(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text are in ``rejected`` (id, text_key). Null ids are compared like values."""
    bad = rejected.select(F.col("id").alias("rejected_id"), F.col("text_key").alias("rejected_key"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["rejected_id"]) & (text_key(text_col) == bad["rejected_key"]), "left_anti")
