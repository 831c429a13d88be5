"""Packing along a space-filling curve: similar documents share sequences.

A document is its token ids and an end id. Its hashed vector (signed counts of hashed tokens) is projected to a few dimensions, the
cells of the projection give a Hilbert index, and documents follow one another along the curve. The order is cut into sequences of
``LENGTH`` ids, so only the last sequence is padded; a document that crosses a cut goes on in the next sequence.

Texts are tokenized once per distinct chunk of a batch, and chunks are remembered by the worker (``REMEMBERED`` at most): chunks end
at white space and between ASCII letters and ASCII punctuation, where the tokenizer's own pieces end as well. Texts with
the special tokens' "<|" are only cut at white space and keep their case.

Null and empty texts have the end id only. Equal texts lie next to one another; repeated rows are packed each.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from splicelake.llm.blocks import LOWER, Block, coded, mixed, pieces, prepared, ranges, row_keys, stored
from splicelake.llm.curve import hilbert_index, positions

LENGTH = 4096
END = 2
DIMENSIONS, BITS, BUCKETS = 4, 10, 256
REMEMBERED = 800_000
TOKENIZER = "word_bpe_49k.json"

_ALL = np.arange(256)
_SPACE = np.isin(_ALL, [9, 10, 13, 32])
_LETTER = (_ALL >= 97) & (_ALL <= 122)
_PUNCTUATION = (_ALL > 32) & (_ALL < 127) & ~_LETTER & ~((_ALL >= 65) & (_ALL <= 90)) & ~((_ALL >= 48) & (_ALL <= 57)) & (_ALL != 39)
_WORKER: dict = {}


class Chunks:
    """Token ids of chunks of text; number 0 is the end of a document."""

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids are stored with 16 bits")
        code = mixed(np.arange(size, dtype=np.uint64))
        plane = np.random.default_rng(7).normal(size=(BUCKETS, DIMENSIONS)).astype(np.float32)
        self.projection = plane[(code % BUCKETS).astype(np.int64)] * np.where(code >> np.uint64(63), 1, -1)[:, None].astype(np.float32)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.n = np.array([self.end], np.uint16), np.ones(1, np.int64)
        self.first = np.zeros(1, np.int64)

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.number) + len(chunks) > REMEMBERED:
            self.forget()
        known = self.number
        new = [c for c in chunks if c not in known]
        if new:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(b"\0".join(new).decode().split("\0") if not any(b"\0" in c for c in new) else [c.decode() for c in new], add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            known.update(zip(new, range(len(self.n), len(self.n) + len(new))))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint16, int(n.sum()))])
            self.n = np.concatenate([self.n, n])
            self.first = np.cumsum(self.n) - self.n
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each begins (with the end of all)."""
        special = b"<|" in block.buf.tobytes()
        buf = block.buf if special else LOWER[block.buf]
        solid = ~_SPACE[buf]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        if not special:
            begins, mark = _LETTER[buf], _PUNCTUATION[buf]
            ends = begins.copy()
            wide = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)  # two-byte Latin letters, without the signs among them
            begins[:-1] |= wide
            ends[1:] |= wide
            start[1:] |= (ends[:-1] & mark[1:]) | (mark[:-1] & begins[1:])
        at = np.flatnonzero(start)
        length = np.add.reduceat(solid, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        code, chunks = coded(buf[solid], length)
        known = self.numbers(chunks.to_pylist())
        order = np.insert(known[code], np.searchsorted(at, block.off[1:]), 0)  # the end follows each document's last chunk
        n = self.n[order]
        ids = self.flat[ranges(self.first[order], n)]
        ends = np.cumsum(n)[order == 0]
        return ids, np.concatenate([[0], ends])


def chunks_of(path: str, end: int) -> Chunks:
    """One for each worker process."""
    if (path, end) not in _WORKER:
        _WORKER[path, end] = Chunks(path, end)
    return _WORKER[path, end]


def tokenized(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, n_tokens, curve, tie, tokens (little-endian, 16 bits)."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("curve", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def tokenize(batches):
        own, keys = chunks_of(path, end), row_keys()
        for batch in pieces(batches):
            ids, first = own.encode(Block(batch.column("text")))
            n = np.diff(first)
            mean = np.add.reduceat(own.projection[ids], first[:-1]) / n[:, None]
            cells = ((0.5 + np.arctan(3 * mean) / np.pi) * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
            tokens = [ids[a:b].astype("<u2").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.record_batch([
                pa.array([next(keys) for _ in tokens], pa.int64()), batch.column("id").cast(to_arrow_type(id_type)), pa.array(n, pa.int64()), pa.array(hilbert_index(cells, BITS), pa.int64()),
                pa.array([zlib.crc32(t) for t in tokens], pa.int64()), pa.array(tokens, pa.binary()),
            ], ["row", "id", "n_tokens", "curve", "tie", "tokens"])

    return prepared(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tokenize, schema)


def packed(docs: DataFrame, path: str | None = None, end: int = END, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    id_type = docs.schema[id_col].dataType
    fields = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("id", id_type)] + [T.StructField(c, T.LongType()) for c in fields] + [T.StructField("tokens", T.BinaryType())])

    def cut(batches):
        for batch in batches:
            who, rows, parts = [], [], []
            for i, (before, tokens) in enumerate(zip(batch.column("before").to_pylist(), batch.column("tokens").to_pylist())):
                tokens = np.frombuffer(tokens, "<u2").astype("<u4").tobytes()
                n, at = len(tokens) // 4, 0
                while at < n:
                    take = min(n - at, length - (before + at) % length)
                    part = tokens[4 * at : 4 * (at + take)]
                    who.append(i)
                    rows.append((at, take, zlib.crc32(part), n, (before + at) // length, (before + at) % length))
                    parts.append(part)
                    at += take
            table = np.array(rows, np.int64).reshape(len(rows), len(fields))
            yield pa.record_batch([batch.column("id").take(pa.array(who, pa.int64())), *(pa.array(c) for c in table.T), pa.array(parts, pa.binary())], ["id", *fields, "tokens"])

    texts = stored(tokenized(docs, path, end, id_col, text_col), "tokens")
    order = positions(texts.select("row", "n_tokens", "curve", "tie"), ["curve", "tie", "row"], "n_tokens", "curve").select("row", "before")
    return texts.select("row", "id", "tokens").join(order, "row").select("id", "before", "tokens").mapInArrow(cut, schema)
