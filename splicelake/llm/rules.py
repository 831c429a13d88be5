"""Quality rules on counts of words, symbols, lines and repeats, and compression bands.

A text fails a band when its Zstandard ratio (compressed bytes by bytes) lies outside the limits for its length; so do its chunks
of ``CHUNK`` bytes, and a text with too many such chunks is rejected as well. Low ratios mean repetition, high ones noise. Short
texts never compress well, so limits depend on the length (``BANDS``) and texts below the first band are not judged by ratio.

Null and empty texts have no words and fail for being short. Repeated rows each get their own verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from splicelake.llm.blocks import NO_SPACE, Block, Words, pieces, prepared, runs

CHUNK = 4096
LEVEL = 3
#: (bytes from which the limits hold, lowest ratio, highest ratio); prose lies near 0.6 at 300 bytes and 0.4 at 30,000, base64 at 0.76.
BANDS = ((128, 0.30, 1.05), (256, 0.30, 0.95), (512, 0.28, 0.82), (2048, 0.26, 0.74), (8192, 0.24, 0.72), (65536, 0.20, 0.70))
#: Share of chunks outside their limits from which a text is rejected.
BAD_CHUNKS = 0.3
MIN_WORDS = 50
REPEAT_WINDOW = 3
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
NOT_NEWLINE = np.arange(256) != 10


def repeated_words(words: Words, n_texts: int, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Flags of words inside a window of k words that stands twice or more in its text."""
    n = len(words.ids) - k + 1
    flags = np.zeros(max(0, len(words.ids)), bool)
    if n <= 0:
        return flags
    start = np.flatnonzero(words.text[: n] == words.text[k - 1 :])
    code = words.ids[start]
    for i in range(1, k):  # numbers stay below the number of windows, so the product fits
        code = np.unique(code, return_inverse=True)[1].ravel() * len(words.dictionary) + words.ids[start + i]
    code = np.unique(code, return_inverse=True)[1].ravel() * n_texts + words.text[start]
    order = np.argsort(code, kind="stable")
    first, length = runs(code[order])
    twice = start[order[np.repeat(length > 1, length)]]
    for i in range(k):
        flags[twice + i] = True
    return flags


def duplicate_lines(block: Block, words: Words) -> np.ndarray:
    """By text: lines with a word that equal an earlier line."""
    lines = Words(block, NOT_NEWLINE, lower=False)
    worded = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    code = (lines.ids * block.n + lines.text)[worded]
    _, first = np.unique(code, return_index=True)
    text = lines.text[worded]
    return np.bincount(text, minlength=block.n) - np.bincount(text[first], minlength=block.n)


def base_counts(block: Block, words: Words) -> dict[str, np.ndarray]:
    """Counts by text; word_chars are code points."""
    lead = (block.buf & 0xC0) != 0x80
    per_word = lambda flags: np.add.reduceat(flags.astype(np.int64), np.minimum(words.first[:-1], max(0, len(flags) - 1))) * (words.counts > 0) if len(flags) else np.zeros(block.n, np.int64)
    return {
        "n_words": words.counts, "word_chars": block.per_text(NO_SPACE[block.buf] & lead), "n_symbols": block.per_text(SYMBOLS[block.buf]),
        "n_dup_lines": duplicate_lines(block, words), "n_repeat_words": per_word(repeated_words(words, block.n)),
    }


def limits(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest ratio for each length."""
    band = np.searchsorted([b for b, _, _ in BANDS], size, "right")
    return np.array([0.0] + [lo for _, lo, _ in BANDS])[band], np.array([np.inf] + [hi for _, _, hi in BANDS])[band]


def ratios(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """By text: ratio of the whole, and the share of chunks outside the limits for a chunk's length."""
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    view, whole, share = memoryview(np.ascontiguousarray(block.buf)), np.ones(block.n), np.zeros(block.n)
    for i, (a, n) in enumerate(zip(block.off[:-1].tolist(), block.sizes.tolist())):
        if not n:
            continue
        whole[i] = len(press.compress(view[a : a + n])) / n
        if n > CHUNK:
            size = np.diff(np.append(np.arange(0, n, CHUNK), n))
            each = np.array([len(press.compress(view[a + j : a + min(n, j + CHUNK)])) for j in range(0, n, CHUNK)]) / size
            lo, hi = limits(size)
            share[i] = ((each < lo) | (each > hi)).mean()
    return whole, share


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts, ratio, bad_chunks, base_failed, kept."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type)] + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(c, T.DoubleType()) for c in ("ratio", "bad_chunks")] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")])

    def judge(batches):
        for batch in pieces(batches):
            block = Block(batch.column("text"))
            words = Words(block, NO_SPACE, lower=False)
            base = base_counts(block, words)
            ratio, bad = ratios(block)
            lo, hi = limits(block.sizes)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            kept = ~failed & (ratio >= lo) & (ratio <= hi) & (bad < BAD_CHUNKS)
            yield pa.record_batch({"id": batch.column("id").cast(to_arrow_type(id_type)), **{c: pa.array(base[c], pa.int64()) for c in counts}, "ratio": pa.array(ratio), "bad_chunks": pa.array(bad), "base_failed": pa.array(failed), "kept": pa.array(kept)})

    return prepared(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, schema)
