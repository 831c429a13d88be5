"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of a text. Each feature is cut into bins; boosting goes round the features again and again and adds
a shallow tree of one feature to that feature's lookup table. The pairs that explain most of what is left get tables of their own
in the same way. A score is a sum of table entries, looked up for whole batches, through the logistic function.

Trained on at most ``SAMPLE`` labelled rows (chosen by a hash of their id); scored for every text. Null texts count as empty and get
a score like any other. Null labels are skipped; without any labels, or with one class, all scores are the share of that class.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from splicelake.llm import rules
from splicelake.llm.blocks import NO_SPACE, Block, Words, broadcast_bounded, pieces, prepared, stored
from splicelake.llm.labels import bounded_sample, held_out

#: Most labelled rows that training looks at.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 32, 8, 6, 150, 60, 0.1, 2.0
LEAVES = 3
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "punctuation", "non_ascii", "symbols", "exclamations", "lines", "dup_lines", "repeats", "distinct", "short_words", "ratio", "bad_chunks",
)
_ALL = np.arange(256)
_UPPER, _DIGIT = (_ALL >= 65) & (_ALL <= 90), (_ALL >= 48) & (_ALL <= 57)
_LETTER = _UPPER | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)
_PUNCTUATION = NO_SPACE & ~_LETTER & ~_DIGIT & (_ALL > 32)


def features(block: Block) -> np.ndarray:
    """A row per text, columns as FEATURES."""
    words = Words(block, NO_SPACE, lower=False)
    base = rules.base_counts(block, words)
    ratio, bad = rules.ratios(block)
    n, size = np.maximum(1, base["n_words"]), np.maximum(1, block.sizes)
    share = lambda table: block.per_text(table[block.buf])
    length = words.ends - words.starts
    longest, distinct, short = np.zeros(block.n), np.zeros(block.n), np.bincount(words.text[length <= 3], minlength=block.n)
    np.maximum.at(longest, words.text, length)
    pairs = np.unique(words.ids * block.n + words.text)
    distinct += np.bincount(pairs % block.n, minlength=block.n) if len(pairs) else 0
    return np.stack([
        np.log1p(block.sizes), np.log1p(base["n_words"]), base["word_chars"] / n, np.log1p(longest), share(_UPPER) / np.maximum(1, share(_LETTER)), share(_DIGIT) / size, share(_PUNCTUATION) / size,
        share(_ALL >= 128) / size, base["n_symbols"] / n, share(_ALL == 33) / n, (share(_ALL == 10) - 1) / n, base["n_dup_lines"] / np.maximum(1, share(_ALL == 10)), base["n_repeat_words"] / n, distinct / n, short / n, ratio, bad,
    ], axis=1).astype(np.float64)


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), _logistic(self.start))
        b = self.bins(x)
        total = self.start + sum(t[b[:, j]] for j, t in enumerate(self.tables))
        for i, j, t in self.pairs:
            total = total + t[b[:, i] * PAIR_BINS // BINS, b[:, j] * PAIR_BINS // BINS]
        return _logistic(total)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of a row of bins into two: gain and the first bin of the right part."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Step for each bin of a tree that cuts the best leaf in two until it has enough leaves."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = max(((*_split(g[a:b], h[a:b]), a) for a, b in zip(cuts, cuts[1:]) if b - a > 1), default=(0.0, 0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1] + best[2]])
    step = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on a grid: a cut along one axis, then one along the other on either side."""
    best, where = -1.0, (0, 1)
    for axis in (0, 1):
        gain, at = _split(g.sum(axis=1 - axis), h.sum(axis=1 - axis))
        if gain > best:
            best, where = gain, (axis, at)
    axis, at = where
    step = np.zeros_like(g)
    for part in (slice(0, at), slice(at, None)):
        own = (part, slice(None)) if axis == 0 else (slice(None), part)
        line = _tree(g[own].sum(axis=axis), h[own].sum(axis=axis), 2)
        step[own] = line[None, :] if axis == 0 else line[:, None]
    return step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    model = Model()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.start = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(BINS) for _ in model.edges]
    b, total = model.bins(x), np.full(len(y), model.start)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = _logistic(total)
            step = RATE * _tree(np.bincount(b[:, j], p - y, BINS), np.bincount(b[:, j], p * (1 - p), BINS))
            table += step
            total = total + step[b[:, j]]
    coarse = b * PAIR_BINS // BINS
    grid = lambda i, j, w: np.bincount(coarse[:, i] * PAIR_BINS + coarse[:, j], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    p = _logistic(total)
    worth = {}
    for i, j in combinations(range(x.shape[1]), 2):
        g, h = grid(i, j, p - y), grid(i, j, p * (1 - p))
        worth[i, j] = float((_pair_tree(g, h) * -g).sum())
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in sorted(worth, key=worth.get, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            p = _logistic(total)
            step = RATE * _pair_tree(grid(i, j, p - y), grid(i, j, p * (1 - p)))
            table += step
            total = total + step[coarse[:, i], coarse[:, j]]
    return model


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted; the features of all texts are computed once and stored."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def extract(batches):
        for batch in pieces(batches):
            x = features(Block(batch.column("text")))
            yield pa.record_batch({"id": batch.column("id").cast(to_arrow_type(id_type)), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))})

    rows = stored(prepared(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(extract, schema), "features")
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    known = bounded_sample(rows.join(known, "id").select("id", "x", "y"), F.col("id"), sample).orderBy("id", "y").collect()
    model = broadcast_bounded(spark, fit(np.array([r.x for r in known]).reshape(len(known), len(FEATURES)), np.array([r.y for r in known])))

    def score(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(model.value.scores(x))})

    out = rows.mapInArrow(score, T.StructType([T.StructField("id", id_type), T.StructField("score", T.DoubleType())]))
    return out.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
