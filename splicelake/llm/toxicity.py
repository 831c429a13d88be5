"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Examples are at most ``SAMPLE`` labelled rows, half of them of either class where there are enough (chosen by a hash of the id);
copies among them count once.
The vector space has the words and word beginnings whose counts differ between the classes beyond chance (G-test, Bonferroni bound over all words of the
examples); their document frequencies are counted over all documents, and every document gets its exact cosine to its nearest
examples. The index keeps examples in blocks with the largest weight of each word in a block. A query takes blocks in the order of
their bounds and stops when no block left can hold a nearer example, so results are exact.

Neighbours vote with their cosine as weight. Votes of the examples on one another (each without itself) and the class sizes of all
training labels give a monotone map from votes to probabilities. The neighbours are the evidence. Documents without any word of the
space have no neighbours; their score is the share of toxic examples among those without such a word.

Null and empty texts are such documents. Null labels are skipped; without labels every score is 0. Repeated rows get equal rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from splicelake.llm.blocks import ALNUM, Block, Words, broadcast_bounded, pieces, prepared, stored, text_key
from splicelake.llm.labels import bounded_sample, held_out

#: Most labelled examples, words of the space, and examples that a word must stand in.
SAMPLE, MAX_TERMS, MIN_EXAMPLES = 4096, 20_000, 3
NEIGHBOURS, BLOCK, ERROR_RATE = 15, 64, 0.02
#: Bytes of a word's beginning that count as a term of their own.
STEM = 5


def terms_of(block: Block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, and text and term number of each occurrence: words, and for longer words also "^" and their first bytes."""
    words = Words(block, ALNUM, lower=True)
    whole = words.dictionary.cast(pa.binary())
    stem = pc.if_else(pc.greater(pc.binary_length(whole), STEM), pc.binary_join_element_wise(pa.scalar(b"^"), pc.binary_slice(whole, 0, STEM), pa.scalar(b"")), pa.scalar(None, pa.binary())).dictionary_encode()
    own = stem.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[words.ids] if len(whole) else np.zeros(0, np.int64)
    return pa.concat_arrays([whole, stem.dictionary]), np.concatenate([words.text, words.text[own >= 0]]), np.concatenate([words.ids, own[own >= 0] + len(whole)])


def _pairs(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, term and count of each pair that occurs, sorted by text and term."""
    width = int(term.max(initial=0)) + 1
    code, count = np.unique(text * width + term, return_counts=True)
    return code // width, code % width, count


def space(examples: DataFrame) -> list[bytes]:
    """Words of the space, the most telling first. examples: text, y (0 or 1)."""

    def count(batches):
        for batch in pieces(batches):
            terms, text, term = terms_of(Block(batch.column("text")))
            y = batch.column("y").to_numpy()
            text, term, _ = _pairs(text, term)
            pos, all_ = (np.bincount(term, w, len(terms)).astype(np.int64) for w in (y[text], np.ones(len(text))))
            yield pa.record_batch({"word": terms, "a": pa.array(pos), "b": pa.array(all_ - pos)})

    sizes = examples.agg(F.sum("y"), F.count("*")).first()
    n_pos, n_all = int(sizes[0] or 0), int(sizes[1])
    if not 0 < n_pos < n_all:
        return []
    counts = stored(prepared(examples).mapInArrow(count, "word binary, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "words")
    n_words = counts.count()
    total = F.col("a") + F.col("b")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n_neg = n_all - n_pos
    g = 2 * (part(F.col("a"), total * n_pos / n_all) + part(F.col("b"), total * n_neg / n_all) + part(n_pos - F.col("a"), (n_all - total) * n_pos / n_all) + part(n_neg - F.col("b"), (n_all - total) * n_neg / n_all))
    telling = counts.where(total >= MIN_EXAMPLES).withColumn("g", g).where(F.col("g") >= 2 * math.log(max(2, n_words) / ERROR_RATE))
    return [bytes(r.word) for r in telling.orderBy(F.desc("g"), "word").limit(MAX_TERMS).collect()]


@dataclass
class Index:
    """Blocks of examples: the words of a block, their largest weights, and the weights by example and word."""

    terms: list[np.ndarray]
    most: list[np.ndarray]
    weights: list[np.ndarray]
    first: np.ndarray  # number of each block's first example
    y: np.ndarray
    ids: list

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines, the nearest first (ties: the lower number); only cosines above 0. term: sorted; weight: of length one."""
        at = [np.minimum(np.searchsorted(own, term), len(own) - 1) for own in self.terms]
        hit = [own[i] == term for own, i in zip(self.terms, at)]
        bound = np.array([(m[i] * weight)[h].sum() for m, i, h in zip(self.most, at, hit)])
        who, near = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(near) == k and bound[b] < near[-1] - 1e-9):
                break
            cosine = self.weights[b][:, at[b][hit[b]]] @ weight[hit[b]]
            own = self.first[b] + np.arange(len(cosine))
            keep = (cosine > 0) & (own != without)
            who, near = np.concatenate([who, own[keep]]), np.concatenate([near, cosine[keep]])
            order = np.lexsort((who, -near))[:k]
            who, near = who[order], near[order]
        return who, near


def build_index(rows: list[tuple], idf: np.ndarray) -> Index:
    """rows: id, y, terms (sorted), counts; rows without terms are left out. Examples with the same heaviest word lie together."""
    found = []
    for i, y, terms, counts in rows:
        if len(terms):
            weight = _weights(np.asarray(terms), np.asarray(counts), idf)
            found.append((int(terms[int(weight.argmax())]), i, y, np.asarray(terms), weight))
    found.sort(key=lambda r: (r[0], str(r[1])))
    terms, most, weights, first = [], [], [], []
    for lo in range(0, len(found), BLOCK):
        part = found[lo : lo + BLOCK]
        own = np.unique(np.concatenate([r[3] for r in part]))
        grid = np.zeros((len(part), len(own)))
        for j, r in enumerate(part):
            grid[j, np.searchsorted(own, r[3])] = r[4]
        terms.append(own)
        most.append(grid.max(axis=0))
        weights.append(grid)
        first.append(lo)
    return Index(terms, most, weights, np.array(first, np.int64), np.array([r[2] for r in found], float), [r[1] for r in found])


def _weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weight = (1 + np.log(counts)) * idf[terms]
    return weight / np.sqrt((weight * weight).sum())


def vote(index: Index, who: np.ndarray, near: np.ndarray) -> float:
    return float((near * index.y[who]).sum() / near.sum())


@dataclass
class Model:
    index: Index
    idf: np.ndarray
    at: np.ndarray  # votes and the probabilities that belong to them
    to: np.ndarray
    alone: float  # probability without neighbours

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list]:
        if not len(terms) or not len(self.index.y):
            return self.alone, []
        who, near = self.index.nearest(terms, _weights(terms, counts, self.idf), NEIGHBOURS)
        if not len(who):
            return self.alone, []
        return float(np.interp(vote(self.index, who, near), self.at, self.to)), [(self.index.ids[i], float(c)) for i, c in zip(who[:3], near[:3])]


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted shares of y, pooled until they rise with x; two half rows keep them off 0 and 1."""
    pools = []
    for v, a, n in sorted(zip(x.tolist(), (y * w).tolist(), w.tolist())):
        pools.append([v, v, a, n])
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]):
            lo, _, a0, n0 = pools[-2]
            pools[-2:] = [[lo, pools[-1][1], a0 + pools[-1][2], n0 + pools[-1][3]]]
    share = [(a + 0.5) / (n + 1) for _, _, a, n in pools]
    return np.array([v for p in pools for v in p[:2]]), np.repeat(share, 2)


def train(rows: list[tuple], idf: np.ndarray, class_sizes: tuple[int, int]) -> Model:
    """class_sizes: rows of training labels 0 and 1, of which ``rows`` are a sample."""
    index = build_index(rows, idf)
    y = np.array([r[1] for r in rows], float)
    weight = [class_sizes[c] / max(1, (y == c).sum()) for c in (0, 1)]
    votes, truth = [], []
    for j in range(len(index.y)):
        b = int(np.searchsorted(index.first, j, "right")) - 1
        line = index.weights[b][j - index.first[b]]
        who, near = index.nearest(index.terms[b][line > 0], line[line > 0], NEIGHBOURS, without=j)
        if len(who):
            votes.append(vote(index, who, near))
            truth.append(index.y[j])
    bare = [r[1] for r in rows if not len(r[2])]
    a, n = sum(bare) * weight[1], sum(weight[int(v)] for v in bare)
    alone = (a + 0.5) / (n + 1) if bare else (class_sizes[1] + 0.5) / (sum(class_sizes) + 1) if rows else 0.0
    truth = np.array(truth)
    at, to = monotone(np.array(votes), truth, np.where(truth == 1, weight[1], weight[0])) if votes else (np.array([0.0, 1.0]), np.array([alone, alone]))
    return Model(index, idf, at, to, alone)


def _frequencies(batches):
    """Documents by term, one row per term and batch."""
    for batch in batches:
        term, n = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
        yield pa.record_batch({"term": pa.array(term, pa.int32()), "n": pa.array(n, pa.int64())})


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """id, text_key, held_out, score, predicted, evidence (nearest examples with their cosines). Texts are read once for all documents."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [tuple(r) for y in (0, 1) for r in bounded_sample(known.where(F.col("y") == y), F.col("id"), sample // 2).orderBy("id").collect()]
    examples = spark.createDataFrame(chosen, T.StructType([T.StructField("id", id_type), T.StructField("y", T.IntegerType())]))
    known_texts = rows.join(F.broadcast(examples), "id").groupBy("id").agg(F.min_by(F.struct("text_key", "text", "y"), "text_key").alias("r")).select("id", "r.*")  # one row per id: ``sample`` rows at most
    known_texts = stored(known_texts.dropDuplicates(["text_key", "y"]), "examples")
    words = space(known_texts)

    vector = T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.StringType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    shared_words = broadcast_bounded(spark, words)

    def vectors(batches):
        value_set = pa.array(shared_words.value, pa.binary())
        for batch in pieces(batches):
            block = Block(batch.column("text"))
            terms, text, term = terms_of(block)
            own = pc.index_in(terms, value_set=value_set).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = own[term] if len(terms) else term
            text, term, count = _pairs(text[term >= 0], term[term >= 0])
            cut = pa.array(np.searchsorted(text, np.arange(block.n + 1)), pa.int32())
            yield pa.record_batch([batch.column("id").cast(to_arrow_type(id_type)), batch.column("text_key").cast(pa.string()), pa.ListArray.from_arrays(cut, pa.array(term, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(count, pa.int32()))], vector.names)

    space_rows = stored(prepared(rows).mapInArrow(vectors, vector), "vectors")
    n_docs = space_rows.count()
    df = np.zeros(max(1, len(words)))
    for term, n in space_rows.select("terms").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # a number for each word of the space
        df[term] = n
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    picked = {}
    for r in space_rows.join(F.broadcast(known_texts.select("id", "text_key", "y")), ["id", "text_key"]).dropDuplicates(["id"]).select("id", "y", "terms", "counts").orderBy("id").collect():
        picked[r.id] = (r.id, r.y, r.terms, r.counts)
    model = broadcast_bounded(spark, train(list(picked.values()), idf, (sizes.get(0, 0), sizes.get(1, 0))))

    evidence = T.ArrayType(T.StructType([T.StructField("id", id_type), T.StructField("cosine", T.DoubleType())]))

    def score(batches):
        for batch in batches:
            out = [model.value.score(np.array(t, np.int64), np.array(c, np.int64)) for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist())]
            yield pa.record_batch([batch.column("id"), batch.column("text_key"), pa.array([s for s, _ in out], pa.float64()), pa.array([[{"id": i, "cosine": c} for i, c in e] for _, e in out], to_arrow_type(evidence))], ["id", "text_key", "score", "evidence"])

    out = space_rows.mapInArrow(score, T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)]))
    return out.select("id", "text_key", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
