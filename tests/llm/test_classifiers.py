"""Held-out accuracy, the model's parts against plain computations, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from samples import ODD, prose
from splicelake.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("operator, label, threshold, least", [(quality, "quality", 0.7, 0.97), (toxicity, "toxic", 0.3, 0.9)])
def test_held_out_accuracy(spark, operator, label, threshold, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = operator.scored(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 4 == 2) and r.predicted == (r.score >= threshold) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert len(own) > 50 and sum(r.predicted == r[label] for r in own) / len(own) >= least


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_missing_labels(spark, make_docs, operator, label):
    known = [(5, 1), (6, 1), (4, 0), (8, 0), (99, 1), (None, 1), (7, None)]
    for labels in (known, [], [(5, 1)]):
        got = operator.scored(make_docs(ODD), spark.createDataFrame(labels, f"doc_id long, {label} int")).collect()
        assert sorted((r.id for r in got), key=str) == sorted((i for i, _ in ODD), key=str) and all(0 <= r.score <= 1 for r in got)
    assert operator.scored(make_docs([]), spark.createDataFrame([], f"doc_id long, {label} int")).count() == 0


def test_held_out_labels_teach_nothing(spark, make_docs):
    rows = [(i, prose(i, 60) + (" badword" if i % 2 else "")) for i in range(80)]
    truth = [(i, i % 2) for i, _ in rows]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in truth]
    for operator, label in ((quality, "quality"), (toxicity, "toxic")):
        a, b = ({r.id: r.score for r in operator.scored(make_docs(rows), spark.createDataFrame(x, f"doc_id long, {label} int")).collect()} for x in (truth, flipped))
        assert a == b


def test_additive_model_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no single feature tells anything
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_nearest_examples_are_exact():
    own = random.Random(9)
    rows = []
    for i in range(400):
        terms = sorted(own.sample(range(60), own.randint(1, 9)))
        rows.append((i, i % 2, terms, [own.randint(1, 4) for _ in terms]))
    idf = np.array([own.uniform(1, 8) for _ in range(60)])
    index = toxicity.build_index(rows, idf)
    dense = np.zeros((400, 60))
    number = {i: j for j, i in enumerate(index.ids)}
    for i, _, terms, counts in rows:
        dense[number[i], terms] = toxicity._weights(np.array(terms), np.array(counts), idf)
    for q in rows[:100]:
        weight = toxicity._weights(np.array(q[2]), np.array(q[3]), idf)
        who, near = index.nearest(np.array(q[2]), weight, 10)
        want = dense[:, q[2]] @ weight
        order = np.lexsort((np.arange(400), -np.round(want, 9)))[:10]
        assert np.allclose(near, want[order][: len(near)]) and np.allclose(want[who], near)


def test_monotone_map():
    at, to = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(to) >= 0).all() and to[0] < 0.5 < to[-1]
