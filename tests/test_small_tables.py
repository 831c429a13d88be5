"""Queries against their SQL on tables made for ties, roundings and very short texts."""

import os
import sys

import duckdb
import numpy as np

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

from check import compare

from splicelake.plans import QUERIES


def _agrees(spark, path, name, **tables):
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    msg, _ = compare(spark, con, name, str(path))
    assert msg.startswith("ok"), msg
    return QUERIES[name](spark, str(path))


def test_motifs_of_very_short_texts(spark, tmp_path):
    d = _agrees(spark, tmp_path, "splice_motifs", documents=("doc_id long, text string", [(2 * n + odd, "ACGTA"[:n]) for n in range(6) for odd in (0, 1)]))
    assert {r.doc_id: r.motif for r in d.collect() if r.doc_id % 2 == 0} == {0: "", 2: "", 4: "A", 6: "A", 8: "AG", 10: "AG"}


def test_shifts_of_variants_listed_twice(spark, tmp_path):
    orders = [(15 * d + i, 7 * (i % 2) + 14) for d in range(40) for i in range(15)]
    r = _agrees(spark, tmp_path, "variant_shifts", documents=("doc_id long, text string", [(d, "AC") for d in range(40)]), orders=("o_orderkey long, o_custkey long", orders[::-1])).collect()
    assert len({x["shift"] for x in r if x.k < 15}) > 2


def test_thousandths_of_values_near_a_whole_one(spark, tmp_path):
    x = np.linspace(0.5, 1, 200_001).astype(np.float32)
    near = [float(v) for v in x if np.floor(v * np.float32(1000)) != np.floor(float(v) * 1000)]
    assert near
    v = (near * 64)[:64]
    _agrees(spark, tmp_path, "indel_realignment", embeddings=("vec_id long, label int, embedding array<float>", [(i, 0, v) for i in range(6)]))


def test_sequences_of_documents_without_a_text(spark, tmp_path):
    texts = ["", None, "A", "ACGT\nACGT", "GATTACA" * 100, "\U0001F600é\x00A"]
    orders = [(15 * d + i, 11 * i + d) for d in range(len(texts)) for i in range(15)]
    d = _agrees(spark, tmp_path, "snv_sequences", documents=("doc_id long, text string", list(enumerate(texts))), orders=("o_orderkey long, o_custkey long", orders))
    seqs = {r.uid: r.seq for r in d.collect()}
    assert set(seqs) == set(range(len(texts))) and seqs[0] == seqs[1] == "" and len(seqs[4]) == 700
