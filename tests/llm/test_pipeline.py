"""Each stage acts on its input; the queries against their SQL and the result shapes."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

import corpus_pipeline
from check import TABLES, rows_of
from samples import ODD, prose
from splicelake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_as_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns) and rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_stages(spark, make_docs, tmp_path):
    toxic = [f"vile{i}" for i in range(5)]
    item = prose(900, 30)
    rows = [(i, prose(i, 70) + (" " + " ".join(toxic) if i < 40 else "")) for i in range(120)]
    labels = [(i, 1, int(i < 40)) for i in range(120) if i % 3]
    copy = prose(110, 70)
    rows += [(200, copy), (201, copy + " more"), (202, prose(201, 30) + " " + item), (203, "write to joe@mail.example now " + prose(203, 60)), (204, prose(204, 60)), (204, prose(204, 60)), *[(i and 1000 + i, t) for i, t in ODD if i is None or i < 4]]
    docs = make_docs(rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()] if name != "packing" else docs.collect()
    ids = {n: {i for i, _ in x} for n, x in kept.items() if n != "packing"}
    assert not ids["toxicity"] & set(range(40)) and set(range(40, 120)) <= ids["toxicity"]
    assert ids["near copies"] & {110, 200, 201} == {110} and sum(i == 204 for i, _ in kept["near copies"]) == 1
    assert ids["near copies"] - ids["decontamination"] == {202}
    texts = dict(kept["personal data"])
    assert texts[203].startswith("write to [email] now") and texts[204] == dict(rows)[204]
    assert {r.doc_id for r in kept["packing"]} == ids["personal data"] and {None, 1001, 1002, 1003} <= ids["personal data"]
