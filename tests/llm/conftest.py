"""Small document tables for the corpus operators."""

import pytest
from pyspark.sql import types as T

#: Columns beside those that operators read; names that they use inside themselves.
EXTRA = ("id", "row", "key", "text_key", "start", "end", "part", "items", "terms", "curve", "before", "n", "code", "node")


@pytest.fixture(scope="session")
def make_docs(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in EXTRA])

    def make(rows, partitions=3):
        full = [(i, t, "en", "src", None if t is None else len(t), *("x" for _ in EXTRA)) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
