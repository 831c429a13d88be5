"""Codes as text say what the arrays of codes and weights say, and take no step per base outside strings."""

import pytest
from pyspark.sql import functions as F

from splicelake.functions import sequence as Q
from splicelake.plans import QUERIES


@pytest.mark.parametrize("het", [False, True])
def test_text_equals_arrays(spark, het):
    d = spark.createDataFrame([("",), (None,), ("acgtnMz-é",), ("NNAC",), ("MRWSYKmrwsykACGTN",)], "s string")
    arrays, text = Q.base_codes(F.col("s"), het), Q.code_text(F.col("s"), het)
    for r in d.select("s", arrays.alias("c"), Q.reverse_complement_codes(arrays, het).alias("rc"), Q.one_hot(arrays).alias("hot"), text.alias("t"), Q.reverse_complement_code_text(text, het).alias("rt"),
                      *[Q.weight_sum(text, b, het).alias(b) for b in "ACGT"], Q.code_count(text, 0).alias("pad")).collect():
        if r.s is None:
            assert r.t is None and r.rt is None and r.A is None
            continue
        digits = lambda codes: "".join(Q.CODE_DIGITS[c] for c in codes)
        assert (r.t, r.rt) == (digits(r.c), digits(r.rc)), r
        assert [r[b] for b in "ACGT"] == [sum(h[i] for h in r.hot) for i in range(4)] and r.pad == sum(not any(h) for h in r.hot)


def test_base_encoding_builds_no_array_of_bases(spark):
    plan = QUERIES["base_encoding"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "split(" not in plan
