"""The choice among tied rows depends on the keys alone."""

import hashlib
import random

import pytest

from splicelake.operators import curves as C


@pytest.mark.parametrize("form", ["x" * 30 + "{:08d}", "{}", "-{}"])
def test_ties_don_t_depend_on_partitions(spark, form):
    own = random.Random(11)
    rows = [(form.format(i), float(own.choice([0.1, 0.5, 0.9])), int(own.random() < 0.1)) for i in range(410)]
    n_pos = sum(y for _, _, y in rows)
    order = sorted(rows, key=lambda r: (-r[1], hashlib.md5(f"{C.TIE_SEED}:{r[0]}".encode()).hexdigest()))
    want = sum(y for _, _, y in order[: n_pos // 2])
    for partitions in (1, 3, 7):
        own.shuffle(rows)
        d = spark.createDataFrame(rows, "key string, score double, label int").repartition(partitions)
        got = C.top_k(d, [], ["key"], (0.5,)).collect()
        assert [(r.k, r.hits) for r in got] == [(n_pos // 2, want)]
