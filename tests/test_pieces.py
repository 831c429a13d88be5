"""Variants in long sequences against the expressions that work variant by variant, and against brute force."""

import random
import time

from pyspark.sql import functions as F

from splicelake.operators import windows as W
from splicelake.operators.pieces import Cuts, edited_rows
from splicelake.plans.sequence_plans import _rows

SF = "/root/testdata/sf0.001"


def test_same_as_variant_by_variant(spark):
    rows = _rows(spark, SF)
    got = {r.uid: r for r in edited_rows(rows).collect()}
    old = W.adjust_rows(rows)
    old = old.withColumn("_u", W.usable_variants(F.col("variants"), F.col("seq"), F.col("gstart")))
    old = old.select("uid", "gend", "original_end", "n_dropped", "exon_ends", "exon_starts", F.size("variants").alias("n_variants"), F.size("_u").alias("n_applied"), W.apply_variants(F.col("_u"), F.col("seq"), F.col("gstart")).alias("seq"))
    want = {r.uid: r for r in old.collect()}
    assert got.keys() == want.keys() and sum(r.n_applied for r in want.values()) > 50
    for uid, r in want.items():
        assert all(getattr(got[uid], c) == getattr(r, c) for c in old.columns), uid


def random_row(seed, n, length):
    own = random.Random(seed)
    seq = "".join(own.choice("ACGT") for _ in range(length))
    found = []
    for _ in range(n):
        p, k = own.randrange(length), own.choice([1, 1, 2, 4])
        ref = seq[p : p + k] if own.random() < 0.9 else "T" * k
        found.append({"pos": 1000 + p, "ref": ref, "alt": own.choice(["A", "GA", "TTTT", "C"])})
    return seq, sorted(found, key=lambda v: (v["pos"], v["ref"], v["alt"]))


def test_indels_base_by_base():
    for seed in range(40):
        seq, variants = random_row(seed, 30, 120)
        cuts = Cuts(variants, 1000, 1119)
        got, used = cuts.written(seq, 1000)
        bases = list(seq)
        positions = [v["pos"] for v in cuts.kept]
        applied = [v for v in cuts.kept if positions.count(v["pos"]) == 1 and seq[v["pos"] - 1000 :].startswith(v["ref"])]
        for v in applied:
            at = v["pos"] - 1000
            bases[at] = v["ref"][0] if len(v["ref"]) > len(v["alt"]) else v["alt"]
            bases[at + 1 : at + len(v["ref"])] = [""] * (len(v["ref"]) - 1)
        assert got == "".join(bases) and used == len(applied)
        for p in (990, 1000, 1050, 1119):
            assert cuts.moved([p])[0] == p + sum(len(v["alt"]) - len(v["ref"]) for v in cuts.kept if v["pos"] <= p)


def test_long_rows_take_linear_time():
    seq, variants = random_row(1, 10_000, 2_000_000)
    t = time.perf_counter()
    Cuts(variants, 1000, 2_000_999).written(seq, 1000)
    assert time.perf_counter() - t < 2


def test_missing_parts(spark):
    schema = "uid long, gstart int, gend int, exon_ends array<int>, exon_starts array<int>, seq string, variant_list string"
    rows = [(1, 1, 4, [2], [], "ACGT", None), (2, None, None, [2], None, "ACGT", "d:1:A:C"), (3, 1, 4, None, [4], None, "d:1:A:CC,broken"), (4, 1, 0, [], [], "", "None")]
    got = {r.uid: r for r in edited_rows(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].seq, got[1].n_variants, got[1].exon_ends) == ("ACGT", 0, [2])
    assert (got[2].seq, got[2].gend, got[2].n_dropped, got[2].exon_starts) == ("ACGT", None, 1, None)
    assert (got[3].seq, got[3].gend, got[3].exon_starts, got[3].n_applied) == (None, 5, [5], 0)
    assert (got[4].seq, got[4].gend) == ("", 0)
