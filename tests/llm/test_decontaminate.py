"""Window matches against a scan of every place."""

import random
import re

import duckdb
from samples import ODD
from splicelake.llm import decontaminate, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, window=13):
    wins = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    items |= own
        out.append((i, len(w), len(hit), sorted(x for x in items if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in df.collect()), key=str)


def test_matches_as_a_scan_does(spark, make_docs):
    own = random.Random(3)
    text = lambda n: "".join(own.choice(["aa", "B", "c9", "é"]) + own.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    bench = [(i, text(own.choice([1, 3, 12, 13, 20]))) for i in range(12)] + [(20, None), (21, "..."), (None, "b b")]
    rows = [(i, text(own.choice([0, 2, 13, 60])) + bench[own.randrange(12)][1] + text(30)) for i in range(40)] + ODD[:9]
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert got(decontaminate.contamination(make_docs(rows), table, slop=0)) == brute(rows, bench)
    assert got(decontaminate.contamination(make_docs(rows), table, slop=2)) == brute(rows, bench)  # proximity matches don't count as hits


def test_passes_over_blocks_of_the_benchmark_unite(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    bench = [(i, f"w{i} x y z w{i} k{i}") for i in range(9)]
    rows = [(1, " ".join(t for _, t in bench)), (2, "w3 x y z w3 k3 w4"), (3, "x y z")]
    assert got(decontaminate.contamination(make_docs(rows), spark.createDataFrame(bench, "item_id long, text string"))) == brute(rows, bench)


def test_proximity_lets_words_stand_off(spark, make_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta new gamma delta"), (3, "alpha one two three four beta gamma delta"), (4, "alpha"), (5, "beta gamma delta")]
    near = {r.id: r.near_items for r in decontaminate.contamination(make_docs(rows, 1), bench, slop=1).collect()}
    assert near == {1: [1], 2: [1], 3: [], 4: [], 5: []}


def brute_near(docs, bench, slop, window=13):
    """Items of each text with a window and a start from which every word stands at most slop places off."""
    out = []
    for d, t in docs:
        w, items = words(t), set()
        for i, b in bench:
            v = words(b)
            for win in [v[k : k + window] for k in range(max(1, len(v) - window + 1))] if v else []:
                if any(all(x in w[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k, x in enumerate(win)) for s in range(-slop, len(w) + slop)):
                    items.add(i)
        out.append((d, sorted(x for x in items if x is not None)))
    return sorted(out, key=str)


def moved(own, text):
    """The text with words put in or changed about."""
    w = text.split()
    for _ in range(own.randint(0, 4)):
        k = own.randrange(len(w) + 1)
        if own.random() < 0.6:
            w.insert(k, own.choice(["new", "a1", "b2"]))
        else:
            w[k : k + 2] = reversed(w[k : k + 2])
    return " ".join(w)


def near_case():
    own = random.Random(11)
    bench = [(i, " ".join(own.choice("abcdefgh") + own.choice("123") for _ in range(own.choice([3, 6, 13, 16])))) for i in range(14)] + [(20, None), (None, "a1 new b2")]
    rows = [(i, " ".join(own.choice("abcdefgh") + own.choice("123") for _ in range(own.choice([0, 5, 30]))) + " " + moved(own, bench[own.randrange(14)][1])) for i in range(60)]
    return rows + [(100, "a1 x b2 y"), (101, "a1 y y new y y b2"), *ODD[:9]], bench


def test_proximity_as_a_scan_does_however_texts_lie_in_segments(spark, make_docs):
    rows, bench = near_case()
    table = spark.createDataFrame(bench, "item_id long, text string")
    for slop in (1, 2):
        want = brute_near(rows, bench, slop)
        for partitions in (1, 7, 60):
            out = decontaminate.contamination(make_docs(rows, partitions), table, slop=slop).collect()
            assert sorted(((r.id, sorted(r.near_items)) for r in out), key=str) == want


def test_the_query_counts_items_with_proximity_matches(spark, make_docs, tmp_path):
    rows, bench = near_case()
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.op1_proximity(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_near_items) for r in out), key=str) == sorted(((i, len(x)) for i, x in brute_near(rows, bench, 2)), key=str)
    assert sum(r.n_near_items > r.n_items for r in out) > 10


def test_the_contract_columns_are_those_of_the_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    cur = con.execute(queries.ORACLES["op1_decontamination"])
    columns = [d[0] for d in cur.description]
    out = queries.op1_proximity(spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, out), key=str) == sorted(cur.fetchall(), key=str)


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(make_docs([]), bench).count() == 0
    assert got(decontaminate.contamination(make_docs(ODD[:5]), bench)) == brute(ODD[:5], [])
