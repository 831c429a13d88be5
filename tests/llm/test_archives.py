"""Round trips through packages, and directories with 64-bit fields."""

import io
import zipfile

from splicelake.llm import archives
from splicelake.session import scratch_dir


def expected(rows):
    kept = {}
    for i, _, p in rows:
        if p is not None and len(p.encode()) >= 1000 and i is not None:
            kept.setdefault(p, []).append(i)
    out = []
    for i, url, p in rows:
        best = max(kept.get(p, [None]), key=lambda x: -1 if x is None else x)
        copies = sum(q == p for _, _, q in rows)
        refers = best if p is not None and len(p.encode()) >= 1000 and copies > 1 and best != i else None
        out.append((i, url, "response" if refers is None else "revisit", refers, len((p or "").encode()), None if refers is not None else (p or "").encode()))
    return sorted(out, key=str)


def test_every_record_comes_back(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60, "x" * 1000
    rows = [(1, "http://a/", big), (2, "http://a/?q=ü", big), (9, None, big), (3, "http://b/", other), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "line\nbreak", None), (7, "u", ""), (8, "u", other), (None, "u", "short")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    got = archives.round_trip(df).collect()
    back = {None: None, "http://a/?q=%C3%BC": "http://a/?q=ü", "line%0Abreak": "line\nbreak"}
    assert sorted(((r.id, back.get(r.url, r.url), r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in got), key=str) == expected(rows)


def test_small_packages_hold_the_same(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").repartition(2)
    rows = archives.with_references(df, "page_id", "html")
    manifest = archives.write_packages(rows, scratch_dir(spark, "packages"), "page_id", "url", "html", package_bytes=500).cache()
    assert manifest.count() > 10 and manifest.agg({"n_records": "sum"}).first()[0] == 40
    manifest.unpersist()


def test_empty_table(spark):
    assert archives.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_directories_with_64_bit_fields(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 in a comment"
        z.writestr("first", b"a" * 100)
        z.writestr("second", b"b" * 50)
    data = out.getvalue()
    assert b"PK\x06\x06" in data
    found = archives.members(lambda at, n: data[at : at + n], len(data))
    assert {k: data[a : a + n] for k, (a, n) in found.items()} == {"first": b"a" * 100, "second": b"b" * 50}
