"""Near copies: universal hash minima with banding, verified links, and components by alternating large-star and small-star.

1. Every text gets its set of word shingles (64-bit hashes), the minima of ``BANDS * ROWS`` multiply-add hashes over the set,
   and a key of the whole set. Texts with equal sets form one class; only classes go on, so exact copies never meet in pairs.
2. Classes that agree in all minima of a band share a bucket. First each class is paired with one class only, the smallest that it
   shares a bucket with; verified pairs are joined to components. In a further wave each member of a bucket with several
   components is paired with one member of another component, drawn by a hash. At last all pairs of one bucket that still lie in
   different components are compared by a longer signature inside their task, and only those that may be links leave it. So a bucket of thousands of near
   copies costs a few pairs for each, and no link between components is lost.
3. A pair is a link if its full sets say so: 100 * |A and B| >= similarity * |A or B|.

A pair at a similarity of 0.8 shares no bucket with probability (1 - 0.8 ** ROWS) ** BANDS, about 3 in a million; so is the chance
that the longer signature drops it. Null or empty texts and rows without an id are linked with nothing. Texts with fewer
words than a shingle have one shingle, all their words. Repeated rows are exact copies of one another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from splicelake.llm.blocks import NO_SPACE, Block, Words, mixed, pieces, prepared, row_keys, runs, stored

BANDS, ROWS = 32, 5
#: Minima of the second, longer signature, and the share that must agree: 4.5 standard deviations below 0.8.
SKETCH, NEAR = 512, 0.72
#: Members of a bucket that meet in one task.
GROUP = 2048
#: Waves of one pair for each member of a bucket, before all pairs that are left; they only save work.
WAVES = 1
_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
#: Shingles hashed at once: they stay in the processor's cache.
SLICE = 1 << 14


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (with the end)."""
    words = Words(block, NO_SPACE, lower=True)
    own = words.hashes()
    n = len(own) - k + 1
    start = np.flatnonzero(words.text[: max(0, n)] == words.text[k - 1 :]) if n > 0 else np.zeros(0, np.int64)
    code = np.full(len(start), k, np.uint64)
    for i in range(k):
        code = mixed(code + own[start + i])
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    whole = words.counts[short].astype(np.uint64)  # starts with the length, so no shingle of another length is equal
    for i in range(k - 1):
        more = words.counts[short] > i
        whole[more] = mixed(whole[more] + own[words.first[short[more]] + i])
    code, text = np.concatenate([code, whole]), np.concatenate([words.text[start], short])
    order = np.argsort(code)
    small = text[order].astype(np.uint16 if block.n <= 1 << 16 else np.int64)
    order = order[np.argsort(small, kind="stable")]
    code, text = code[order], text[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    code, text = code[new], text[new]
    return code, np.searchsorted(text, np.arange(block.n + 1))


def minima(code: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """A row of 32-bit minima of the first n hashes for each text with shingles."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), n), np.uint32)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SLICE)))
        end = starts[hi] if hi < len(starts) else len(code)
        part, at, product = code[starts[lo] : end], starts[lo:hi] - starts[lo], np.empty(end - starts[lo], np.uint64)
        for i in range(n):
            np.multiply(part, FACTORS[i], out=product)
            np.add(product, SHIFTS[i], out=product)
            out[lo:hi, i] = np.minimum.reduceat(product, at) >> np.uint64(32)
        lo = hi
    return out


def signed(docs: DataFrame, k: int, id_col: str, text_col: str, with_sets: bool = False) -> DataFrame:
    """row, id, n_shingles, set_key, signature (and the set): null key and signature for empty sets."""
    id_type = docs.schema[id_col].dataType
    fields = [("row", T.LongType()), ("id", id_type), ("n_shingles", T.LongType()), ("set_key", T.StringType()), ("signature", T.BinaryType())] + [("shingles", T.BinaryType())] * with_sets

    def sign(batches):
        keys = row_keys()
        for batch in pieces(batches):
            block = Block(batch.column("text"))
            code, first = shingle_sets(block, k)
            size = np.diff(first)
            full = iter(minima(code, first, BANDS * ROWS))
            sets = [code[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            columns = [
                pa.array([next(keys) for _ in sets], pa.int64()), batch.column("id").cast(to_arrow_type(id_type)), pa.array(size, pa.int64()),
                pa.array([xxhash.xxh3_128_hexdigest(x) if x else None for x in sets], pa.string()), pa.array([next(full).tobytes() if n else None for n in size], pa.binary()),
            ] + [pa.array(sets, pa.binary())] * with_sets
            yield pa.record_batch(columns, [c for c, _ in fields])

    return prepared(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, T.StructType([T.StructField(*f) for f in fields]))


def band_codes(rows: np.ndarray) -> np.ndarray:
    """A number for each band of each row of minima; the band's own number is part of it."""
    rows = rows[:, : BANDS * ROWS].reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    code = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        code = mixed(code + rows[:, :, i])
    return code.view(np.int64)


def _bands(batches):
    """node, code: one row per band."""
    for batch in batches:
        if batch.num_rows:
            code = band_codes(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, -1))
            yield pa.record_batch({"node": pa.array(np.repeat(batch.column("node").to_numpy(), BANDS), pa.int64()), "code": pa.array(code.ravel(), pa.int64())})


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, component (its smallest node) for all nodes of the edges a, b.

    Large-star hangs the larger neighbours of each node on its smallest neighbour, small-star the smaller ones; both keep what is
    connected, and only stars remain. The edges are stored after each round.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        now = stored(small.distinct(), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """a, b of the pairs that are links."""

    def confirm(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "left"), ("b", "right")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(confirm, "a long, b long")


def _sketched(sets: DataFrame) -> DataFrame:
    """node, sketch, bands: SKETCH minima of 16 bits and the band codes of each set."""

    def sketch(batches):
        for batch in pieces(batches, "shingles"):
            found = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            rows = minima(np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])]), SKETCH)
            short = [r.tobytes() for r in rows.astype(np.uint16)]
            yield pa.record_batch({"node": batch.column("node"), "sketch": pa.array(short, pa.binary()), "bands": pa.array([r.tobytes() for r in band_codes(rows)], pa.binary())})

    return prepared(sets).mapInArrow(sketch, "node long, sketch binary, bands binary")


def _near_pairs(left: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b: pairs of one bucket and different components whose sketches don't rule out a link.

    Members of a bucket are compared inside a task. A bucket of more than GROUP members is cut into parts, and each two parts meet in
    a task of their own, so no task holds more than twice that many. A pair that shares several buckets is taken in the first.
    """
    parts = left.groupBy("code").agg(F.expr(f"(count(*) + {GROUP - 1}) div {GROUP}").cast("int").alias("parts"))
    dealt = left.join(parts, "code").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("code", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "component").join(sketches, "node")
    n = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["code", "lo", "hi"]

    def compare(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            key = np.stack([held.column(c).to_numpy() for c in keys])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(cut):
                yield from groups(held.slice(0, cut[-1]), cut)
                held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            yield from groups(held, np.array([held.num_rows]))

    def groups(table, cuts):
        node, component, part, lo, hi = (table.column(c).to_numpy() for c in ("node", "component", "part", "lo", "hi"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(node), SKETCH)
        bands, code = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.int64).reshape(len(node), BANDS), table.column("code").to_numpy()
        found = []
        start = 0
        for end in cuts.tolist():
            for i in range(start, end - 1):
                rest = np.flatnonzero(component[i + 1 : end] != component[i]) + i + 1
                if lo[i] != hi[i]:
                    rest = rest[part[rest] != part[i]]
                if len(rest):
                    rest = rest[(sketch[rest] == sketch[i]).mean(axis=1) >= NEAR]
                    rest = rest[bands[i][(bands[rest] == bands[i]).argmax(axis=1)] == code[i]]
                    found.append(np.stack([np.maximum(node[i], node[rest]), np.minimum(node[i], node[rest])]))
            start = end
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        yield pa.record_batch({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return prepared(dealt).repartition(n, *keys).sortWithinPartitions(*keys).select(*keys, "part", "node", "component", "sketch", "bands").mapInArrow(compare, "a long, b long")


def _stars(joined: DataFrame) -> DataFrame:
    return joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _undecided(members: DataFrame, joined: DataFrame) -> DataFrame:
    """code, node, component of the buckets that hold nodes of several components."""
    placed = members.join(joined, "node", "left").select("code", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("code").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("code")
    return stored(placed.join(several, "code", "left_semi"), "undecided")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: int = 80) -> DataFrame:
    """id, n_shingles, component_id, kept: one row per row of ``docs``. similarity: percent, 80 at least (bands and second signature are made for it)."""
    if not 80 <= similarity <= 100:
        raise ValueError("bands and second signature find all pairs from a similarity of 80 percent on")
    texts = stored(signed(docs, k, id_col, text_col), "signatures")
    nodes = texts.where("n_shingles > 0 and id is not null").groupBy("set_key").agg(F.min("row").alias("node"), F.min("id").alias("rep"), F.min_by("id", "row").alias("own"), F.first("signature").alias("signature"))
    nodes = stored(nodes, "classes")

    codes = prepared(nodes.select("node", "signature")).mapInArrow(_bands, "node long, code long")
    buckets = codes.groupBy("code").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1").select("code", "center")
    members = stored(codes.join(buckets, "code"), "buckets")
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", F.col("own").alias("id"), "set_key")
    found = docs.join(wanted.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    sets = signed(found, k, id_col, text_col, with_sets=True).join(wanted, ["id", "set_key"]).dropDuplicates(["node"]).select("node", "shingles")
    sets = stored(sets, "sets")

    first = members.groupBy("node").agg(F.min("center").alias("center")).where("center < node").select(F.col("node").alias("a"), F.col("center").alias("b"))
    joined = components(stored(_verified(first, sets, similarity), "links"))
    members = members.select("code", "node")
    for wave in range(WAVES):
        left = _undecided(members, joined)
        centers = left.groupBy("code").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(wave))).alias("c"))
        pairs = left.join(centers, "code").where("component <> c.component").select(F.greatest("node", "c.node").alias("a"), F.least("node", "c.node").alias("b")).distinct()
        more = stored(_verified(pairs, sets, similarity), "links")
        if more.isEmpty():
            break
        joined = components(_stars(joined).union(more))
    left = _undecided(members, joined)
    sketches = stored(_sketched(sets.join(left.select("node").distinct(), "node", "left_semi")), "sketches")
    more = _verified(stored(_near_pairs(left, sketches), "close"), sets, similarity)
    more = stored(more, "links")
    final = joined if more.isEmpty() else components(_stars(joined).union(more))
    placed = nodes.select("node", "set_key", "rep").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = placed.join(ids, "component").select("set_key", "component_id")
    out = texts.where("id is not null").select("id", "n_shingles", "set_key").join(by_class, "set_key", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    none = texts.where("id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.union(none).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
