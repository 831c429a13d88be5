"""Repeated byte strings, found with longest-previous-factor arrays in suffix order.

A place starts a repeat when the ``length`` bytes from it also start elsewhere. Each start belongs to one anchor: the place of the
smallest hash of ``GRAM`` bytes among those inside its string. The anchor depends on the string alone, so equal strings have equal
anchors at equal distance, and only starts whose anchors have equal hashes can be equal. Neighbouring starts with one anchor form a
stretch; a stretch with its bytes up to the end of the last string is a context.

1. Equal texts are one text from here on, and so are equal contexts: all their starts are repeats, without a look at the bytes.
2. Different contexts with one anchor hash meet in a task. Their suffixes are sorted to a depth of ``length`` bytes by doubling; in
   suffix order, neighbours that agree to that depth form runs. Inside a run the previous smaller place (an earlier copy) and the next
   one (a later copy) tell whether the longest previous or the longest next factor of a start reaches ``length``.
3. Anchors with more than ``GROUP`` different contexts are not gathered: each start goes its way with the hash of its string (128
   bits), and equal hashes are counted and reduced to their first place before they are shuffled.

``keep="none"`` removes all copies, ``keep="first"`` all but the first (by text, then place). Bytes of removed strings are judged on
the input, and overlapping ones unite. Matches never cross texts. Null texts are empty; shorter texts are kept as they are. Copies
of a text have equal results, but for ``keep="first"``: of equal texts, the rows with the smallest id are the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from splicelake.llm.blocks import Block, covered, mixed, pieces, prepared, ranges, row_keys, runs, stored, text_key

LENGTH, GRAM = 400, 150
#: Bytes of a piece of work: of texts, and of contexts that are sorted together.
PIECE_BYTES, SORT_BYTES = 2 << 20, 2 << 20
GROUP = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, np.uint64(_inverse(int(_BASE)))))
        return self.up[:n], self.down[:n]


def gram_hashes(buf: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    """Hash of the gram bytes from each place on."""
    up, down = powers.to(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * up, out=total[1:])
    own = (total[gram:] - total[:-gram]) * down[: len(buf) - gram + 1]
    return mixed(own)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each window: by blocks, from either side."""
    n = len(values) - width + 1
    keys = (values >> np.uint64(32) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def stretches(buf: np.ndarray, off: np.ndarray, length: int, gram: int, powers: Powers):
    """text, lo, hi, anchor, anchor hash, context key (two numbers) of all stretches; texts are buf[off[i]:off[i + 1] - 1]."""
    if len(buf) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
    own = gram_hashes(buf, gram, powers)
    anchor = window_minima(own, length - gram + 1)
    n_starts = np.maximum(0, np.diff(off) - 1 - length + 1)
    start = ranges(off[:-1], n_starts)
    text = np.repeat(np.arange(len(n_starts)), n_starts)
    at = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, at, text = start[first], start[last], at[first], text[first]
    view = memoryview(np.ascontiguousarray(buf))
    seeds = (at - lo).tolist()
    keys = b"".join(xxhash.xxh3_128_digest(view[a : b + length], s) for a, b, s in zip(lo.tolist(), hi.tolist(), seeds))
    return text, lo, hi, at, own[at].view(np.int64), np.frombuffer(keys, np.int64).reshape(-1, 2)


def anchored(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """row, id, text_key, n_bytes and the stretches of each text as arrays lo, hi, at, fp, x, y."""
    id_type = docs.schema[id_col].dataType
    arrays = [("lo", T.IntegerType(), pa.int32()), ("hi", T.IntegerType(), pa.int32()), ("at", T.IntegerType(), pa.int32()), ("fp", T.LongType(), pa.int64()), ("x", T.LongType(), pa.int64()), ("y", T.LongType(), pa.int64())]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("text_key", T.StringType()), T.StructField("n_bytes", T.LongType())] + [T.StructField(c, T.ArrayType(t)) for c, t, _ in arrays])

    def units(block: Block):
        """Texts together, or slices of one long text that share length - 1 bytes: buffer, offsets, place of the slice."""
        if block.n > 1 or len(block.buf) <= 2 * PIECE_BYTES:
            yield block.buf, block.off, 0
            return
        for base in range(0, max(1, len(block.buf) - length), PIECE_BYTES):
            end = min(len(block.buf), base + PIECE_BYTES + length)
            yield block.buf[base:end], np.array([0, end - base]), base

    def find(batches):
        keys, powers = row_keys(), Powers()
        for batch in pieces(batches, most=PIECE_BYTES):
            block = Block(batch.column("text"))
            parts = []
            for buf, off, base in units(block):
                text, lo, hi, at, fp, key = stretches(buf, off, length, gram, powers)
                start = block.off[text] - base
                parts.append((text, lo - start, hi - start, at - start, fp, key[:, 0], key[:, 1]))
            text, *values = (np.concatenate(x) for x in zip(*parts))
            cut = pa.array(np.searchsorted(text, np.arange(block.n + 1)), pa.int32())
            yield pa.record_batch(
                [pa.array([next(keys) for _ in range(block.n)], pa.int64()), batch.column("id").cast(to_arrow_type(id_type)), batch.column("text_key").cast(pa.string()), pa.array(block.sizes, pa.int64())]
                + [pa.ListArray.from_arrays(cut, pa.array(v, kind)) for v, (_, _, kind) in zip(values, arrays)],
                schema.names,
            )

    return prepared(docs).select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(find, schema)


def suffix_runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """starts in suffix order (equal ones by place), and where each run of suffixes begins that agree in ``length`` bytes.

    Ranks of 8, 16, 32 ... bytes; the last step joins two ranks that overlap, so the depth is exact.
    """
    depth, n = 8, len(data)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + n]
    rank = np.unique(word, return_inverse=True)[1].ravel()
    while depth * 2 < length:
        shifted = np.concatenate([rank[depth:], np.zeros(min(depth, n), np.int64)])[:n]
        rank = np.unique(rank * (n + 1) + shifted, return_inverse=True)[1].ravel()
        depth *= 2
    code = rank[starts] * (n + 1) + rank[starts + length - depth]
    order = np.lexsort((starts, code))
    return starts[order], runs(code[order])[0]


def factors(data: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous and the longest next factor of each start reach ``length``. place: order of the starts in the corpus.

    In suffix order with equal suffixes by place, the previous smaller place within a run is the neighbour before, and the next
    factor's place is the neighbour after.
    """
    by_place = np.argsort(place, kind="stable")
    number = np.empty(len(starts), np.int64)
    number[by_place] = np.arange(len(starts))
    ordered, first = suffix_runs(data, starts, length)
    at = np.searchsorted(starts, ordered)  # starts are sorted
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ordered))))
    at = at[np.lexsort((number[at], run))]
    previous = np.ones(len(starts), bool)
    previous[first] = False
    following = np.ones(len(starts), bool)
    following[np.append(first[1:], len(ordered)) - 1] = False
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[at], later[at] = previous, following
    return earlier, later


def _ranges_of(flags: np.ndarray, who: np.ndarray, place: np.ndarray):
    """(who, lo, hi) of runs of neighbouring flagged places. who and place are sorted together."""
    who, place = who[flags], place[flags]
    if not len(who):
        return who, place, place
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return who[first], place[first], place[np.append(first[1:], len(who)) - 1]


def _sorted_groups(contexts: DataFrame, length: int, later_only: bool) -> DataFrame:
    """row, lo, hi: starts of contexts that are repeats of starts in another context of their anchor hash."""
    n = max(2, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["fp", "x", "y"]

    def work(table: pa.Table):
        fp, x, y, row, lo = (table.column(c).to_numpy() for c in ("fp", "x", "y", "row", "lo"))
        new = np.ones(len(fp), bool)  # a context may come from several equal rows
        new[1:] = (fp[1:] != fp[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        keep = np.flatnonzero(new)
        texts = table.column("bytes").combine_chunks().take(pa.array(keep)).to_pylist()
        row, lo = row[keep], lo[keep]
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(texts), np.uint8)
        n_starts = size - length + 1
        starts, who = ranges(first, n_starts), np.repeat(np.arange(len(size)), n_starts)
        place = lo[who] + starts - first[who]
        order = np.lexsort((place, row[who]))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        earlier, later = factors(data, starts, number, length)
        who, a, b = _ranges_of(earlier if later_only else earlier | later, who, place)
        return pa.record_batch({"row": pa.array(row[who], pa.int64()), "lo": pa.array(a, pa.int32()), "hi": pa.array(b, pa.int32())})

    def sort_all(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size < SORT_BYTES:
                continue
            table = pa.concat_tables(held)
            fp = table.column("fp").to_numpy()
            cut = int(np.searchsorted(fp, fp[-1]))  # the last group may go on
            if cut:
                yield work(table.slice(0, cut))
                table = table.slice(cut)
            held, size = [table], table.nbytes
        if held:
            yield work(pa.concat_tables(held))

    return prepared(contexts).repartition(n, "fp").sortWithinPartitions(*keys).select(*keys, "row", "lo", "bytes").mapInArrow(sort_all, "row long, lo int, hi int")


def _hashed_groups(contexts: DataFrame, length: int, later_only: bool) -> DataFrame:
    """The same for anchors with very many contexts: strings are counted by hash instead of gathered."""

    def strings(batches):
        for batch in pieces(batches, "bytes", SORT_BYTES // 8):
            rows, places, keys = [], [], []
            for row, lo, data in zip(batch.column("row").to_pylist(), batch.column("lo").to_pylist(), batch.column("bytes").to_pylist()):
                n = len(data) - length + 1
                view = memoryview(data)
                rows.append(np.full(n, row))
                places.append(lo + np.arange(n))
                keys += [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)]
            yield pa.record_batch({"row": pa.array(np.concatenate(rows), pa.int64()), "place": pa.array(np.concatenate(places), pa.int32()), "key": pa.array(keys, pa.binary())})

    each = prepared(contexts).dropDuplicates(["fp", "x", "y"]).select("row", "lo", "bytes").mapInArrow(strings, "row long, place int, key binary").withColumn("key", F.hex("key")).distinct()
    each = stored(each, "strings")
    seen = each.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("first")).where("n > 1")
    found = each.join(seen, "key")
    if later_only:
        found = found.where("struct(row, place) <> first")
    return found.select("row", F.col("place").alias("lo"), F.col("place").alias("hi"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: str = "none", group: int = GROUP) -> DataFrame:
    """text_key, first_id, n_texts, starts: array of lo, hi (starts of repeats, both inclusive) for texts with any."""
    if keep not in ("none", "first") or not 8 < gram < length:
        raise ValueError("keep is none or first, and a gram is shorter than a repeat")
    later_only = keep == "first"
    texts = stored(anchored(docs, length, gram, id_col, text_col), "anchors")
    classes = stored(texts.groupBy("text_key").agg(F.min("row").alias("row"), F.count("*").alias("n_texts"), F.min("id").alias("first_id"), F.min_by("id", "row").alias("own_id"), F.max("n_bytes").alias("n_bytes")), "classes")
    each = texts.join(classes.select("row", "n_texts"), "row").select("row", "n_texts", F.explode(F.arrays_zip("lo", "hi", "at", "fp", "x", "y")).alias("s")).select("row", "n_texts", "s.*")
    # stored first: a join with an aggregate of its own rows would keep all rows of a frequent anchor in one task
    again = stored(each.groupBy("fp").agg(F.sum("n_texts").alias("n_fp")).where("n_fp > 1").select("fp"), "repeated-anchors")
    each = stored(each.join(again, "fp"), "stretches")
    contexts = each.groupBy("fp", "x", "y").agg(F.sum("n_texts").alias("n"), F.min(F.struct("row", "lo", "hi")).alias("s")).select("fp", "x", "y", "n", "s.*")
    contexts = stored(contexts, "contexts")

    whole = each.join(contexts.where("n > 1").select("fp", "x", "y", F.struct("row", "lo").alias("first")), ["fp", "x", "y"])
    if later_only:
        whole = whole.where("struct(row, lo) <> first")
    whole = whole.select("row", "lo", "hi")

    mixed_fps = contexts.groupBy("fp").agg(F.count("*").alias("n_contexts"), F.min("n").alias("least")).where("n_contexts > 1" if later_only else "n_contexts > 1 and least = 1")
    mixed_fps = stored(mixed_fps, "mixed-anchors")
    wanted = contexts.join(mixed_fps.select("fp", "n_contexts"), "fp").select("fp", "x", "y", "row", "lo", "hi", "n_contexts")
    by_text = wanted.groupBy("row").agg(F.collect_list(F.struct("fp", "x", "y", "lo", "hi", "n_contexts")).alias("wanted"))  # bounded by the text's length
    by_text = by_text.join(classes, "row").select("row", F.col("own_id").alias("id"), "text_key", "wanted")
    source = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    with_text = source.withColumnRenamed("id", "text_id").join(by_text, "text_key").where(F.col("text_id").eqNullSafe(F.col("id"))).select("row", "text", "wanted")
    got = stored(with_text.select("row", F.explode(F.transform("wanted", lambda w: F.struct(w.fp.alias("fp"), w.x.alias("x"), w.y.alias("y"), w.lo.alias("lo"), w.n_contexts.alias("n_contexts"), F.substring("text", w.lo + 1, w.hi - w.lo + length).alias("bytes")))).alias("w")).select("row", "w.*"), "bytes")
    found = whole.union(_sorted_groups(got.where(F.col("n_contexts") <= group), length, later_only)).union(_hashed_groups(got.where(F.col("n_contexts") > group), length, later_only))
    starts = found.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    return classes.join(starts, "row", "left").where((F.col("n_texts") > 1) | F.col("starts").isNotNull()).select("text_key", "first_id", "n_texts", "starts")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "none", **more) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay, which need not be UTF-8) of every row."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])
    found = repeats(docs, id_col, text_col, length, keep=keep, **more)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).join(found, "text_key", "left")
    copy = F.coalesce(F.col("n_texts") > 1, F.lit(False))
    if keep == "first":
        copy = copy & ~F.col("id").eqNullSafe(F.col("first_id"))
    rows = rows.select("id", "text", copy.alias("copy"), "starts")

    def cut(batches):
        for batch in pieces(batches):
            out = []
            lists = batch.column("starts")
            for i, (text, whole) in enumerate(zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist())):
                data = np.frombuffer(text, np.uint8)
                gone = np.full(len(data), whole and len(data) >= length)
                if not gone.any() and lists[i].is_valid:
                    own = lists[i].values
                    lo, hi = own.field("lo").to_numpy().astype(np.int64), own.field("hi").to_numpy().astype(np.int64)
                    gone = covered(lo, hi - lo + length, len(data))
                kept = data[~gone].tobytes()
                out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.record_batch([batch.column("id").cast(to_arrow_type(id_type)), *(pa.array([r[j] for r in out], to_arrow_type(f.dataType)) for j, f in enumerate(schema.fields[1:]))], schema.names)

    return prepared(rows).mapInArrow(cut, schema)
