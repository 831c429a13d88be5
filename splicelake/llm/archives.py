"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, a gzip member for each record, and ``indexes/index.cdxj``, a line per record with offset and
length inside the archive. ``write_packages`` lets each task write packages of about ``PACKAGE_BYTES`` below a shared folder and
returns a manifest; a task that is repeated writes new files, and only those of the attempt that counts are listed.

``locate`` reads the end of a package, its central directory (ZIP64 where the 32-bit fields are full) and its index member, and
returns byte ranges of some megabytes; ``read_records`` reads those ranges and parses the records. Nothing is extracted, and a
task holds one range. Paths are anything that ``pyarrow.fs`` opens.

Null payloads are empty; null ids and urls are kept as null. Rows with equal ids are records of their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.llm.blocks import pieces, prepared, stored
from splicelake.session import scratch_dir

PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records with smaller payloads are never turned into references.
MIN_REVISIT = 1000
#: Fixed values of the formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
RECORD_URN = "<urn:splicelake:record:"


def with_references(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Adds ``refers_to``: for payloads of MIN_REVISIT bytes or more, the largest id with the same payload unless the row has it itself.

    Rows that share the largest id and the payload all stay full records. Digests are counted before they are shuffled, and decisions are
    made on ids and digests; payloads meet the decisions by id, so that copies of one payload are not gathered.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    keyed = pages.withColumn("payload_key", F.sha2(payload, 256))
    narrow = keyed.where(F.octet_length(payload_col) >= MIN_REVISIT).select(F.col(id_col).alias("own_id"), F.col("payload_key").alias("own_key"))
    kept = narrow.groupBy("own_key").agg(F.max("own_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1").select("own_key", "kept_id")
    kept = stored(kept, "kept-payloads")
    revisits = narrow.distinct().join(kept, "own_key").where(~F.col("own_id").eqNullSafe(F.col("kept_id")))
    joined = keyed.join(revisits, keyed[id_col].eqNullSafe(revisits["own_id"]) & (keyed["payload_key"] == revisits["own_key"]), "left")
    return joined.withColumn("refers_to", F.col("kept_id")).drop("payload_key", "kept_id", "own_id", "own_key")


def record(record_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    name = lambda x: f"{RECORD_URN}{quote(x, safe='')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", f"Content-Length: {len(body)}",
    ]
    head += [f"WARC-Record-ID: {name(record_id)}"] if record_id is not None else []
    head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%')}"] if url is not None else []
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if refers_to is not None else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields of one record; the payload of a full record is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if len(rest) != len(body) + 4 or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = body.partition(b"\r\n\r\n")
    said = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (len(payload) != said or hashlib.sha1(payload).digest() != digest):
        raise ValueError("a payload doesn't match its digest")
    name = lambda x: x and unquote(x.removeprefix(RECORD_URN).removesuffix(">"))
    return {
        "id": name(fields.get("WARC-Record-ID")), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": name(fields.get("WARC-Refers-To")),
        "payload_bytes": said, "payload_digest": digest.hex(), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


class _Package:
    """A ZIP file under way: records go straight to the archive member, index lines wait for the end."""

    def __init__(self, folder: str):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.path, self.n, self.at, self.lines = posixpath.join(folder, name), 0, 0, []
        self.stream = store.open_output_stream(posixpath.join(base, name))
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, key: str | None, date: str, data: bytes) -> None:
        self.member.write(data)
        self.lines.append(f"{quote(key or '-', safe='')} {date} {json.dumps({'offset': self.at, 'length': len(data)})}\n")
        self.at, self.n = self.at + len(data), self.n + 1

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.stream.close()
        return self.path, self.n


def write_packages(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, date: str = "2000-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Manifest of the packages: path, n_records. The frame must have ``refers_to``; writing happens when the manifest is computed."""

    def write(batches):
        done, package = [], None
        for batch in pieces(batches, "payload"):
            for row in batch.to_pylist():
                package = package or _Package(folder)
                package.add(row["id"], date, gzip.compress(record(row["id"], row["url"], row["payload"] or b"", row["refers_to"], date), compresslevel=4, mtime=0))
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
        done += [package.close()] if package else []
        yield pa.record_batch({"path": pa.array([x for x, _ in done], pa.string()), "n_records": pa.array([n for _, n in done], pa.int64())})

    rows = prepared(pages).select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"), F.col("refers_to").cast("string").alias("refers_to"))
    return rows.mapInArrow(write, "path string, n_records long")


def _opened(path: str) -> tuple[Callable[[int, int], bytes], int]:
    store, base = fs.FileSystem.from_uri(path)
    source = store.open_input_file(base)
    return lambda at, n: source.read_at(n, at), source.size()


def members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """Data offset and length of each stored member, from the central directory."""
    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(EOCD)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (length, start):
        mark, _, end64, _ = struct.unpack("<4sIQI", read(tail_at + at - 20, 20))
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        mark, *_, count, length, start = struct.unpack("<4sQHHIIQQQQ", read(end64, 56))
        if mark != EOCD64:
            raise ValueError("no ZIP64 end of a central directory")
    found, raw, at = {}, read(start, length), 0
    for _ in range(count):
        mark, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_comment, _, _, _, local = struct.unpack_from("<4s6H3I5H2I", raw, at)
        if mark != CENTRAL:
            raise ValueError("a damaged central directory")
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, at = raw[at + 46 + n_name : at + 46 + n_name + n_extra], at + 46 + n_name + n_extra + n_comment
        full = [plain, packed, local]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values stand in this order, only for fields that are full
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = [next(wide) if x == 0xFFFFFFFF else x for x in full]
            extra = extra[4 + n :]
        if method == 0 and not flags & 1:
            found[name] = (full[2], full[1])
    out = {}
    for name, (local, n) in found.items():
        mark, n_name, n_extra = struct.unpack("<4s22x2H", read(local, 30))
        if mark != LOCAL:
            raise ValueError("a member isn't where the directory says")
        out[name] = (local + 30 + n_name + n_extra, n)
    return out


def index_ranges(read: Callable[[int, int], bytes], size: int, most: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Byte ranges of whole records: offset in the package and the lengths of the records in it."""
    found = members(read, size)
    base, _ = found[ARCHIVE]
    lengths, start, end = [], None, None
    for line in read(*found[INDEX]).decode().splitlines():
        x = json.loads(line.split(" ", 2)[2])
        if lengths and (x["offset"] != end or end + x["length"] - start > most):
            yield base + start, lengths
            lengths = []
        start, end = x["offset"] if not lengths else start, x["offset"] + x["length"]
        lengths.append(x["length"])
    if lengths:
        yield base + start, lengths


def locate(manifest: DataFrame) -> DataFrame:
    """path, at, lengths: ranges to read, dealt out evenly over the tasks."""

    def find(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = list(index_ranges(*_opened(path)))
                yield pa.record_batch({"path": pa.array([path] * len(rows), pa.string()), "at": pa.array([a for a, _ in rows], pa.int64()), "lengths": pa.array([x for _, x in rows], pa.list_(pa.int64()))})

    n = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n).mapInArrow(find, "path string, at long, lengths array<long>").repartition(n)


def read_records(ranges: DataFrame) -> DataFrame:
    schema = "id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def read_all(batches):
        for batch in batches:
            for row in batch.to_pylist():
                read, _ = _opened(row["path"])
                data, at, rows = read(row["at"], sum(row["lengths"])), 0, []
                for n in row["lengths"]:
                    rows.append(parsed(gzip.decompress(data[at : at + n])))
                    at += n
                yield pa.record_batch({c: pa.array([x[c] for x in rows], kinds[k]) for c, k in fields})

    return ranges.mapInArrow(read_all, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row, read every record."""
    rows = with_references(pages.select(id_col, url_col, payload_col), id_col, payload_col)
    manifest = stored(write_packages(rows, scratch_dir(pages.sparkSession, "packages"), id_col, url_col, payload_col), "manifest")
    kind = pages.schema[id_col].dataType
    return read_records(locate(manifest)).withColumn("id", F.col("id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
