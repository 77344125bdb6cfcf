"""WARC archives: a writer that deduplicates payloads and a splittable reader.

Writing: of records with equal payloads of MIN_BYTES or more, the one with the largest id is the
response and the others are revisits that refer to it. Every record is a gzip member of its own. A
task writes one archive under a temporary name and renames it, so that a retry replaces it whole.

Reading: archives are cut into byte ranges. The task of a range looks for the two magic bytes and the
method byte of gzip, takes a hit for a member only if it inflates to a WARC version line and a
complete header block, and owns the records whose members start within its range; the last of them
is read past the range's end. So ranges of any size give each record once.

Archives are opened by Python tasks through pyarrow's file systems, which take the shared folder's URI.

Defined cases: a null payload is empty; a null id is written as an empty page id and read back as
null, and is the largest of none; equal ids are all written; empty payloads and those under MIN_BYTES are
responses; no rows give no archives and no records; a cut or corrupt record is read as a row of type "damaged".
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_BYTES = 1000
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
HEAD_BYTES = 1 << 16
MOST_TASKS = 20_000
MOST_BROADCAST = 200_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://"))


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with an HTTP head and the payload, or a revisit with the head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write archives into folder; (path, size) of each, as a written table."""
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= min_bytes
    first = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = common.materialize(first, "repeated")
    if first.count() <= MOST_BROADCAST:  # of some 80 bytes each; payloads are then not shuffled
        first = F.broadcast(first)
    rows = rows.join(first, "digest", "left").withColumn("kind", F.when((F.col("response_id") != F.col("page_id")) | (F.col("response_id").isNotNull() & F.col("page_id").isNull()), "revisit").otherwise("response"))

    def run(batches):
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, path = _open(name)
        size, out = 0, None
        for batch in batches:
            if batch.num_rows and out is None:
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path + ".part")
            for r in batch.to_pylist():
                size += out.write(member(record(r["kind"], r["page_id"], r["url"], r["payload"], r["digest"], r["response_id"])))
        if out is not None:
            out.close()
            fs.move(path + ".part", path)  # only whole archives have the final name, and only listed ones are read
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["path", "size"])

    return common.materialize(rows.select("page_id", "url", "payload", "digest", "kind", "response_id").mapInArrow(run, "path string, size long"), "archives")


class _Source:
    """Bytes of a file from an offset on, fetched in pieces."""

    def __init__(self, handle, at: int, size: int):
        self.handle, self.start, self.size, self.data = handle, at, size, bytearray()

    def ensure(self, end: int) -> None:
        while self.start + len(self.data) < min(end, self.size):
            self.handle.seek(self.start + len(self.data))
            self.data += self.handle.read(max(1 << 20, min(end, self.size) - self.start - len(self.data)))

    def forget(self, at: int) -> None:
        del self.data[: at - self.start]
        self.start = at


def _inflate(src: _Source, at: int, most: int | None) -> tuple[bytes, int] | None:
    """What the member at `at` holds (most bytes of it at least, if it has them) and where it ends."""
    z = zlib.decompressobj(31)
    out, pos, got = [], at, 0
    while not z.eof:
        src.ensure(pos + (1 << 16))
        piece = bytes(src.data[pos - src.start : pos - src.start + (1 << 16)])
        if not piece:
            return None
        try:
            x = z.decompress(piece)
        except zlib.error:
            return None
        out.append(x)
        got += len(x)
        pos += len(piece) - len(z.unused_data)
        if most is not None and got >= most:
            break
    return b"".join(out), pos


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields by lower-case name, and the block; None if it's no whole record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {}
    for x in lines[1:]:
        k, colon, v = x.partition(b":")
        if not colon:
            return None
        fields[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields or len(rest) < int(fields["content-length"]):
        return None
    return fields, rest[: int(fields["content-length"])]


def records(handle, start: int, end: int, size: int):
    """(offset, fields, block) of the records whose members start in [start, end).

    A member that begins like a record but is cut or corrupt gives one of type "damaged", and the search goes on behind its start.
    """
    src = _Source(handle, start, size)
    at, known = start, False
    while at < end:
        if not known:  # look for a member
            src.ensure(min(end + 2, at + (1 << 20)))
            k = src.data.find(MAGIC, at - src.start)
            if k < 0:
                at = max(at + 1, src.start + len(src.data) - 2)
                src.forget(min(at, src.start + len(src.data)))
                if src.start + len(src.data) >= size and not len(src.data) > 2:
                    return
                continue
            at = src.start + k
            if at >= end:
                return
            probe = _inflate(src, at, HEAD_BYTES)
            if probe is None or not probe[0].startswith(b"WARC/1."):
                at += 1
                continue
        got = _inflate(src, at, None)
        found = got and parse(got[0])
        if not found:
            if known or _inflate(src, at, HEAD_BYTES) is not None:
                yield at, {"warc-type": "damaged"}, b""
            at, known = at + 1, False
            continue
        yield at, *found
        at, known = got[1], got[1] < size
        src.ensure(at)
        src.forget(at)
        if known:
            src.ensure(at + 3)
            known = src.data[:3] == MAGIC
        elif at >= size:
            return


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, warc_type, page_id, refers_to, digest, http_length, payload) of all records of (path, size) rows."""
    ranges = archives.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    schema = "path string, offset long, warc_type string, page_id long, refers_to long, digest string, http_length long, payload binary"

    def number(name: str):
        x = name.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x.lstrip("-").isdigit() else None

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = _open(r["path"])
                with fs.open_input_file(path) as handle:
                    for at, f, block in records(handle, r["start"], r["start"] + range_bytes, r["size"]):
                        head, _, body = block.partition(b"\r\n\r\n")
                        length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in f else None
                        yield r["path"], at, f["warc-type"], number(f.get("warc-record-id", "")), number(f.get("warc-refers-to", "")), digest, length, body

    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        held, size = [], 0
        for x in rows(batches):
            held.append(x)
            size += len(x[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names=names)

    n = archives.select(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    return ranges.repartition(min(int(n), MOST_TASKS)).mapInArrow(run, schema)  # by number: adaptive execution must not merge tiny rows that stand for much work


def op4_warc(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    archives = write(pages, common.new_path(spark, "warc"))
    got = read(archives)
    is_response = F.col("warc_type") == "response"
    # a response's figures come from its payload, a revisit's from its header fields
    return got.select(
        "page_id",
        F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(is_response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        "refers_to",
    )


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest from p),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as r from d)
select page_id, payload_bytes, payload_digest,
  case when r = page_id then 'response' else 'revisit' end as record_type,
  case when r = page_id then null else r end as refers_to
from m
"""
