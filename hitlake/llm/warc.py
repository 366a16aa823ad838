"""WARC archives: one gzip member per record, written by tasks to shared storage and read back sequentially.

``write`` makes ``.warc.gz`` files of response and revisit records from pages (page_id, url, html). Of records with
equal payloads of at least ``least`` bytes the one with the largest page_id is the response and the others revisit it
(rows that repeat that page_id are responses too); smaller payloads are always responses. ``read`` streams files:
zlib decompresses each member incrementally, Content-Length frames the block, and block and payload digests are
verified; a broken member, frame or digest raises. A revisit holds the HTTP header alone, whose Content-Length and
the WARC-Payload-Digest describe the full payload.

Each attempt of a task writes to a folder of its own and returns the names of its files; Spark commits these names as a
table (``files``), so that a task that runs twice, or whose executor is lost, leaves no record doubled or missing.

Null html is an empty payload; a null page_id or url is kept as null (null ids never revisit). An empty table gives no
files and no records; columns other than the three are ignored. A payload is in a task's memory whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 1000
ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
MOST_TASKS = 10_000
END = b"\r\n\r\n"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    return int(name[10:-1]) if name and name[10:-1] else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, without compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: {_b32(hashlib.sha1(payload).digest())}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def with_references(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with refers_to; only ids and digests are grouped, and a page is shuffled once at most."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    seen = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(f"n >= {int(least)} AND page_id IS NOT NULL")
    first = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least_id")).where("refers_to > least_id").drop("least_id")
    revisits = seen.select("page_id", "digest").join(first, "digest").where("page_id < refers_to").select("page_id", "refers_to", F.col("digest").alias("of")).distinct()
    rows = pages.select("page_id", "url", "html")
    # page_id may repeat with other payloads: the digest decides
    return rows.withColumn("of", F.sha1(body)).join(revisits, ["page_id", "of"], "left").drop("of")


def write(pages: DataFrame, folder: str, least: int = LEAST) -> int:
    """Archive files of all pages in ``folder``; the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _filesystem(folder)
        own = f"attempt-{uuid.uuid4().hex}"
        out, size, names, counts = None, 0, [], []
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    store.create_dir(f"{path}/{own}", recursive=True)
                    names.append(f"{own}/part-{len(names):05d}.warc.gz")
                    counts.append(0)
                    out, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(record(page_id, url, html or b"", refers_to)) + deflate.flush()
                out.write(member)
                size += len(member)
                counts[-1] += 1
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "records": pa.array(counts, pa.int64())})

    rows = with_references(pages, least).select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to")
    rows.mapInArrow(run, "file string, records long").write.parquet(f"{folder}/files")
    return pages.sparkSession.read.parquet(f"{folder}/files").agg(F.sum("records")).first()[0] or 0


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a file, decompressed as its bytes arrive."""
    data = b""
    while data or (data := stream.read(CHUNK)):
        inflate, parts = zlib.decompressobj(31), []
        while True:
            parts.append(inflate.decompress(data))
            if inflate.eof:
                data = inflate.unused_data
                break
            data = stream.read(CHUNK)
            if not data:
                raise ValueError("a gzip member is cut short")
        yield b"".join(parts)


def parse(member: bytes) -> dict:
    """The one record of a member, framed by its Content-Length and checked against its digests."""
    head, found, rest = member.partition(END)
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != END:
        raise ValueError("the block does not have its Content-Length")
    if _b32(hashlib.sha1(block).digest()) != fields["warc-block-digest"]:
        raise ValueError("wrong block digest")
    http, _, payload = block.partition(END)
    length = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"]
    if kind == "response" and (len(payload) != length or _b32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError("wrong payload digest or length")
    uri = fields.get("warc-target-uri")
    return {
        "page_id": _number(fields["warc-record-id"]),
        "url": uri and uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": kind,
        "refers_to": _number(fields.get("warc-refers-to")),
        "payload_bytes": length,
        "payload_digest": base64.b32decode(digest[5:]).hex(),
        "payload": payload if kind == "response" else None,
    }


SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives that ``write`` has committed in folder; payload (binary) on demand, null for revisits."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = SCHEMA + ", payload binary" * payloads
    out = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                store, path = _filesystem(f"{folder}/{name}")
                rows: list[dict] = []
                held = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parse(member))
                        held += len(member) if payloads else 1000
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, out)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, out)

    files = spark.read.parquet(f"{folder}/files").select("file")
    return files.repartition(min(MOST_TASKS, max(1, files.count())), "file").mapInArrow(run, schema)
