"""WARC archives whose revisit records point to the original response."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import load, prepare, shared_dir, stored
from goldseam.store import dropped

#: Bytes that one archive file holds before it is compressed; a larger record has a file of its own.
FILE_BYTES = 16 << 20
#: The effort of compression, 1 to 9.
LEVEL = 6
#: The capture time in fresh headers, unless the caller gives one.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def uri_of(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def info(name: str, date: str) -> bytes:
    """The record that every archive starts with."""
    block = b"software: goldseam\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'archive:{name}')}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str, refers_to_url: str | None = None) -> bytes:
    """One record with fresh headers; a revisit holds the payload's size and digest but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri, original = uri_of(url), uri_of(refers_to_url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"WARC-Refers-To-Target-URI: {original}"] if revisit and original else []),
        *([] if page_id is None else [f"X-Page: {page_id}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def agrees(payload: bytes, kind: str, digest: str) -> bool:
    """Whether a stated digest, in hexadecimal or base32, is that of a payload; one of a kind that can't be told here isn't held against it."""
    try:
        raw = hashlib.new(kind.lower() or "sha1", payload).digest()
    except ValueError:
        return True
    return not digest or digest.lower() in (raw.hex(), base64.b32encode(raw).decode().lower(), base64.b32encode(raw).decode().rstrip("=").lower(), base64.b64encode(raw).decode().lower())


class Headers(dict):
    """Header fields, whose names have no case."""

    def __init__(self, fields: Iterator[tuple[str, str]]):
        super().__init__((name.lower(), value) for name, value in fields)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: str) -> bool:
        return super().__contains__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of every record, by the lengths that the headers give."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        # a line that starts with a blank goes on from the one before
        first, *lines = re.sub(r"\r\n[ \t]+", " ", data[at:head].decode()).split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = Headers((name.strip(), value.strip()) for name, _, value in (line.partition(":") for line in lines))
        start = head + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has a wrong length")
        yield headers, data[start:stop]
        at = stop + 4


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write a record for every row into archives under path.

    The payload is the html as UTF-8, a null one empty.  Of records with equal
    payloads of at least min_bytes, that with the largest id is a response and
    the others are revisits of it; smaller ones are all responses.  Rows that
    repeat id and payload are of the same type, so a repeated largest row is two
    responses; a null id counts as smaller than all others, and where all ids of a
    payload are null, all are responses.  An empty table writes no record.

    Digests meet as (digest, largest id) pairs that every task has combined before
    they are shuffled, so a payload that a third of the pages share costs no more
    than any other; Spark picks the join by size and splits hot digests.  Records
    are written where the join leaves them, so payloads are shuffled once at most:
    a task cuts its records into archives of file_bytes, each a row that fills a
    file of its own under Spark's commit protocol.  Each record is a gzip member,
    so that readers can start at any; an empty member ends the archive, whose last
    byte, always 0, is the writer's line separator.
    """
    spark = pages.sparkSession
    prepare(spark)
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))

    # equal payloads are told by SHA-1 in hexadecimal here; the base32 form is made with the record
    keyed = source.withColumn("key", F.sha1("payload"))
    originals = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.max(F.struct("id", "url")).alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("key", F.col("last.id").alias("last"), F.col("last.url").alias("last_url"))
    joined = keyed.join(originals, "key", "left").select("id", "url", "payload", "last", "last_url")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for i, url, payload, last, last_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = record(i, url, payload, digest_of(payload), last, last is not None and i != last, date, last_url)
                if held and size + len(own) > file_bytes:
                    yield archive(held)
                    held, size = [], 0
                held.append(own)
                size += len(own)
        if held:
            yield archive(held)

    def archive(held: list[bytes]) -> pa.RecordBatch:
        members = [gzip.compress(r, LEVEL, mtime=0) for r in (info(digest_of(held[0]), date), *held, b"")]
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["value"])

    records = joined.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, record_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record under path.

    payload is null for a revisit.  Each response's bytes are checked against its
    digest, of whatever kind hashlib knows, if the record gives one; a mismatch
    raises.  payload_digest is SHA-1, null for a revisit that states another kind.  Records of other types
    are passed over.  Archives of other writers are read too: what they don't say
    in extension headers comes from the payload or the stored HTTP headers, and
    page_id and refers_to are null.
    """
    prepare(spark)
    fields = "page_id long, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
        names = [f.split()[0] for f in fields.split(", ")] + ["payload"] * with_payload
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(gzip.decompress(content.as_py())):
                    kind = h["WARC-Type"].lower()
                    if kind not in ("response", "revisit"):
                        continue
                    revisit = kind == "revisit"
                    http, _, body = block.partition(b"\r\n\r\n")
                    payload = None if revisit else body
                    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    size = len(body) if payload is not None else int(stated[1]) if stated else None
                    named, _, digest = h.get("WARC-Payload-Digest", "").rpartition(":")
                    if payload is not None and not agrees(payload, named, digest):
                        raise ValueError(f"record {h['WARC-Record-ID']} doesn't hold the payload of its headers")
                    if named.lower() not in ("", "sha1") or len(digest) != 32:
                        digest = None if revisit else digest_of(payload)  # of another kind, or none
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append((number("X-Page"), h["WARC-Record-ID"], h.get("WARC-Target-URI"), kind, size, digest and digest.upper(), number("X-Refers-To-Page"), *[payload] * with_payload))
                for at in range(0, len(rows), 512):
                    part = list(zip(*rows[at : at + 512], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(run, fields + ", payload binary" * with_payload)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; the archives are deleted once the result is stored."""
    path = f"{shared_dir(spark)}/goldseam/warc-{uuid.uuid4().hex}"
    write_archives(load(spark, sf_dir, "pages"), path)
    try:
        back = read_archives(spark, path, with_payload=False)
        return stored(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    finally:
        dropped(spark, [path])


QUERIES = {"op7_warc": op7_warc}

ORACLE_SQL = {
    "op7_warc": """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex from p
), g as (
  select *, max(page_id) over (partition by hex) as last from d
)
select page_id, payload_bytes::bigint as payload_bytes,
       list_aggregate(list_transform(range(8), lambda i:
         list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i::int, 5))::int >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type,
       case when page_id = last then null else last end as refers_to
from g
"""
}
