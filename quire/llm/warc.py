"""WARC archives: a writer, and a reader that salvages what it can from damaged files.

Every record is a gzip member of its own. The archive files are written by Spark's text sink, so
its commit protocol holds: a lost executor leaves no half file behind. The last byte of a gzip
member is the high byte of its size, zero below 16 MiB; it serves as the sink's line separator, so
the members stand in the file back to back and unchanged.

The reader checks each member (deflate stream, CRC-32, size) and each record (version line,
content length, digests). After a failed check it searches for the next gzip magic or version line
from which a record passes its checks, goes on from there, and logs the bytes between as a gap.

A null payload counts as empty. Equal payloads: the smallest id is the response, the others are
revisits that refer to it. An empty table gives an empty archive and an empty result. Repeated rows
give one record each; those that repeat the smallest id are responses too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import batches, drop, read_table, save, shared_folder

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
# Uncompressed bytes in one gzip member at most; a longer record goes on in the next member.
MEMBER_BYTES = (1 << 24) - 1
# Compressed bytes handed to the inflater at a time.
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, the usual payload digest of web archives."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, sha1: str, refers_to: int | None,
           full_bytes: int) -> bytes:
    """One record; a revisit carries the digest and size of the payload it does not repeat."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Length: {full_bytes}",
        f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> list[bytes]:
    """Gzip members of at most ``MEMBER_BYTES`` each; their last byte is therefore zero."""
    found = []
    for at in range(0, len(data), MEMBER_BYTES):
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        found.append(packer.compress(data[at:at + MEMBER_BYTES]) + packer.flush())
    return found


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``page_id, url, html`` as archives under ``path``.

    Digests are grouped without the payloads; only pages with an equal payload elsewhere are in
    the list of groups, which is joined back. A file holds what one writing task got, so its size
    follows the session's partition size; a reading task holds one file.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"))
    keyed = rows.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    # written first: a join of two plain inputs lets Spark split a payload that many pages share
    listed = save(groups.select("sha1", "first_id"), "equal-payloads")
    ready = rows.withColumn("sha1", F.sha1("payload")).join(listed, "sha1", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out += [m[:-1] for m in members(record(
                    page_id, url, payload, digest(payload), refers_to, len(payload)))]
            yield batches({"member": pa.array(out, pa.binary())})

    packed = ready.mapInArrow(pack, "member binary").select(F.col("member").cast("string").alias("value"))
    packed.write.option("lineSep", "\x00").text(path)
    drop(listed)


def parse(data: bytes, at: int, end: int) -> tuple[dict, bytes, int] | None:
    """Headers, block and end of the record at ``at``; None unless all its checks hold."""
    if not VERSION.match(data, at):
        return None
    close = data.find(b"\r\n\r\n", at, end)
    if close < 0:
        return None
    head = {}
    for line in data[at:close].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isdigit() or close + 4 + int(size) + 4 > end:
        return None
    block = data[close + 4:close + 4 + int(size)]
    after = close + 4 + int(size)
    stated = head.get("warc-block-digest", "").removeprefix("sha1:")
    if data[after:after + 4] != b"\r\n\r\n" or stated and stated != digest(block):
        return None
    return head, block, after + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``; None when its stream, CRC or size is bad."""
    unpacker, view, fed, content = zlib.decompressobj(31), memoryview(data), at, []
    try:
        while not unpacker.eof and fed < len(data):
            content.append(unpacker.decompress(view[fed:fed + STEP]))
            fed = min(fed + STEP, len(data))
    except zlib.error:
        return None
    return (b"".join(content), fed - len(unpacker.unused_data)) if unpacker.eof else None


def compressed_record(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """The record that starts in the member at ``at``, over as many members as it needs."""
    content = b""
    while data.startswith(MAGIC, at):
        member = inflate(data, at)
        if member is None or not content and not VERSION.match(member[0]):
            return None
        content, at = content + member[0], member[1]
        found = parse(content, 0, len(content))
        if found and found[2] == len(content):
            return found[0], found[1], at
        if len(member[0]) < MEMBER_BYTES:
            return None
    return None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict, bytes]]:
    """``("record", from, to, headers, block)`` and ``("gap", from, to, {}, b"")`` in file order.
    Together they cover every byte of the archive once."""
    at = lost = 0
    while at < len(data):
        found = compressed_record(data, at) if data.startswith(MAGIC, at) else parse(data, at, len(data))
        if found:
            if lost < at:
                yield "gap", lost, at, {}, b""
            yield "record", at, found[2], found[0], found[1]
            at = lost = found[2]
            continue
        member = data.find(MAGIC, at + 1)
        line = VERSION.search(data, at + 1)
        starts = [x for x in (member, line.start() if line else -1) if x >= 0]
        at = min(starts) if starts else len(data)
    if lost < len(data):
        yield "gap", lost, len(data), {}, b""


RECORD_SCHEMA = (
    "archive string, kind string, from_byte long, to_byte long, page_id long, url string, "
    "record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records (``kind = 'record'``) and quarantined gaps (``kind = 'gap'``) of the archives
    under ``path``. ``payloads=False`` checks payloads and leaves them out of the rows."""

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for kind, a, b, head, block in salvage(content.as_py()):
                    rows.append(_row(name.as_py(), kind, a, b, head, block, payloads))
                    held += len(block) if payloads else 64
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, SHAPE)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SHAPE)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, RECORD_SCHEMA)


SHAPE = pa.schema([
    ("archive", pa.string()), ("kind", pa.string()), ("from_byte", pa.int64()), ("to_byte", pa.int64()),
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def _number(text: str) -> int | None:
    found = re.search(r"-?\d+(?=>?$)", text)
    return int(found[0]) if found else None


def _row(archive: str, kind: str, a: int, b: int, head: dict, block: bytes, payloads: bool) -> dict:
    row = {"archive": archive, "kind": kind, "from_byte": a, "to_byte": b}
    if kind == "gap":
        return row
    revisit = head.get("warc-type") == "revisit"
    stated = _number(head.get("warc-payload-length", ""))
    return row | {
        "page_id": _number(head.get("warc-record-id", "")), "url": head.get("warc-target-uri"),
        "record_type": head.get("warc-type"), "payload": None if revisit or not payloads else block,
        "payload_bytes": stated if revisit else len(block),
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(block),
        "refers_to": _number(head.get("warc-refers-to", "")) if revisit else None}


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(read_table(spark, folder, "pages"), path)
    return read_archives(spark, path, payloads=False).where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, strlen(h) AS payload_bytes, sha1(h) AS x,
             min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
        lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                         CAST((CAST('0x' || substr(x, i * 5 + 1, 5) AS BIGINT) >> k) & 31 AS BIGINT) + 1, 1)), '')), '')
        AS payload_digest FROM s)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d"""
