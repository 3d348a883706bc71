"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put together in another order.

The output of a document is never built by string operations on the whole text. Each section is
emitted as pieces, chunks of whole lines, keyed by document and by their position in the output.
Pieces are shuffled by document and sorted by position within the partitions; a task then streams
a document's pieces into an incremental digest and holds one piece at a time. The same stream is
taken apart at the marks, with nothing known but the form, which gives each piece its position in the
restored text; sorted once more, without another shuffle, the pieces give the digest of the
restored text.

A null text counts as empty; an empty one has the form ``plain``, and so has one that holds a mark.
A null doc_id takes part as an empty number. Rows that repeat a doc_id are rows of their own: their
pieces are told apart by a hash of the text and by the partition they come from, and equal rows of
one partition are counted. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import read_table

SEED, RATE, SPM = 7, 100, 50
# fixed values: the marks of the contract
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
RESTORED = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

# Bytes of a piece, about: whole lines as far as they fit; a longer line is cut.
PIECE = 8192
KEY = ["doc_id", "tag", "src"]
_PIECES = ("doc_id long, tag long, src int, at long, form string, n long, prefix_chars long, middle_chars long, piece binary")
_FACTS = ("form", "n", "prefix_chars", "middle_chars")
_BATCH = 1 << 22


def numbers(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four unsigned numbers of 32 bits from the digest of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def _chunks(ends: np.ndarray, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole lines of at most ``size`` bytes; a longer line is cut. ``ends`` are the
    offsets after each line."""
    while start < end:
        stop = min(start + size, end)
        if stop < end:
            line = int(np.searchsorted(ends, stop, "right")) - 1
            if line >= 0 and ends[line] > start:
                stop = int(ends[line])
        yield start, stop
        start = stop


def _sections(text: bytes, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple:
    """Form, number of lines, code points of prefix and middle, line ends, and the sections of the output in order."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    n = len(ends)
    a, b, share, order = numbers(doc_id, seed)
    if not text or any(m in text for m in RESTORED) or share % 100 >= rate:
        return "plain", n, None, None, ends, [(b"", 0, len(text))]
    low, high = sorted((a % (n + 1), b % (n + 1)))
    cut = [0, *[int(ends[i - 1]) if i else 0 for i in (low, high)], len(text)]
    chars = [int(((data[x:y] & 0xC0) != 0x80).sum()) for x, y in zip(cut[:2], cut[1:3])]
    form = "spm" if order % 100 < spm else "psm"
    return form, n, *chars, ends, [(m, cut[RESTORED[m]], cut[RESTORED[m] + 1]) for m in ORDER[form]]


class _Out:
    """Rows gathered into Arrow batches of a few megabytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 64
        if self.held > _BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.held = [], 0


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("src", pa.int32()), *fields])


_PIECE_SCHEMA = _schema(("at", pa.int64()), ("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("piece", pa.binary()))


def cut(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, piece: int = PIECE) -> DataFrame:
    """Pieces of every output with their position ``at``; the first one also carries form and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(_PIECE_SCHEMA)
        for batch in batches:
            for doc, text, tag, src in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "tag", "src")]):
                text = (text or "").encode()
                form, n, before, middle, ends, sections = _sections(text, doc, seed, rate, spm)
                at = 0
                for mark, start, end in sections:
                    for a, b in _chunks(ends, start, end, piece) if start < end else [(start, end)]:
                        facts = (form, n, before, middle) if at == 0 else (None,) * 4
                        body = text[a:b] if a > start else mark + text[a:b]
                        yield from out.add((doc, tag, src, at, *facts, body), len(body))
                        at += 1
        yield from out.flush()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"), F.spark_partition_id().alias("src"))
    return keyed.mapInArrow(run, _PIECES)


def _dealt(pieces: DataFrame) -> DataFrame:
    """A document's pieces in one partition, in order of the output."""
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "at")


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in (*KEY, *columns)])


class _Parser:
    """Finds the marks of a form in a stream of pieces and gives each stretch its restored place."""

    def __init__(self, form: str):
        self.marks, self.seen, self.count = ORDER.get(form, ()), -1, 0

    def split(self, body: bytes) -> Iterator[tuple[int, bytes]]:
        while self.seen + 1 < len(self.marks):
            found = body.find(self.marks[self.seen + 1])
            if found < 0:
                break
            if found:
                yield self._place(), body[:found]
            self.seen += 1
            body = body[found + 3:]
        if body:
            yield self._place(), body

    def _place(self) -> int:
        self.count += 1
        return (RESTORED[self.marks[self.seen]] if self.marks else 0) << 40 | self.count


def digests(pieces: DataFrame) -> DataFrame:
    """Per document: form, counts, digest of the output and of the text restored from it."""
    shape = _schema(("place", pa.int64()), ("piece", pa.binary()), ("copies", pa.int64()), ("form", pa.string()), ("n", pa.int64()),
                    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key = _Out(shape), None
        for *own, at, form, n, before, middle, body in _stream(batches, ["at", *_FACTS, "piece"]):
            if own != key:
                if key:
                    yield from out.add((*key, -1, b"", copies, *facts, digest.hexdigest()))
                key, last, copies, facts = own, -1, 0, (form, n, before, middle)
                digest, parser = hashlib.sha256(), _Parser(form)
            copies += at == 0
            if at == last:  # the same piece of an equal row
                continue
            last = at
            digest.update(body)
            for place, part in parser.split(body):
                yield from out.add((*key, place, part, *(None,) * 6), len(part))
        if key:
            yield from out.add((*key, -1, b"", copies, *facts, digest.hexdigest()))
        yield from out.flush()

    done = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                      ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, digest = _Out(done), None, None
        for *own, place, body, copies, form, n, before, middle, sha in _stream(
                batches, ["place", "piece", "copies", *_FACTS, "output_sha256"]):
            if place < 0:
                for _ in range(head[0] if head else 0):
                    yield from out.add((*head[1], digest.hexdigest()))
                head, digest = (copies, (own[0], n, form, before, middle, sha)), hashlib.sha256()
            else:
                digest.update(body)
        for _ in range(head[0] if head else 0):
            yield from out.add((*head[1], digest.hexdigest()))
        yield from out.flush()

    placed = _dealt(pieces).mapInArrow(
        assemble, "doc_id long, tag long, src int, place long, piece binary, copies long, form string, n long, "
        "prefix_chars long, middle_chars long, output_sha256 string")
    # the pieces of a document are still in one partition: a sort, no shuffle
    return placed.sortWithinPartitions(*KEY, "place").mapInArrow(
        restore, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def outputs(pieces: DataFrame) -> DataFrame:
    """``doc_id, form, output``: the reordered texts themselves, one row per document."""
    shape = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, held = _Out(shape), None, []
        for *own, at, form, body in _stream(batches, ["at", "form", "piece"]):
            if own != key:
                for _ in range(copies if key else 0):
                    yield from out.add((key[0], kind, b"".join(held).decode()), sum(map(len, held)))
                key, last, copies, kind, held = own, -1, 0, form, []
            copies += at == 0
            if at != last:
                held.append(body)
            last = at
        for _ in range(copies if key else 0):
            yield from out.add((key[0], kind, b"".join(held).decode()), sum(map(len, held)))
        yield from out.flush()

    return _dealt(pieces).mapInArrow(run, "doc_id long, form string, output string")


def op11_infill(spark: SparkSession, folder: str) -> DataFrame:
    return digests(cut(read_table(spark, folder, "documents")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us, CAST('0x' || h[1:8] AS BIGINT) AS h1,
             CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
             t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain FROM u),
s AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:n], '') AS x FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || x || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || x || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM s"""
