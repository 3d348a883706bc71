"""Terminology: dictionary terms of one or several words met in texts by equality joins.

Terms are cut into tokens. Two classes meet the texts in different ways:

- *runs*: a term that begins with a word meets the texts by the hash of its first one, two or three tokens, a
  class for each width; what follows is verified at its place. Its neighbours must not be word characters. A
  pattern for words must be one class of characters, once or more.
- *chars*: a term that holds CJK characters, begins with another sign, or can overlap itself meets them at any place by
  the hash of
  its first 16 characters, or of all if fewer, where the first 4 may be those of a term. Terms with CJK characters have no boundaries.

A bitmap of a fixed size over two slots of each term is tested where a text is read, so only places that
may be terms leave the task, with as much text as a term of that class is long. The
dictionary itself is joined, never broadcast by hand, and may be of any size.

Hits of one term do not overlap: the leftmost one stands, as in a search from left to right, and the
boundary is tested afterwards. A null or blank term has no hits, a null text has none; repeated terms
count once, repeated rows of a document give repeated hits. Case is ignored by lower case.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.operators.spans import resolve_overlaps

# Word characters of any script, for Python and for Java.
WORD = r"[\p{Alphabetic}\p{N}_]+"
_WORD_CHAR = r"[\p{IsAlphabetic}\p{N}_]"
WIDEST, GATE, CHARS, SLOTS, _FLUSH = 3, 4, 16, 1 << 22, 20_000
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_HITS = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("width", pa.int32()), ("hash", pa.int64()), ("start", pa.int32()),
                   ("lead", pa.int32()), ("near", pa.string()), ("line", pa.int32()), ("col", pa.int32())])


def _codes(low: str) -> np.ndarray:
    """Code points; the final sigma of lower case depends on what follows and counts as the other one."""
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[codes == 0x3C2] = 0x3C3
    return codes


def _mixed(sums: np.ndarray, salt: int) -> np.ndarray:
    sums = (sums + np.uint64(salt)) * np.uint64(_MIX)
    return sums ^ sums >> np.uint64(32)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the characters before each place times powers, and what moves a span's sum to its start."""
    if len(_powers[0]) <= len(codes):
        for i, step in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(2 * len(codes) + 1, step, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers[0][:len(codes)], out=sums[1:])
    return sums, _powers[1]


def _spans(prefixes: tuple[np.ndarray, np.ndarray], starts: np.ndarray | slice, ends: np.ndarray | slice, salt: int) -> np.ndarray:
    """The hash of the characters of each span."""
    sums, moved = prefixes
    return _mixed((sums[ends] - sums[starts]) * moved[starts], salt)


def _runs(one: np.ndarray, widest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each width, the hash of as many tokens from every token on."""
    run = one
    for width in range(1, min(widest, len(one)) + 1):
        if width > 1:
            run = run[:-1] * np.uint64(_STEP) + one[width - 1:]
        yield width, _mixed(run, (1 << 32) + width)


def _slot_a(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).view(np.int64)


def _slot_b(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40) & np.uint64(SLOTS - 1)).view(np.int64)


@functools.cache
def _members(word: str) -> np.ndarray:
    """Whether each code point belongs to the class of ``word``."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    held = np.zeros(0x110000, bool)
    for m in regex.finditer(word, every):
        held[m.start():m.end()] = True
    held[0xD800:0xE000] = False
    return held


def _lower(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def indexed(terms: DataFrame, column: str = "term", word: str = WORD) -> DataFrame:
    """``key, kind, width, hash, slots, size, bounded, loops`` of each distinct term in lower case."""
    shape = pa.schema([("key", pa.string()), ("kind", pa.string()), ("width", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64())),
                       ("size", pa.int64()), ("bounded", pa.bool_()), ("loops", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, cjk = regex.compile(word).finditer, regex.compile(f"[{K.CJK}]").search
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                found = [m.span() for m in tokens(key)]
                open_ = bool(cjk(key))
                # a suffix that begins a word and is a prefix lets a term overlap itself across a boundary
                loops = any(key.startswith(key[a:]) for a, _ in found if a) or open_ and any(key.startswith(key[i:]) for i in range(1, len(key)))
                if open_ or loops or not found or found[0][0]:
                    kind, width = "chars", min(CHARS, len(key))
                    text, first = _prefixes(_codes(key)), np.zeros(1, np.int64)
                    hashes, gate = (_spans(text, first, first + n, n) for n in (width, min(GATE, width)))
                    loops = any(key.startswith(key[i:]) for i in range(1, len(key)))
                else:
                    kind, width = "runs", min(WIDEST, len(found))
                    starts, ends = np.array(found[:width]).T
                    *_, (_, hashes) = _runs(_spans(_prefixes(_codes(key)), starts, ends, 0), width)
                    gate = hashes
                rows.append((key, kind, width, int(hashes.view(np.int64)[0]), [int(_slot_a(gate)[0]), int(_slot_b(hashes)[0])], len(key), not open_, loops))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    keys = terms.select(F.lower(F.col(column)).alias("key")).where("key is not null and trim(key) <> ''").distinct()
    return keys.mapInArrow(run, "key string, kind string, width int, hash long, slots array<long>, size long, bounded boolean, loops boolean")


def _bitmap(index: DataFrame) -> tuple[bytes, dict[tuple[str, int], int]]:
    """The slots of all terms, ``SLOTS`` bits whatever their number, and the longest term of each class."""
    words = np.zeros(SLOTS // 64, np.int64)
    for row in index.select(F.explode("slots").alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("b")).collect():
        words[row["w"]] = row["b"]
    longest = {(r["kind"], r["width"]): r["n"] for r in index.groupBy("kind", "width").agg(F.max("size").alias("n")).collect()}
    return words.tobytes(), longest


def candidates(docs: DataFrame, index: DataFrame, word: str = WORD) -> DataFrame:
    """Places of ``docs(doc_id, text)`` that may begin a term: class, hash, offset, line, column and the text there."""
    bits, longest = _bitmap(index)
    rolling, wanted = ({w for k, w in longest if k == kind} for kind in ("chars", "runs"))

    def places(codes: np.ndarray, members: np.ndarray, table: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """Of each class, the places that may begin a term, and their hashes."""
        held = lambda slots: np.flatnonzero(table[slots >> 3] >> (slots & 7) & 1)
        text = _prefixes(codes)
        if wanted:
            inside = np.zeros(len(codes) + 2, np.int8)
            inside[1:-1] = members[codes.view(np.int64)]
            turns = np.flatnonzero(np.diff(inside))
            for width, hashes in _runs(_spans(text, turns[::2], turns[1::2], 0), max(wanted)):
                if width in wanted:
                    at = held(_slot_a(hashes))
                    at = at[held(_slot_b(hashes[at]))]
                    yield "runs", width, turns[::2][at], hashes[at]
        for gate in {min(GATE, w) for w in rolling}:
            if gate <= len(codes):
                at = held(_slot_a(_spans(text, slice(0, len(codes) - gate + 1), slice(gate, None), gate)))
                for width in (w for w in rolling if min(GATE, w) == gate):
                    fit = at[:np.searchsorted(at, len(codes) - width, "right")]
                    hashes = _spans(text, fit, fit + width, width)
                    kept = held(_slot_b(hashes))
                    yield "chars", width, fit[kept], hashes[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        members, table = _members(word), np.frombuffer(bits, np.uint8)
        for batch in batches:
            if not longest:
                continue
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                breaks = None
                for kind, width, starts, hashes in places(_codes(_lower(text or "")), members, table):
                    for start, code in zip(starts.tolist(), hashes.view(np.int64).tolist()):
                        if breaks is None:
                            breaks = [m.start() for m in re.finditer("\n", text)]
                        line = bisect.bisect_left(breaks, start)
                        lead = min(start, 1)
                        rows.append((doc, kind, width, code, start, lead, text[start - lead:start + longest[kind, width] + 1],
                                     line + 1, start - (breaks[line - 1] if line else -1)))
                        if len(rows) >= _FLUSH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HITS)], schema=_HITS)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HITS)], schema=_HITS)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, kind string, width int, hash long, start int, lead int, near string, line int, col int")


def phrases(docs: DataFrame, terms: DataFrame, column: str = "term", word: str = WORD) -> DataFrame:
    """``doc_id, key, start, end, token, line, col``: every hit of every term of ``terms(column)``."""
    index = indexed(terms, column, word)

    def met(part: DataFrame) -> DataFrame:
        return candidates(docs, part, word).join(part.drop("slots", "loops"), ["kind", "width", "hash"]).withColumn(
            "token", F.expr("substr(near, lead + 1, size)")).where(F.lower("token") == F.col("key")).withColumns(
            {"size": F.col("size").cast("int"), "end": (F.col("start") + F.col("size")).cast("int")})

    free, group = met(index.where("not loops")), met(index.where("loops"))
    ranked = group.withColumns({"of": F.struct("doc_id", "key"), "form_length": F.col("size"), "ord": F.lit(0)})
    first = resolve_overlaps(ranked, "of").select(*group.columns)
    clear = lambda c: ~F.coalesce(c, F.lit("")).rlike(_WORD_CHAR)
    before, after = F.expr("substr(near, 1, lead)"), F.expr("substr(near, lead + size + 1, 1)")
    return free.unionByName(first).where(~F.col("bounded") | clear(before) & clear(after)).select(
        "doc_id", "key", "start", "end", "token", "line", "col")


def forbidden(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """Hits of ``forms(source, form)`` with what they stand for; of overlapping ones the longest form
    stands, then the first by name."""
    hits = phrases(docs, forms, "form").withColumns({"form_length": F.col("end") - F.col("start"), "ord": F.col("key")})
    named = forms.select(F.lower("form").alias("key"), "source").where("key is not null").distinct()
    return resolve_overlaps(hits, "doc_id").join(named, "key").select("doc_id", "source", "key", "start", "end", "token", "line", "col")


def occurrences(docs: DataFrame, terms: DataFrame, token: str = "[A-Za-z]+") -> DataFrame:
    """Hits of the single-word ``terms(term)``, where words are what ``token`` matches."""
    index = indexed(terms, "term", token).where("kind = 'runs' and width = 1")
    met = candidates(docs, index, token).join(index.select("key", "hash", "size"), "hash")
    return met.withColumn("token", F.expr("substr(near, lead + 1, size)")).where(F.lower("token") == F.col("key")).select(
        "doc_id", "start", "line", "col", "token", "key")


def ambiguous_matched(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id, key, outputs``: terms met in a document that stand there for more than one ``output, concept`` of
    ``pairs(source, output, concept)``; pairs of terms not met don't count."""
    wanted = pairs.select(F.lower("source").alias("key"), "output", "concept").where("key is not null").distinct()
    return hits.select("doc_id", "key").distinct().join(wanted, "key").groupBy("doc_id", "key").agg(
        F.count("*").alias("outputs")).where("outputs > 1")


def first_locations(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits of each term in each document; ``more_matches`` says there are more."""
    place = Window.partitionBy("doc_id", "key").orderBy("start")
    total = Window.partitionBy("doc_id", "key")
    return hits.withColumn("place", F.row_number().over(place)).withColumn(
        "more_matches", F.count("*").over(total) > most).where(F.col("place") <= most)


def brief(located: DataFrame) -> DataFrame:
    """One row per document and matched term: its locations in order."""
    spots = F.array_sort(F.collect_list(F.struct("line", "col")))
    text = F.array_join(F.transform(spots, lambda x: F.concat_ws(":", x["line"].cast("string"), x["col"].cast("string"))), " ")
    return located.groupBy("doc_id", "key").agg(text.alias("locations"), F.max("more_matches").alias("more_matches"))


def ambiguous(pairs: DataFrame) -> DataFrame:
    """Sources, whatever their case, that stand for more than one output."""
    return pairs.groupBy(F.lower("source").alias("key")).agg(F.countDistinct("output").alias("outputs")).where("outputs > 1")


def layered(*frames: DataFrame) -> DataFrame:
    """Pairs ``source, output`` of several layers; the first layer that has a pair owns it."""
    union = None
    for layer, frame in enumerate(frames):
        part = frame.select("source", "output", F.lit(layer).alias("layer"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("source", "output").agg(F.min("layer").alias("layer"))


def expanded(records: DataFrame) -> DataFrame:
    """Every form of ``source, form, deprecated``: the form and each part of the deprecated list,
    blanks dropped, once per source."""
    parts = F.transform(F.split(F.coalesce("deprecated", F.lit("")), r"\|"), lambda x: F.trim(x))
    forms = F.filter(F.concat(F.array("form"), parts), lambda x: x != "")
    return records.select("source", F.explode(forms).alias("form")).distinct()


def drift(hits: DataFrame) -> DataFrame:
    """Spellings per term across all documents: how many, and the most frequent one."""
    forms = hits.groupBy("key", "token").agg(F.count("*").alias("n"))
    return forms.groupBy("key").agg(
        F.count("*").alias("forms"), F.sum("n").alias("uses"), F.max_by("token", F.struct("n", "token")).alias("usual"))


def usage_gap(stated: DataFrame, found: DataFrame) -> DataFrame:
    """Stated against found counts of ``key, n``; keys of either side."""
    return stated.select("key", F.col("n").alias("stated")).join(
        found.select("key", F.col("n").alias("found")), "key", "left").select(
        "key", "stated", F.coalesce("found", F.lit(0).cast("bigint")).alias("found"),
        (F.coalesce("found", F.lit(0)) - F.col("stated")).alias("gap"))
