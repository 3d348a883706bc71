"""Substring dedup: suffix automata over shards of the repeated passages.

A window is ``WINDOW`` consecutive words; a word goes when it lies in a window whose words also
start in a document with a smaller id. Finding that takes four steps:

1. Each window has an anchor, the lowest hash among its ``GRAM``-word runs. Consecutive windows
   with one anchor form a segment, mostly of 50 to 88 words. Equal windows have equal anchors, so only
   segments whose anchor occurs in two documents can hold a repeated window; the others go.
2. Equal segments are one reference: it keeps its smallest document. The words of references are
   fetched from that document's text alone.
3. References are dealt to shards by anchor. A task builds a suffix automaton over a shard's
   references in order of their documents, so each state knows the smallest document it occurs
   in, and streams the references through it for matching statistics. The states of 50 words or
   more give the first document of each window.
4. Each segment takes its reference's windows; those first seen in a smaller document are merged
   into maximal spans, and the spans are cut from the text.

An automaton over all references would grow with the corpus, so none is broadcast whole: a shard
holds at most ``SHARD`` references, and the segments it can match come to it. An anchor with more
references than ``HOT`` (a passage inserted in very many documents) would make a shard of its own;
its windows are spread by their own 128-bit fingerprints instead, with the same result.

A null text has no words. Rows that repeat a doc_id count as one document: what either of them
repeats of a smaller document is cut, at the same places, from both. Texts under 50 words stay
whole. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import (batches, by_group, drop, grams, mix, pieces, read_table, save, text_bytes,
                              word_bounds, word_hashes)

WINDOW, GRAM = 50, 12
# References in one automaton, about, and of one anchor before its windows are spread instead.
SHARD, HOT = 1000, 400
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def anchors(words: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each segment of the words of several rows.

    The anchor of a window is the lowest hash of its runs, wherever it lies in the window, so the
    same words give the same anchor in any document.
    """
    width = window - gram + 1
    if len(words) < window:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    low, reach = mix(grams(words, gram)), 1  # minima of stretches of twice the length each time
    while reach * 2 <= width:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    low = np.minimum(low[:len(words) - window + 1], low[width - reach:])
    at = np.flatnonzero(row[:len(low)] == row[window - 1:])  # windows that lie in one row
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    return low[at[first]], at[first], np.diff(np.append(first, len(at)))


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor, print, doc_id, start, n``: every segment with the fingerprint of its words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in pieces(whole):
                data, at = text_bytes(batch.column("text"))
                starts, ends, first = word_bounds(data, at)
                words, row = word_hashes(data, starts, ends), np.repeat(np.arange(len(at) - 1), np.diff(first))
                anchor, start, n = anchors(words, row, window, gram)
                if len(n):
                    yield batches({
                        "anchor": anchor.view(np.int64), "print": _prints(words, start, n + window - 1).view(np.int64),
                        "doc_id": batch.column("doc_id").take(pa.array(row[start])),
                        "start": (start - first[row[start]]).astype(np.int32), "n": n.astype(np.int32)})

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, print long, doc_id long, start int, n int")


def _prints(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the ``length`` words from each ``start``, by doubling."""
    out = mix(length.astype(np.uint64))
    level, size, at, left = words, 1, start.copy(), length.copy()
    while (left > 0).any():
        odd = (left // size) % 2 == 1
        out[odd] = mix(out[odd] * np.uint64(0x9E3779B97F4A7C15) + level[at[odd]])
        at[odd] += size
        left[odd] -= size
        level = mix(level[:-size] * np.uint64(0xBF58476D1CE4E5B9) + level[size:]) if len(level) > size else level[:0]
        size *= 2
    return out


class Automaton:
    """Suffix automaton of word sequences; a state keeps the first document it occurs in.

    Sequences are added in ascending order of their documents; no match runs over two of them.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, words: list[int], doc: int) -> None:
        step, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for word in words:
            old = step[last].get(word)
            if old is not None:
                if length[old] == length[last] + 1:
                    last = old
                    continue
                last = self._split(last, word, old)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            first.append(doc)
            link.append(0)
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = new
                at = link[at]
            if at >= 0:
                old = step[at][word]
                link[new] = old if length[old] == length[at] + 1 else self._split(at, word, old)
            last = new

    def _split(self, at: int, word: int, old: int) -> int:
        step, link, length = self.next, self.link, self.length
        copy = len(step)
        step.append(step[old].copy())
        length.append(length[at] + 1)
        self.first.append(self.first[old])
        link.append(link[old])
        link[old] = copy
        while at >= 0 and step[at].get(word) == old:
            step[at][word] = copy
            at = link[at]
        return copy

    def statistics(self, words: list[int], window: int) -> list[int]:
        """First document of the window that ends at each word from the ``window``-th on; -1 where
        no sequence holds it."""
        step, link, length = self.next, self.link, self.length
        state = matched = 0
        found = []
        for i, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state, matched = step[state][word], matched + 1
            while state and length[link[state]] >= window:  # the state of the last ``window`` words alone
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                found.append(self.first[state] if matched >= window else -1)
        return found


def _runs(first: np.ndarray) -> list[dict]:
    """Stretches of windows with the same first document."""
    cuts = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
    return [{"from": int(a), "to": int(b), "first": int(first[a])} for a, b in zip(cuts[:-1], cuts[1:])]


RUNS = "array<struct<from: int, to: int, first: bigint>>"


def match_shards(references: DataFrame, window: int, shards: int) -> DataFrame:
    """``anchor, print, runs`` of references ``anchor, print, doc_id, words``: the first document
    of each window, by one automaton per shard."""
    shape = pa.schema([("anchor", pa.int64()), ("print", pa.int64()), ("runs", pa.list_(pa.struct(
        [("from", pa.int32()), ("to", pa.int32()), ("first", pa.int64())])))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(rows, "shard"):
            automaton, texts = Automaton(), [np.frombuffer(w.as_py(), np.uint64).tolist() for w in table["words"]]
            for words, doc in zip(texts, table["doc_id"].to_pylist()):
                automaton.add(words, doc)
            runs = [_runs(np.array(automaton.statistics(words, window))) for words in texts]
            yield pa.RecordBatch.from_arrays([
                table["anchor"].combine_chunks(), table["print"].combine_chunks(),
                pa.array(runs, shape.field("runs").type)], schema=shape)

    dealt = references.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "anchor", "print").mapInArrow(
        run, f"anchor long, print long, runs {RUNS}")


def match_spread(references: DataFrame, window: int) -> DataFrame:
    """The same for hot anchors: windows meet by their fingerprints."""

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            words = [np.frombuffer(w.as_py(), np.uint64) for w in batch.column("words")]
            count = np.array([len(w) - window + 1 for w in words], np.int64)
            if not len(count):
                continue
            owner, flat = np.repeat(np.arange(len(count)), count), np.concatenate(words)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            place = at + owner * (window - 1) + np.repeat(np.cumsum(count) - count, count)
            size = np.full(len(place), window)
            yield batches({c: batch.column(c).take(pa.array(owner)) for c in ("anchor", "print", "doc_id")} | {
                "at": at.astype(np.int32), "a": _prints(flat, place, size).view(np.int64),
                "b": _prints(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), place, size).view(np.int64)})

    windows = save(references.mapInArrow(split, "anchor long, print long, doc_id long, at int, a long, b long"), "windows")
    first = save(windows.groupBy("a", "b").agg(F.min("doc_id").alias("first")), "first-windows")
    listed = windows.join(first, ["a", "b"]).groupBy("anchor", "print").agg(
        F.array_sort(F.collect_list(F.struct("at", "first"))).alias("w"))
    one = lambda x: F.struct(x["at"].alias("from"), (x["at"] + 1).cast("int").alias("to"), x["first"].alias("first"))
    return listed.select("anchor", "print", _joined(F.transform("w", one).cast(RUNS), lambda last, x: (
        last["first"] == x["first"]) & (last["to"] == x["from"]), ["first"]).alias("runs"))


def _joined(runs: Column, meets: Callable[[Column, Column], Column], kept: list[str]) -> Column:
    """Ordered stretches ``from, to`` with those joined that meet the one before; few are left, so the array that
    grows stays short."""
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
        last(acc)["from"].alias("from"), F.greatest(last(acc)["to"], x["to"]).alias("to"), *[x[c].alias(c) for c in kept])))
    return F.aggregate(runs, F.slice(runs, F.lit(1), F.lit(1)), lambda acc, x: F.when(
        meets(last(acc), x), grown(acc, x)).otherwise(F.concat(acc, F.array(x))))


def _spans(runs: Column, doc: Column, start: Column, window: int) -> Column:
    """Word ranges of a segment under windows that a smaller document has, joined, in order."""
    seen = F.filter(runs, lambda r: (r["first"] >= 0) & (r["first"] < doc))
    return _joined(F.transform(seen, lambda r: F.struct(
        (start + r["from"]).alias("from"), (start + r["to"] + (window - 1)).alias("to"))), lambda last, x: x["from"] <= last["to"], [])


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``doc_id, spans``: word ranges ``[from, to)`` to remove, merged and in order."""
    every = save(segments(docs, window, gram), "segments")
    shared = save(every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(
        "lo < hi").select("anchor"), "shared-anchors")
    live = save(every.join(shared, "anchor"), "shared-segments")
    drop(every)
    # the first document of each distinct segment, and how many distinct ones an anchor has
    distinct = save(live.groupBy("anchor", "print", "n").agg(F.min(F.struct("doc_id", "start")).alias("at")), "references")
    spread = save(distinct.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("anchor"), "hot-anchors")
    marked = distinct.join(spread.withColumn("hot", F.lit(True)), "anchor", "left").select(
        "anchor", "print", "n", "at.doc_id", "at.start", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = marked.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("anchor", "print", "n", "start", "hot")).alias("wanted"))
    # the list grows with the corpus: the same shuffled join at every size
    words = save(_words(docs.select("doc_id", "text").join(
        wanted.hint("merge"), docs["doc_id"] == wanted["_id"]), window), "reference-words")
    count = words.where("not hot").count()
    cold = match_shards(words.where("not hot"), window, max(1, -(-count // shard)))
    rare = match_spread(words.where("hot"), window)
    runs = save(cold.unionByName(rare), "reference-runs")
    drop(words)
    # one row a segment: its removable windows are joined within the array
    hits = live.join(runs, ["anchor", "print"]).select(
        "doc_id", _spans(F.col("runs"), F.col("doc_id"), F.col("start"), window).alias("spans")).where(F.size("spans") > 0)
    spans = hits.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    out = save(spans, "removals")
    for table in (shared, live, distinct, spread, runs):
        drop(table)
    return out


def _words(rows: DataFrame, window: int) -> DataFrame:
    """Word hashes of the wanted segments of each text. Where repeated ids carry different texts,
    only the text that has the segment gives its words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for batch in pieces(whole):
                data, at = text_bytes(batch.column("text"))
                starts, ends, first = word_bounds(data, at)
                hashes, out = word_hashes(data, starts, ends), []
                for doc, a, b, wanted in zip(batch.column("doc_id").to_pylist(), first[:-1], first[1:], batch.column("wanted").to_pylist()):
                    own = hashes[a:b]
                    for w in wanted:
                        cut = own[w["start"]:w["start"] + w["n"] + window - 1]
                        if len(cut) == w["n"] + window - 1 and _prints(
                                cut, np.zeros(1, np.int64), np.array([len(cut)])).view(np.int64)[0] == w["print"]:
                            out.append((w["anchor"], w["print"], doc, w["hot"], cut.tobytes()))
                if out:
                    yield batches(dict(zip(("anchor", "print", "doc_id", "hot", "words"), (
                        pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))))))

    return rows.select("doc_id", "text", "wanted").mapInArrow(
        run, "anchor long, print long, doc_id long, hot boolean, words binary")


def cut(docs: DataFrame, spans: DataFrame, passed: list[str]) -> DataFrame:
    """``row``, a struct of the ``passed`` columns of every row, with ``n_words``, ``n_removed`` and ``kept``, the
    kept words joined by one blank. Columns may have any names."""
    rows = docs.select(F.col("doc_id").alias("of"), F.struct(*dict.fromkeys(["text", *passed])).alias("row"))
    named = spans.select(F.col("doc_id").alias("at"), "spans")
    joined = rows.join(named.hint("merge"), F.col("of") == F.col("at"), "left").select("row", "spans")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            texts = whole.column("row").field("text")
            for batch in pieces(whole.append_column("text", texts)):
                out = []
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                    words = _WORDS.findall(text or "")
                    if not spans:
                        out.append((len(words), 0, " ".join(words)))
                        continue
                    keep = np.ones(len(words), bool)
                    for s in spans:
                        keep[s["from"]:s["to"]] = False
                    out.append((len(words), int((~keep).sum()), " ".join(w for w, k in zip(words, keep) if k)))
                n, removed, kept = zip(*out)
                row = batch.column("row")
                yield batches({
                    "row": pa.StructArray.from_arrays([row.field(c) for c in passed], names=passed), "n_words": pa.array(n, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    fields = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in passed)
    return joined.mapInArrow(run, f"row struct<{fields}>, n_words long, n_removed long, kept string")


def op9_substring(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return cut(docs, removals(docs), ["doc_id"]).select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def keep_unseen(docs: DataFrame) -> DataFrame:
    """Documents without the passages seen in a smaller one; columns as they came. A text that
    loses words keeps its other words joined by blanks; ``n_chars`` follows where it exists."""
    done = cut(docs, removals(docs), docs.columns)
    shorter = F.col("n_removed") > 0
    new = {"text": F.when(shorter, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(shorter, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM p),
r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_id FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM r WHERE first_id < doc_id),
g AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE
         list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(ks, k)), lambda k: ws[k]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id"""
