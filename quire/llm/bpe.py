"""Byte-level BPE: encoding and decoding with the merge table of a public tokenizer.

A word's bytes become a doubly linked list of symbols. A priority queue holds the rank of every
adjacent pair that can merge; the lowest rank is merged first, and an entry whose symbols have
changed since it was queued is stale and skipped. Decoding concatenates vocabulary strings.

A null text counts as empty and gives no ids. Ids outside the vocabulary raise an error.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import batches, pieces, read_table

# Words kept per Python worker in each of two generations; a full one becomes the old one, and old
# words move to the new one when they are asked for again. It bounds memory, not results.
KEPT_WORDS = 150_000
# Words longer than this many characters are encoded each time and not kept.
KEPT_BYTES = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others
    take code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


class Kept(dict):
    """Ids of strings as bytes of 32-bit integers, made by ``make`` when first asked for."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder(Kept):
    """Ids of words; encodes a word when it is first asked for."""

    # fixed value: the published pattern that splits text before merging
    PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in stated["model"]["vocab"]}
        ids = stated["model"]["vocab"]
        self.strings: dict[int, bytes] = {ids[t]: b for t, b in raw.items()}
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.strings |= {i: t.encode() for t, i in self.special.items()}
        self.single = [ids[next(c for c, b in letters.items() if b == byte)] for byte in range(256)]
        merges = (m if isinstance(m, list) else m.split(" ") for m in stated["model"]["merges"])
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        self.merged = [whole for _, _, whole in merges]
        ranks: dict[int, dict[int, int]] = {}
        for rank, (left, right, _) in enumerate(merges):
            ranks.setdefault(left, {})[right] = rank
        # rank of a symbol and the one to its right, and of two bytes that begin as symbols
        self.rank = [ranks.get(i, {}).get for i in range(1 + max(ids.values()))]
        self.byte_rank = [self.rank[a](b, -1) for a in self.single for b in self.single]
        self.split = regex.compile(self.PATTERN).findall

    def make(self, word: str) -> bytes:
        return array("i", self.merge(word.encode("utf-8"))).tobytes()

    def merge(self, data: bytes) -> list[int]:
        """Symbols of a word. ``at`` holds the rank of the pair that begins at each living symbol;
        a queue entry is a rank and a place in one number, stale once that place has another rank."""
        n, first = len(data), self.byte_rank
        symbol = [self.single[b] for b in data]
        at = [first[a << 8 | b] for a, b in zip(data, data[1:])]
        bits = n.bit_length()
        mask = (1 << bits) - 1
        queue = [r << bits | i for i, r in enumerate(at) if r >= 0]
        heapq.heapify(queue)
        at.append(-1)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        pop, push, rank, merged = heapq.heappop, heapq.heappush, self.rank, self.merged
        while queue:
            entry = pop(queue)
            i, r = entry & mask, entry >> bits
            if at[i] != r:
                continue  # stale: one of the two has been merged since
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            whole = symbol[i] = merged[r]
            symbol[j] = at[j] = -1
            r = at[i] = rank[whole](symbol[k], -1) if k < n else -1
            if r >= 0:
                push(queue, r << bits | i)
            h = before[i]
            if h >= 0:
                r = at[h] = rank[symbol[h]](whole, -1)
                if r >= 0:
                    push(queue, r << bits | h)
        return [s for s in symbol if s >= 0]

    def run_ids(self, run: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(run)))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


# fixed value: the white space of the published pattern
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Runs(Kept):
    """Ids of a run of visible characters with the blank before it, as bytes. Such a run never
    shares a token with the next one, so its ids can be kept whole."""

    def __init__(self, run_ids: Callable[[str], bytes], special: dict[str, int]):
        super().__init__()
        self.make, self.special = run_ids, special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split
        self.runs = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}]|\\Z)|[{WHITE}]").findall

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text; a special token's own string becomes its id."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.runs(text)))
        return b"".join(
            self.special[p].to_bytes(4, "little") if p in self.special
            else b"".join(map(self.__getitem__, self.runs(p))) for p in self.cut(text))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def merged_runs(path: str) -> Runs:
    own = encoder(path)
    return Runs(own.run_ids, own.special)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every document, each text whole.

    Texts travel to Python in Arrow batches and ids travel back, a few megabytes at a time;
    nothing is shuffled. An empty table gives an empty result, repeated rows give repeated
    results, other columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merged_runs(vocabulary)
        for whole in rows:
            for batch in pieces(whole):
                found = [own.encode(t) for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32) // 4
                yield batches({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``; null ids give an empty text, and bytes that are no UTF-8 the
    replacement character."""
    vocabulary = vocabulary or default_vocabulary()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for whole in rows:
            for batch in pieces(whole, "ids"):
                texts = ["" if r.values is None else own.decode(r.values.to_numpy())
                         for r in batch.column("ids")]
                yield batches({"doc_id": batch.column("doc_id"), "ids": batch.column("ids"),
                               "decoded": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: encoded and decoded from the ids in one pass, so that ids travel once."""
    vocabulary = vocabulary or default_vocabulary()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, strings = merged_runs(vocabulary), encoder(vocabulary)
        for whole in rows:
            for batch in pieces(whole):
                found = [own.encode(t) for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32) // 4
                ids = np.frombuffer(b"".join(found), "<i4")
                yield batches({
                    "doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                    "decoded": pa.array([strings.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = round_trip(read_table(spark, folder, "documents"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
