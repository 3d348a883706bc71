"""Packing of tokenised documents into fixed windows by minimum bin slack.

A document of n ids is cut into whole windows and one remainder. Which remainders share a window
depends only on how many there are of each length, a table of at most ``capacity - 1`` counts
however large the corpus is. For the longest length left, a bitset subset-sum finds the multiset
of lengths that fills its window closest to capacity; backtracking gives the count of each
length, and the pattern is used as often as the counts allow. Documents then take their places
by their rank among the remainders of their length.

Rows are ranked in hash buckets of documents, so a length that a third of all documents share is
spread over the buckets. Equal rows are interchangeable. A null text counts as empty; it still
has the closing id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.bpe import Encoder, Runs, default_vocabulary
from quire.llm.shared import batches, pieces, read_table, save

CAPACITY = 1024
# A separator of ids closes every document.
CLOSING = np.zeros(1, "<u4").tobytes()

@functools.lru_cache(maxsize=2)
def runs(vocabulary: str) -> Runs:
    """Ids by the public rank-file library, for the same vocabulary; its merges are the same."""
    import tiktoken

    own = Encoder(vocabulary)
    ranks = {b: i for i, b in own.strings.items() if i not in own.special.values()}
    ids = tiktoken.Encoding("byte-level", pat_str=own.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Runs(lambda run: np.array(ids.encode_ordinary(run), "<u4").tobytes(), own.special)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n, crcs``: ids of each document with the closing one, and the CRC-32 of the ids
    of each whole window and of the remainder."""
    vocabulary = vocabulary or default_vocabulary()

    def tokenise(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step = runs(vocabulary), 4 * capacity
        for whole in rows:
            for batch in pieces(whole):
                sizes, crcs = [], []
                for text in batch.column("text").to_pylist():
                    data = memoryview(own.encode(text) + CLOSING)
                    sizes.append(len(data) // 4)
                    crcs.append([zlib.crc32(data[i:i + step]) for i in range(0, len(data), step)])
                yield batches({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()),
                                   "crcs": pa.array(crcs, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(tokenise, "doc_id long, n long, crcs array<long>")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to ``room`` without exceeding it.

    Bit s of ``reach`` says that some multiset sums to s. Lengths enter longest first, counts in
    powers of two; the search ends early once ``room`` itself is reached.
    """
    reach, trail, all_bits = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            trail.append((reach, length, take))
            reach |= reach << (length * take) & all_bits
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(trail):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Places for remainders: rows (length, first rank, copies per window, first window, offset
    of the first copy), and the number of windows."""
    left = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows, windows = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fill(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[length] // copies for length, copies in pattern.items())
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], copies, windows, offset))
            offset += length * copies
            used[length] += copies * times
            left[length] -= copies * times
            if not left[length]:
                del left[length]
        windows += times
    return rows, windows


def pack(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place the pieces of ``doc_id, n, crcs``; one row per piece. Reads its input twice, so
    hand it a written table."""
    spark = tokens.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tokens.select(
        "*", (F.col("n") % capacity).cast("int").alias("rest"),
        F.floor(F.col("n") / capacity).cast("bigint").alias("wholes"),
        F.pmod(F.xxhash64("doc_id", "n"), F.lit(spread)).cast("int").alias("bucket"))
    sums = rows.groupBy("rest", "bucket").agg(
        F.count("*").alias("docs"), F.sum("wholes").alias("all_wholes"))
    # at most ``capacity`` rows, whatever the corpus
    lengths = sums.groupBy("rest").agg(F.sum("docs"), F.sum("all_wholes")).collect()
    places, windows = plan({r[0]: r[1] for r in lengths if r[0]}, capacity)
    whole_base, first = np.zeros(capacity, np.int64), windows
    for rest, _, wholes in sorted(lengths):
        whole_base[rest], first = first, first + wholes
    order = np.array(sorted(places), dtype=np.int64).reshape(-1, 5)

    earlier = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        "rest", "bucket",
        F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("all_wholes").over(earlier), F.lit(0)).alias("wholes_before"))
    within = Window.partitionBy("rest", "bucket").orderBy("doc_id", "n", "crcs")
    ranked = rows.select(
        "*", F.row_number().over(within).alias("place"),
        (F.sum("wholes").over(within.rowsBetween(Window.unboundedPreceding, 0))
         - F.col("wholes")).alias("wholes_here"))
    placed = ranked.join(carried, ["rest", "bucket"]).select(
        "doc_id", "n", "crcs", "rest", "wholes",
        (F.col("docs_before") + F.col("place") - 1).alias("rank"),
        (F.col("wholes_before") + F.col("wholes_here")).alias("whole_rank"))
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")

    def assign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = order[:, 0] * (1 << 50) + order[:, 1]
        for batch in source:
            if not batch.num_rows:
                continue
            get = {c: batch.column(c).to_numpy(zero_copy_only=False)
                   for c in ("n", "rest", "wholes", "rank", "whole_rank")}
            rest, n = get["rest"].astype(np.int64), get["n"]
            count = get["wholes"] + (rest > 0)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            tail = piece == get["wholes"][doc]
            sequence = whole_base[rest[doc]] + get["whole_rank"][doc] + piece
            offset = np.zeros(len(doc), np.int64)
            if tail.any():
                own = doc[tail]
                at = np.searchsorted(key, rest[own] * (1 << 50) + get["rank"][own], "right") - 1
                length, begin, copies, window, base = order[at].T
                nth = get["rank"][own] - begin
                sequence[tail] = window + nth // copies
                offset[tail] = base + nth % copies * length
            yield batches({
                "doc_id": batch.column("doc_id").take(pa.array(doc)), "start": piece * capacity,
                "length": np.where(tail, rest[doc], capacity),
                "ids_crc32": batch.column("crcs").flatten(), "doc_tokens": n[doc],
                "sequence_id": sequence, "offset": offset})

    return placed.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenise every whole text once, then pack."""
    return pack(save(token_pieces(docs, capacity, vocabulary), "token-pieces"), capacity)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read_table(spark, folder, "documents"))
