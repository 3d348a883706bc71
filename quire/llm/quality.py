"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Statistics come from byte classes, word hashes and line hashes, for a few megabytes of texts at a
time. Their values are binned by quantiles; each tree grows level by level from histograms of
gradients. The trees are complete and lie in flat arrays (feature, threshold, value), so a batch
walks all trees at once by index arithmetic.

Labels, lang, source and doc_id are no inputs. The model is fitted on at most ``MOST_ROWS``
labelled rows; scoring covers every row. A null text counts as empty and is scored like one. With
no labelled row every score is 0.5. Repeated rows get repeated scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import batches, fold, grams, pieces, read_table, text_bytes, word_bounds, word_hashes

# Bound of the training sample: labelled rows by hash of the id.
MOST_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, SMOOTH = 80, 4, 48, 0.15, 4.0, 1.0
THRESHOLD = 0.3

# byte classes whose share of all bytes is a statistic
CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A),
    "wide": range(0x80, 0x100), "symbol": b"#*$%&|<>{}[]^~_=+@\\/", "bang": b"!?", "stop": b".;:",
    "comma": b",", "bar": b"|", "newline": b"\n", "quote": b"\"'`",
}
NAMES = [*CLASSES, "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words",
         "repeat_grams", "log_lines", "repeat_lines", "line_words", "capital_words", "symbol_words",
         "one_letter_words"]


def _distinct(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each row."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])])
    return np.bincount(r[new], minlength=n).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    data, at = text_bytes(column)
    n, size = len(at) - 1, np.diff(at).astype(float)
    share = lambda count, of: count / np.maximum(of, 1)

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    found = []
    for members in CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        found.append(share(per_row(table[data]), size))
    starts, ends, first = word_bounds(data, at)
    words = np.diff(first).astype(float)
    row = np.repeat(np.arange(n), np.diff(first))
    hashes, length = word_hashes(data, starts, ends), ends - starts
    three = grams(hashes, 3)
    inside = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    three, three_row = three[inside], row[:len(three)][inside]
    n_three = np.bincount(three_row, minlength=n).astype(float)
    cuts = np.flatnonzero(data == 0x0A)
    line_from = np.sort(np.concatenate([at[:-1], cuts + 1]))
    line_row = np.clip(np.searchsorted(at, line_from, "right") - 1, 0, max(n - 1, 0))
    line_to = np.minimum(np.concatenate([line_from[1:], at[-1:]]), at[line_row + 1] if n else 0)
    held = np.searchsorted(starts, line_to) - np.searchsorted(starts, line_from)
    full = held > 0
    lines = np.bincount(line_row[full], minlength=n).astype(float)
    line_hash = word_hashes(data, line_from[full], line_to[full])
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    head = data[starts]
    symbols = np.zeros(256, bool)
    symbols[list(CLASSES["symbol"]) + list(CLASSES["bang"])] = True
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    by_word = lambda mask: share(np.bincount(row[mask], minlength=n), words)
    found += [
        np.log1p(size), np.log1p(words), share(np.bincount(row, length, minlength=n), words), longest,
        share(_distinct(hashes, row, n), words), share(n_three - _distinct(three, three_row, n), n_three),
        np.log1p(lines), share(lines - _distinct(line_hash, line_row[full], n), lines), share(words, lines),
        by_word((head >= 0x41) & (head <= 0x5A)), by_word(symbols[tail]), by_word(length == 1)]
    return np.stack(found, axis=1)


class Trees(NamedTuple):
    """Complete trees in flat arrays: inner node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        at = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.value[tree, at - inner].sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting with the logistic loss."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    feature, threshold = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf)
    value, margin = np.zeros((TREES, leaves)), np.full(n, base)
    for t in range(TREES):
        p = _sigmoid(margin)
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            count, first = 2 ** level, 2 ** level - 1
            best = np.full(count, 1e-9)
            cut_bin = np.full(count, BINS)
            for f in range(width):
                key = node * BINS + binned[f]
                g = np.bincount(key, slope, count * BINS).reshape(count, BINS).cumsum(1)
                h = np.bincount(key, curve, count * BINS).reshape(count, BINS).cumsum(1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = (g ** 2 / (h + SMOOTH) + (g_all - g) ** 2 / (h_all - h + SMOOTH)
                        - g_all ** 2 / (h_all + SMOOTH))
                gain[(h < LEAST / 4) | (h_all - h < LEAST / 4)] = -1
                top = gain.argmax(1)
                better = gain[np.arange(count), top] > best
                for k in np.flatnonzero(better & (top < len(cuts[f]))):
                    best[k], cut_bin[k] = gain[k, top[k]], top[k]
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][top[k]]
            chosen = feature[t, first + node]
            node = 2 * node + (binned[chosen, np.arange(n)] > cut_bin[node])
        g, h = np.bincount(node, slope, leaves), np.bincount(node, curve, leaves)
        value[t] = RATE * g / (h + SMOOTH)
        margin += value[t][node]
    return Trees(feature, threshold, value, base)


def statistic_rows(docs: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in pieces(whole):
                found = statistics(batch.column("text"))
                yield batches({"doc_id": batch.column("doc_id"), "x": pa.array(list(found), pa.list_(pa.float64()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Fit on labelled rows outside the held-out fold; returns the scorer of a table. Of repeated ids
    the largest label and the first text in order count; a null label is none."""
    chosen = labels.where(fold("doc_id", 5) != 0).where("quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality")).orderBy(F.xxhash64(F.lit("quality"), "doc_id")).limit(MOST_ROWS)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    rows = statistic_rows(sample.groupBy("doc_id").agg(F.min("text").alias("text"))).join(F.broadcast(chosen), "doc_id").orderBy(
        "doc_id").select("quality", "x").collect()
    if not rows:
        flat = np.zeros((1, 2 ** DEPTH - 1))
        return lambda table: score(table, Trees(flat.astype(int), flat, np.zeros((1, 2 ** DEPTH)), 0.0))
    model = fit(np.array([r.x for r in rows]), np.array([r.quality for r in rows], float))
    return lambda table: score(table, model)


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in pieces(whole):
                found = _sigmoid(model.margin(statistics(batch.column("text"))))
                yield batches({"doc_id": batch.column("doc_id"), "score": found,
                               "predicted": (found >= THRESHOLD).astype(np.int32)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    scored = train(docs, read_table(spark, folder, "labels"))(docs)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
