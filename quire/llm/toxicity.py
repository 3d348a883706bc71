"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are positives; everything else is unlabelled, not negative. With the
class prior p, the risk of a classifier g is

    p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)])

whose second term estimates the risk on the unseen negatives; where it would fall below zero the
step goes against it, which keeps a flexible model from memorising the positives. Several linear
models, each from its own seed, are averaged.

Features are the distinct words of the whole text and their first letters, hashed to a fixed number
of weights. The same correction picks them: of a feature's rate in unlabelled text, the share that
the positives among it explain is taken off, and only features whose rate left for the negatives is
a small part of their rate in positives carry a weight. Labels, lang, source and doc_id are no
features. The model is fitted on a bounded sample of labelled rows (``MOST_POSITIVE``,
``MOST_UNLABELLED``), scoring covers every row.

A null or empty text has no features and gets the models' base score. With no confirmed toxic row
every score is 0. Repeated rows get repeated scores; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import batches, fold, pieces, read_table

WEIGHTS = 1 << 18
PREFIXES = (5, 7, 8)
# Bounds of the training sample: rows by hash of the id.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 9000
MODELS, ROUNDS, RATE, DECAY, MOMENTUM = 3, 300, 10.0, 2e-5, 0.9
# A feature needs so many positive rows, or this share of them, and at most this rate in the
# negatives relative to its rate in the positives.
LEAST_ROWS, LEAST_SHARE, MOST_RATIO = 3, 0.004, 0.05
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
# Words kept per Python worker; when full, the table starts anew.
KEPT = 200_000


class Slots(dict):
    """Weight indices of a word: one of itself, others of its first letters."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = [zlib.crc32(b"w" + word.encode()) % WEIGHTS]
        found += [zlib.crc32(b"p" + word[:n].encode()) % WEIGHTS for n in PREFIXES if len(word) >= n]
        if len(self) >= KEPT:
            self.clear()
        self[word] = slots = tuple(found)
        return slots


def features(text: str | None, slots: Slots) -> np.ndarray:
    """Sorted distinct weight indices of a text."""
    words = set(_WORD.findall((text or "").lower()))
    found = {i for w in words for i in slots[w]}
    return np.fromiter(found, np.int32, len(found))


def feature_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the weight indices of each text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for whole in rows:
            for batch in pieces(whole):
                yield batches({
                    "doc_id": batch.column("doc_id"),
                    "slots": pa.array([features(t, slots) for t in batch.column("text").to_pylist()],
                                      pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, slots array<int>")


class Sparse:
    """Rows of feature indices laid end to end, for products with a weight vector."""

    def __init__(self, index: np.ndarray, row: np.ndarray, n: int, width: int):
        self.index, self.row, self.n, self.width = index, row, n, width

    @classmethod
    def of(cls, rows: pa.Table) -> Sparse:
        lists = rows["slots"].combine_chunks()
        return cls(lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), len(lists), WEIGHTS)

    def only(self, live: np.ndarray) -> Sparse:
        """The same rows with the features ``live`` alone, numbered by their place in it."""
        held = np.isin(self.index, live)
        return Sparse(np.searchsorted(live, self.index[held]), self.row[held], self.n, len(live))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index], minlength=self.n)

    def gradient(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, each[self.row], minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def choose(pos: Sparse, unl: Sparse, prior: float) -> np.ndarray:
    """Sorted weight indices of the features that may carry a weight."""
    counts = pos.gradient(np.ones(pos.n))
    in_pos, in_unl = counts / pos.n, unl.gradient(np.ones(unl.n)) / max(unl.n, 1)
    in_neg = (in_unl - prior * in_pos) / max(1 - prior, 1e-9)
    enough = counts >= max(LEAST_ROWS, LEAST_SHARE * pos.n)
    return np.flatnonzero(enough & (in_neg <= MOST_RATIO * in_pos))


def fit(pos: Sparse, unl: Sparse, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and base of one model: momentum steps down the corrected logistic risk."""
    weights, base = np.random.default_rng(seed).normal(0, 0.1, pos.width), -1.0
    speed, base_speed = np.zeros(pos.width), 0.0
    for _ in range(ROUNDS):
        gp, gu = pos.times(weights) + base, unl.times(weights) + base
        # derivative of log(1 + exp(-g)) is -sigmoid(-g); of log(1 + exp(g)) it is sigmoid(g)
        as_pos = -prior * _sigmoid(-gp) / max(pos.n, 1)
        neg_p, neg_u = prior * _sigmoid(gp) / max(pos.n, 1), _sigmoid(gu) / max(unl.n, 1)
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        on_pos, on_unl = (as_pos - neg_p, neg_u) if rest >= 0 else (neg_p, -neg_u)
        speed = MOMENTUM * speed - RATE * (pos.gradient(on_pos) + unl.gradient(on_unl) + DECAY * weights)
        base_speed = MOMENTUM * base_speed - RATE / 5 * (on_pos.sum() + on_unl.sum())
        weights, base = weights + speed, base + base_speed
    return weights, base


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and base, fitted on labelled rows outside the held-out fold. Of repeated ids the largest
    label and the first text in order count; a null label is none."""
    learn = labels.where(fold("doc_id", 4) != 2).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = learn.agg(F.count("*"), F.sum("toxic")).first()
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    chosen = learn.where("toxic = 1").orderBy(order).limit(MOST_POSITIVE).unionByName(
        learn.orderBy(order).limit(MOST_UNLABELLED).withColumn("toxic", F.lit(0)))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # the bounded sample travels as Arrow data and is never a list of Python numbers
    rows = feature_rows(sample.groupBy("doc_id").agg(F.min("text").alias("text"))).join(
        F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "slots").toArrow().sort_by(
        [("doc_id", "ascending"), ("toxic", "ascending")])
    pos = Sparse.of(rows.filter(pc.equal(rows["toxic"], 1)))
    unl = Sparse.of(rows.filter(pc.equal(rows["toxic"], 0)))
    if not pos.n:
        return np.zeros(WEIGHTS, np.float32), -40.0
    prior = counts[1] / counts[0]
    live = choose(pos, unl, prior)
    narrow = pos.only(live), unl.only(live)
    models = [fit(*narrow, prior, seed) for seed in range(MODELS)]
    weights = np.zeros(WEIGHTS, np.float32)
    weights[live] = np.mean([w for w, _ in models], axis=0)
    return weights, float(np.mean([b for _, b in models]))


def score(docs: DataFrame, weights: np.ndarray, base: float, passed: tuple[str, ...] = ("doc_id",),
          keep: bool = False) -> DataFrame:
    """The ``passed`` columns, ``score`` and ``predicted`` of every row; the weights have a fixed
    size. With ``keep`` only the rows that are not predicted toxic, without the two columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, own = Slots(), shared.value
        for whole in rows:
            for batch in pieces(whole):
                totals = np.array([
                    own[features(t, slots)].sum(dtype=np.float64) for t in batch.column("text").to_pylist()])
                found = _sigmoid(totals + base)
                if keep:
                    yield batch.filter(pa.array(found < THRESHOLD))
                else:
                    yield batches({c: batch.column(c) for c in passed} | {
                        "score": found, "predicted": (found >= THRESHOLD).astype(np.int32)})

    if keep:
        return docs.mapInArrow(run, docs.schema)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)
    return docs.select(*dict.fromkeys([*passed, "text"])).mapInArrow(run, f"{schema}, score double, predicted int")


def keep_clean(docs: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that a model fitted on the labelled texts of ``corpus`` doesn't predict to
    be toxic; columns as they came."""
    return score(docs, *train(corpus, labels), keep=True)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    scored = score(docs, *train(docs, read_table(spark, folder, "labels")))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
