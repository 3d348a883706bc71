"""Language identification by Bayesian evidence fusion.

The posterior of a page's language multiplies four kinds of evidence:

* text: a multinomial model of byte trigrams, one per language, counted over every document whose
  language is stated; neighbouring trigrams overlap, so a text counts for at most ``TEXT_WEIGHT``
  independent ones;
* the language that the markup declares, right with probability ``DECLARED_RIGHT``;
* the address suffix, and
* the host: counts of the languages found by text and markup, grouped per host, per suffix and over
  all pages. A host's prior is smoothed with its suffix's, that with the prior of all, and a page's
  own vote is taken out of its host's counts.

Counts are sums, so they combine before the shuffle; host counts are joined back from a written
table, and a host with a third of all pages can be split by the join.

A page without letters has no text evidence; a null address has no host and takes the prior of all;
null or unknown declarations say nothing. With no stated language anywhere the language is null.
Repeated rows get repeated results (each counts in its host); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import batches, pieces, read_table, save, text_bytes

SLOTS = 1 << 16
# Bytes of text whose trigrams are in memory at once.
SLICE = 1 << 20
TEXT_WEIGHT, DECLARED_RIGHT = 40.0, 0.9
HOST_SMOOTHING, SUFFIX_SMOOTHING = 8.0, 50.0
# fixed values: address suffixes of no country that are told apart; others share one entry
GENERIC = ("com", "org", "net", "edu", "gov", "info", "biz", "name", "mil", "int", "museum", "wiki")
# A document is rejected when all evidence contradicts the stated language this surely, and the
# text by this margin, which only texts that are nearly all in another language reach.
CERTAIN, MARGIN = 0.99, 100.0


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Slot and row of every byte trigram that lies in one text."""
    data, at = text_bytes(column)
    n = len(at) - 1
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    wide = data.astype(np.uint32)
    slot = (wide[:-2] * np.uint32(40503) + wide[1:-1] * np.uint32(1031) + wide[2:] * np.uint32(7)) % np.uint32(SLOTS)
    row = np.repeat(np.arange(n), np.diff(at))
    same = row[2:] == row[:-2]
    return slot[same].astype(np.int64), row[:-2][same], n


def letters(text: Column) -> Column:
    """Lower-case text whose runs of other characters are single blanks."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles, head, navigation, comments and tags."""
    hidden = r"(?is)<(script|style|head|nav)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"
    return F.regexp_replace(html, hidden, " ")


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of each slot, counted over all rows with a language.

    The result has a fixed size per language: counts are summed per partition, then by key.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in rows:
            for batch in pieces(whole, most=SLICE):
                slot, row, _ = _trigrams(batch.column("text"))
                langs, code = np.unique(np.array(batch.column("lang").to_pylist(), dtype=str), return_inverse=True)
                if not len(langs):
                    continue
                found = np.bincount(code[row] * SLOTS + slot, minlength=len(langs) * SLOTS).reshape(-1, SLOTS)
                for lang, counts in zip(langs, found):
                    sums[lang] = sums.get(lang, 0) + counts
        for lang, counts in sums.items():
            live = np.flatnonzero(counts)
            yield batches({"lang": pa.array([lang] * len(live)), "slot": live.astype(np.int32), "n": counts[live]})

    counted = docs.where("lang is not null").select("lang", letters(F.col("text")).alias("text")).mapInArrow(
        count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    languages, code = np.unique(np.array(rows["lang"].to_pylist(), dtype=str), return_inverse=True)
    table = np.full((len(languages), SLOTS), 0.5)
    table[code, rows["slot"].to_numpy()] += rows["n"].to_numpy()
    return languages.tolist(), np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(table: DataFrame, model: np.ndarray) -> DataFrame:
    """Adds ``evidence``, the log likelihood of each language; ``text`` is consumed."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in table.columns if c != "text"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for whole in rows:
            for batch in pieces(whole, most=SLICE):
                slot, row, n = _trigrams(batch.column("text"))
                count = np.bincount(row, minlength=n)
                weight = np.minimum(count, TEXT_WEIGHT) / np.maximum(count, 1)
                found = np.stack([np.bincount(row, each[slot], minlength=n) * weight for each in logs], axis=1)
                yield batches({c: batch.column(c) for c in kept} | {"evidence": pa.array(list(found), pa.list_(pa.float64()))})

    schema = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in kept)
    return table.mapInArrow(run, f"{schema}, evidence array<double>")


def _posterior(logs: Column) -> Column:
    """Probabilities from log scores."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def _sums(rows: DataFrame, keys: list[str], width: int, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.get("vote", F.lit(i))) for i in range(width)]).alias(name))


def identify(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """Fuse the evidence of rows ``id, text, declared, suffix, host``; other columns stay.

    Adds ``language``, ``probability``, ``text_language``, ``probabilities`` (one for each language,
    in their order) and ``margin``, by how much the text alone favours its language over the
    declared one.
    """
    width = len(languages)
    if not width:
        return rows.drop("text").select(
            "*", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("string").alias("text_language"), F.array().cast("array<double>").alias("probabilities"),
            F.lit(None).cast("double").alias("margin"))
    named = F.array(*map(F.lit, languages))
    said = F.array(*[
        F.when(F.col("declared").isin(languages), F.log(F.when(F.col("declared") == lang, DECLARED_RIGHT).otherwise(
            (1 - DECLARED_RIGHT) / max(width - 1, 1)))).otherwise(0.0) for lang in languages])
    own = text_evidence(rows, model).withColumn("own", F.zip_with("evidence", said, lambda a, b: a + b))
    votes = save(own.withColumn("vote", _posterior(F.col("own"))), "language-votes")
    hosts = save(_sums(votes.where("host is not null"), ["host"], width, "host_votes"), "hosts")
    # at most 26 * 26 country suffixes and the generic ones, see ``page_rows``
    suffixes = F.broadcast(_sums(votes, ["suffix"], width, "suffix_votes"))
    everything = _sums(votes, [], width, "v").first()[0] or [0.0] * width
    whole = np.array([v or 0.0 for v in everything]) + 1.0
    prior = F.array(*[F.lit(float(p)) for p in whole / whole.sum()])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    none = F.array(*[F.lit(0.0)] * width)
    joined = votes.join(hosts, "host", "left").join(suffixes, "suffix", "left").withColumns({
        "host_votes": F.zip_with(F.coalesce("host_votes", none), F.when(F.col("host").isNotNull(), F.col("vote")).otherwise(none),
                                 lambda a, b: F.greatest(a - b, F.lit(0.0))),
        "suffix_votes": F.coalesce("suffix_votes", none)})
    by_suffix = F.zip_with(
        F.transform("suffix_votes", lambda x: x / (total(F.col("suffix_votes")) + SUFFIX_SMOOTHING)),
        F.transform(prior, lambda x: x * SUFFIX_SMOOTHING / (total(F.col("suffix_votes")) + SUFFIX_SMOOTHING)),
        lambda a, b: a + b)
    joined = joined.withColumn("by_suffix", by_suffix)
    by_host = F.zip_with("host_votes", "by_suffix", lambda a, b: (a + HOST_SMOOTHING * b) / (
        total(F.col("host_votes")) + HOST_SMOOTHING))
    fused = joined.withColumn("by_host", by_host).withColumn(
        "probabilities", _posterior(F.zip_with("own", "by_host", lambda a, b: a + F.log(F.greatest(b, F.lit(1e-12))))))
    best = F.array_max("probabilities")
    lang_at = lambda values, top: F.element_at(named, F.array_position(values, top).cast("int"))
    return fused.select(
        *[c for c in rows.columns if c != "text"],
        lang_at(F.col("probabilities"), best).alias("language"), best.alias("probability"),
        lang_at(F.col("evidence"), F.array_max("evidence")).alias("text_language"), "probabilities",
        (F.array_max("evidence") - F.get("evidence", F.array_position(named, F.col("declared")).cast("int") - 1)).alias("margin"))


def page_rows(pages: DataFrame) -> DataFrame:
    """``id, text, declared, suffix, host`` of ``page_id, url, html``."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    last = F.substring_index(host, ".", -1)
    suffix = F.when(last.rlike("^[a-z]{2}$") | last.isin(*GENERIC), last).otherwise("")
    return pages.select(
        F.col("page_id").alias("id"), letters(page_text(F.coalesce("html", F.lit("")))).alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"), suffix.alias("suffix"), host.alias("host"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    languages, model = fit(read_table(spark, folder, "documents"))
    found = identify(page_rows(read_table(spark, folder, "pages")), languages, model)
    return found.select(F.col("id").alias("page_id"), "language", "probability", "declared", "host", "text_language")


def keep_documents(docs: DataFrame) -> DataFrame:
    """Documents whose text does not contradict their stated language; columns as they came.

    ``source`` plays the host. A text without letters gives no evidence and is kept. Only ids and
    a hash travel with the evidence; the texts are read again and pass an anti join.
    """
    languages, model = fit(docs)
    mark = F.xxhash64("text", "lang", "source")
    rows = docs.select(
        F.col("doc_id").alias("id"), mark.alias("mark"), letters(F.coalesce("text", F.lit(""))).alias("text"),
        F.lower("lang").alias("declared"), F.lit("").alias("suffix"), F.col("source").alias("host"))
    found = identify(rows, languages, model)
    wrong = (F.col("language") != F.col("declared")) & (F.col("probability") >= CERTAIN) & (F.col("margin") >= MARGIN)
    rejected = save(found.where(wrong).select(
        F.col("id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "other-language")
    return docs.join(rejected, (docs["doc_id"] == rejected["_id"]) & (mark == rejected["_mark"]), "left_anti")
