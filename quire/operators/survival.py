"""Survival of texts inside others: probe windows, met by rolling hashes and verified at their places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import let, running_sum
from quire.functions.text import strip_bidi

LETTERS = "[A-Za-zÀ-ɏ]+"
# Steps of a text's windows that are affordable, and the characters that a needle is met by at most.
MOST_STEPS, GRAM = 2_000_000, 32
_BASE, _SLOTS = 0x9E3779B97F4A7C15, 1 << 22


def probe_windows(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """``key, place, probe``: from each token the shortest run of tokens with ``least`` letters.

    Every token has a letter, so a run has at most ``least`` tokens. Runs that end with the text
    before they have enough letters are left out.
    """
    def windows(tokens: Column) -> Column:
        before = running_sum(F.transform(tokens, lambda t: F.length(t)))

        def run(at: Column) -> Column:
            return F.transform(tokens, lambda t, i: F.struct(i.alias("place"), F.slice(tokens, i + 1, F.array_position(
                F.transform(F.slice(tokens, i + 1, F.lit(least)), lambda x, k: F.get(at, i + k) + F.length(x) - F.get(at, i) >= least),
                F.lit(True)).cast("int")).alias("w")))

        return let(before, run)

    tokens = F.regexp_extract_all(text, F.lit(LETTERS), 0)
    return df.select(key, F.explode(let(tokens, windows)).alias("p")).where(F.size("p.w") > 0).select(
        key, "p.place", F.array_join("p.w", " ").alias("probe"))


def distinct_probes(windows: DataFrame, key: str) -> DataFrame:
    """Each probe of a text once, at its first place."""
    return windows.groupBy(key, "probe").agg(F.min("place").alias("place"))


def probe_cost(df: DataFrame, key: str, text: str, least: int, most: int = MOST_STEPS) -> DataFrame:
    """``key, tokens, steps, admitted``: what the windows of a text would cost, from the lengths of its tokens alone.

    Steps are the tokens visited and the entries of all windows; a text that needs more than ``most`` is
    refused before any window is made. A null text has no tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, steps = [], []
            for sizes in batch.column("sizes"):
                sizes = np.zeros(0, np.int64) if sizes.values is None else sizes.values.to_numpy()
                upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                ends = np.searchsorted(upto, upto[:-1] + least)
                whole = np.flatnonzero(ends < len(upto))
                tokens.append(len(sizes))
                steps.append(len(sizes) + int((ends[whole] - whole).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(steps, pa.int64())], names=[key, "tokens", "steps"])

    sizes = F.transform(F.regexp_extract_all(text, F.lit(LETTERS), 0), lambda t: F.length(t))
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, sizes.alias("sizes")).mapInArrow(run, f"`{key}` {kind}, tokens long, steps long").withColumn(
        "admitted", F.col("steps") <= most)


def _rolled(text: str, size: int) -> np.ndarray:
    """Hash of the ``size`` characters, a power of two, from each place, by doubling."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    reach, factor = 1, _BASE
    while reach < size:
        h = h[:-reach] * np.uint64(factor) + h[reach:] if len(h) > reach else h[:0]
        h ^= h >> np.uint64(29)
        reach, factor = reach * 2, factor * factor % 2**64 | 1
    return h


def contained(hays: DataFrame, key: str, needles: DataFrame) -> DataFrame:
    """``key, needle``: which of ``needles(needle)`` stand in ``hays(key, hay)``, each once.

    Needles are met by the rolling hash of their first characters, as many as the shortest one has but ``GRAM`` at most. A bitmap
    of a fixed size over these hashes is tested at every place of a text, so only likely places leave the task, with the
    text that stands there; the rest of the needle is verified after an equality join. Null and empty needles and null
    texts are left out; repeated rows count once.
    """
    wanted = needles.select("needle").where("needle is not null and needle <> ''").distinct()
    sizes = wanted.agg(F.min(F.length("needle")), F.max(F.length("needle"))).first()
    kind = hays.schema[key].dataType.simpleString()
    if sizes[0] is None:
        return hays.select(key, F.lit("").alias("needle")).where(F.lit(False))
    gram, longest = 1 << (min(sizes[0], GRAM).bit_length() - 1), sizes[1]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(_rolled(n[:gram], gram)[0]) for n in batch.column("needle").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("needle"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["needle", "hash"])

    index = wanted.mapInArrow(code, "needle string, hash long")
    bits = np.zeros(_SLOTS // 64, np.int64)
    slot = F.pmod("hash", F.lit(_SLOTS))
    for row in index.groupBy(F.shiftright(slot, 6).alias("w")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {_SLOTS}) & 63 as int))")).alias("b")).collect():
        bits[row["w"]] = row["b"]
    flags = np.unpackbits(bits.view(np.uint8), bitorder="little")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, hay in zip(batch.column(0), batch.column("hay").to_pylist()):
                if not hay or len(hay) < gram:
                    continue
                hashes = _rolled(hay, gram)
                at = np.flatnonzero(flags[hashes & np.uint64(_SLOTS - 1)])
                if len(at):
                    near = dict.fromkeys((int(hashes[i].view(np.int64)), hay[i:i + longest]) for i in at)
                    codes, texts = zip(*near)
                    yield pa.RecordBatch.from_arrays([pa.array([owner.as_py()] * len(codes), batch.schema.field(0).type), pa.array(codes, pa.int64()),
                                                      pa.array(texts, pa.string())], names=[key, "hash", "near"])

    met = hays.select(key, "hay").mapInArrow(places, f"`{key}` {kind}, hash long, near string").join(index, "hash")
    return met.where(F.startswith("near", F.col("needle"))).select(key, "needle").distinct()


def surviving(items: DataFrame, item: str, docs: DataFrame, doc: str, text: str, least: int) -> DataFrame:
    """For each item and document that share a probe: how many of the item's probes the document
    holds. A window is fixed by its tokens, so a document holds a probe exactly if the tokens stand in it one after the other."""
    around = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    own = probe_windows(items, item, text, least).select(item, around(F.col("probe")).alias("needle")).distinct()
    hays = docs.select(doc, around(F.array_join(F.regexp_extract_all(text, F.lit(LETTERS), 0), " ")).alias("hay"))
    return contained(hays, doc, own).join(own, "needle").groupBy(item, doc).agg(F.count("*").alias("found"))


def order_votes(probes: DataFrame, item: str, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``item, doc, probes, forward, backward`` of every item and document that share a probe of ``item, probe`` in some order.

    Texts lose white space and bidi controls, probes their blanks. A probe votes forward if it stands in the text as it is and in no
    other order, backward if only its characters or its words are found in reverse; a reversal that equals the
    probe says nothing.
    """
    plain = F.replace("probe", F.lit(" "), F.lit(""))
    words = F.array_join(F.reverse(F.split("probe", " ")), "")
    forms = probes.select(item, "probe", F.explode(F.array(
        F.struct(F.lit(True).alias("as_is"), plain.alias("needle")), F.struct(F.lit(False).alias("as_is"), F.when(F.reverse(plain) != plain, F.reverse(plain)).alias("needle")),
        F.struct(F.lit(False).alias("as_is"), F.when(words != plain, words).alias("needle")))).alias("f")).select(item, "probe", "f.*").where("needle is not null").distinct()
    hays = docs.select(doc, F.regexp_replace(strip_bidi(F.col(text)), r"\s+", "").alias("hay"))
    seen = contained(hays, doc, forms).join(forms, "needle").groupBy(item, "probe", doc).agg(
        F.bool_or("as_is").alias("forward"), F.bool_or(~F.col("as_is")).alias("backward"))
    totals = probes.select(item, "probe").distinct().groupBy(item).agg(F.count("*").alias("probes"))
    return seen.groupBy(item, doc).agg(
        F.count_if(F.col("forward") & ~F.col("backward")).alias("forward"), F.count_if(F.col("backward") & ~F.col("forward")).alias("backward")).join(
        totals, item).select(item, doc, "probes", "forward", "backward")


def verdict(votes: DataFrame) -> DataFrame:
    """Adds ``verdict``: ``logical`` or ``visual`` by the greater number of votes, else ``inconclusive``; and
    ``gate``, what a check makes of it."""
    more = F.when(F.col("backward") > F.col("forward"), "visual").when(F.col("forward") > F.col("backward"), "logical").otherwise("inconclusive")
    return votes.withColumn("verdict", more).withColumn(
        "gate", F.when(F.col("verdict") == "logical", "passed").when(F.col("verdict") == "visual", "failed").otherwise("inconclusive"))
