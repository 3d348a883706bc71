"""Mixing sources to target weights by exact cuts in a random order.

Every document gets a hash-random key. Documents are range-sorted by source and key, and a
distributed prefix sum gives the words that stand before each one in its source. A source's budget is
its target, rounded to whole words. It takes whole epochs of the source as long as they fit and then
cuts the order exactly where the budget ends; the document at the cut is taken in part.

Sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1 and so on. A target stops at ``most``
times its source; what exceeds that is shared again by weight. The stopped sources are those with the
least words per weight, so one more prefix sum, over the sources in that order, finds all targets at
once: a source stops if its share of what the earlier ones leave is no less than its limit.

A null text has no words and takes nothing; a null source is a source like others. A null doc_id
counts as an empty number for the key. Rows that repeat a doc_id are documents of their own; equal
rows share the places they hold in the order among them. A source without words has the target 0.
Other columns are ignored, an empty table gives an empty result, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.prefix import attach, scan
from quire.llm.shared import read_table, save

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 100, 3, 12
_WIDE = "decimal(38,0)"


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, key``: words of each whole text, and its random place."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), number).cast("binary")).alias("key"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target, budget`` of sources ``source, source_size``, one row each.

    ``target`` is exact up to one division; ``budget`` is its whole number of words.
    """
    ranked = scan(sources.withColumn("one", F.lit(1).cast("bigint")), [], [F.asc_nulls_last("source")], {"one": "sum"}, "source-ranks")
    at = F.col("before_one") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (at + 1).cast("int"))
    unit = 1
    for w in weights:
        unit *= w
    priced = ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("limit")).withColumn(
        "per_weight", F.col("source_size").cast(_WIDE) * (F.lit(unit) / F.col("weight")).cast("bigint"))
    placed = scan(priced, [], [F.col("per_weight"), F.asc_nulls_last("source")], {"limit": "sum", "weight": "sum"}, "source-limits")
    whole = placed.agg(F.floor(F.sum(F.col("source_size").cast(_WIDE)) * share / 100).cast(_WIDE).alias("all"),
                       F.sum("weight").alias("weights"))
    left = F.col("all") - F.col("before_limit")
    # stopped: limit <= weight * left / weights left, in whole numbers
    judged = placed.crossJoin(F.broadcast(whole)).withColumn(  # one row
        "stopped", F.col("limit").cast(_WIDE) * (F.col("weights") - F.col("before_weight")) <= F.col("weight") * left)
    rest = judged.agg(
        F.max("all").alias("all"), F.sum(F.when(F.col("stopped"), F.col("limit")).otherwise(0).cast(_WIDE)).alias("spent"),
        F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).alias("sharing"))
    shared = (F.col("weight") * (F.col("r.all") - F.col("spent"))).cast("double") / F.col("sharing").cast("double")
    target = F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(shared)
    return judged.drop("all").crossJoin(F.broadcast(rest.alias("r"))).select(  # one row
        "source", "source_size", target.alias("target"), F.least(F.col("limit"), F.floor(target + 0.5).cast("bigint")).alias("budget"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, key, source_size, target, taken, epochs``: the words the mix takes of
    each document, and how often it takes it whole."""
    rows = save(keyed(docs, seed), "mix-keys")
    placed = scan(rows, ["source"], [F.col("key"), F.asc_nulls_first("doc_id"), F.col("size")], {"size": "sum"}, "mix-order")
    sources = save(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    planned = save(targets(sources, weights, share, most), "mix-targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("bigint")
    cut = F.least(F.col("size"), F.greatest(F.lit(0).cast("bigint"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before_size")))
    return attach(placed, planned, ["source"]).withColumn("epochs", full).withColumn(
        "taken", F.col("epochs") * F.col("size") + cut).select(
        "doc_id", "source", "size", "key", "source_size", "target", "taken", "epochs")


def texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``doc_id, epoch, words``: the mix itself, a row for each time a document is taken, with the words taken.

    Documents are met by id and key, so ``docs`` must not repeat a doc_id.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    plan = mixed.where("taken > 0").select(F.col("doc_id").alias("_id"), "size", "taken", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.ceil(F.col("taken") / F.col("size")) - 1)).alias("epoch"))
    joined = docs.select("doc_id", "text").join(plan, F.col("doc_id").eqNullSafe(F.col("_id")))
    part = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")).cast("int")
    return joined.select("doc_id", "epoch", F.slice(words, F.lit(1), part).alias("words"))


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(read_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
      FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
             coalesce(sum(3 * source_size) OVER (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
             coalesce(sum(w) OVER (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM s),
j AS (SELECT *, cap * (ws - wb) <= w * (total - cb) AS stopped FROM o),
t AS (SELECT source, source_size, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE CAST(w * (total - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
             / CAST(sum(CASE WHEN stopped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target, cap FROM j),
b AS (SELECT *, least(cap, CAST(floor(target + 0.5) AS BIGINT)) AS budget FROM t),
p AS (SELECT d.*, b.source_size, b.target, b.budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
       + least(size, greatest(0, budget - budget // source_size * source_size - before)) END AS BIGINT) AS taken FROM p"""
