"""Content identity and change: fingerprints, deduplication with attribution, diffs and gates.

Texts are hashed where they are scanned; only keys and hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scan import running


def fingerprint(df: DataFrame, body: str) -> DataFrame:
    """Adds ``size`` in bytes and ``sha256`` of a body; equal bytes are equal in both."""
    return df.withColumn("size", F.octet_length(body)).withColumn("sha256", F.sha2(F.col(body), 256))


def bodies(df: DataFrame, key: str, body: str) -> DataFrame:
    """One row per distinct body: its first key and how many rows share it."""
    return fingerprint(df.select(key, body), body).groupBy("sha256", "size").agg(
        F.min(key).alias("first_key"), F.count("*").alias("occurrences"))


def collisions(df: DataFrame, body: str) -> DataFrame:
    """Hashes that stand for different bytes; empty unless the hash broke."""
    other = F.xxhash64(body)
    return df.select(F.sha2(F.col(body), 256).alias("sha256"), other.alias("x"), F.octet_length(body).alias("size")).groupBy(
        "sha256").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("size").alias("a"), F.max("size").alias("b"),
                      F.count("*").alias("rows")).select("sha256", "rows", ((F.col("lo") != F.col("hi")) | (F.col("a") != F.col("b"))).alias("collides"))


def _both(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, a, b, in_a, in_b``: the largest value of each side by key; null keys equal each other."""
    part = lambda t, side: t.select(
        key, *[F.when(F.lit(s == side), F.struct(F.col(value).alias("v"))).alias(f"_{s}") for s in "ab"])
    return part(before, "a").unionByName(part(after, "b")).groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).select(
        key, F.col("_a.v").alias("a"), F.col("_b.v").alias("b"), F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``added``, ``removed``, ``changed`` or ``same`` for every key of either snapshot. A null key is a key; of
    rows that repeat a key in a snapshot the largest value counts; null values are equal."""
    status = (F.when(~F.col("in_a"), "added").when(~F.col("in_b"), "removed")
              .when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed"))
    return _both(before, after, key, value).select(key, status.alias("status"))


def derived_collisions(df: DataFrame, key: str, derived: Column) -> DataFrame:
    """Rows whose derived name another key derives as well, with how many keys share it."""
    named = df.select(key, derived.alias("name"))
    shared = named.groupBy("name").agg(F.count("*").alias("keys")).where("keys > 1")
    return named.join(shared, "name")


def apply_patch(units: DataFrame, patches: DataFrame, address: list[str], batch: str) -> DataFrame:
    """Units ``batch, *address, text`` with the patches ``batch, *address, expected, text`` applied.

    A duplicate address, a missing address or a stale expectation refuses the whole batch: its
    units stay as they are and ``refused`` says so.
    """
    keys = [batch, *address]
    counted = patches.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("expected").alias("_expected"), F.min("text").alias("_new"))
    known = units.select(*keys, F.col("text").alias("_old"))
    refused = counted.join(known, keys, "left").groupBy(batch).agg(F.max(
        (F.col("_n") > 1) | ~F.coalesce(F.col("_old") == F.col("_expected"), F.lit(False))).alias("refused"))
    return units.join(counted.select(*keys, "_new"), keys, "left").join(refused, batch, "left").select(
        *keys, F.when(F.col("refused") | F.col("_new").isNull(), F.col("text")).otherwise(F.col("_new")).alias("text"),
        (F.col("_new").isNotNull() & ~F.coalesce("refused", F.lit(False))).alias("patched"),
        F.coalesce("refused", F.lit(False)).alias("refused"))


def review_gate(assets: DataFrame, reviews: DataFrame, key: str, flagged: Column) -> DataFrame:
    """``clear`` where nothing is flagged, ``reviewed`` where an accepting review names the very
    hash, ``stale`` where one names another hash, else ``open``."""
    known = reviews.groupBy(key).agg(F.collect_set("sha256").alias("_seen"))
    state = (F.when(~flagged, "clear").when(F.array_contains("_seen", F.col("sha256")), "reviewed")
             .when(F.col("_seen").isNotNull(), "stale").otherwise("open"))
    return assets.join(known, key, "left").select(key, state.alias("state"))


def admit_budget(df: DataFrame, group: list[str], order: list[str], size: str, most: int, width: int | None = None) -> DataFrame:
    """Rows with ``total``, the running size in order, and ``admitted``: every row up to the first
    that exceeds the budget; the rest is refused, not dropped.

    ``order`` should be total. With ``width`` the first order column, a number, is scanned in ranges of that width,
    so a group that holds a third of all rows is spread. A null size adds nothing; null groups are groups.
    """
    bucket = F.floor(F.col(order[0]) / width) if width else None
    summed = running(df, group, order, {"total": ("sum", F.coalesce(F.col(size), F.lit(0)).cast("bigint"))}, bucket)
    return summed.withColumn("admitted", F.col("total") <= most)


def merge_revisions(known: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """Both tables by key: the known value stays; another observed value is a conflict. A null key is
    a key; a null value on either side is no conflict."""
    return _both(known, observed, key, value).select(
        key, F.coalesce("a", "b").alias(value), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("conflict"))
