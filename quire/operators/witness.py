"""Evidence contracts: who claims what, in which scope, with what outcome.

Each contract is one sum per key over the tables put together, so null keys are keys, repeated rows are
counted and a key with very many rows is pre-aggregated where it is read. Each key gets the first state that applies, in the
order stated. Empty tables give no keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _together(keys: list[str], tables: dict[str, DataFrame], **values: Column) -> DataFrame:
    """All tables as one, a missing column null, summed by key."""
    columns = sorted({c for t in tables.values() for c in t.columns} - set(keys))
    kinds = {c: t.schema[c].dataType for t in tables.values() for c in t.columns}
    parts = [t.select(*keys, *[F.col(c) if c in t.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns], F.lit(n).alias("_from"))
             for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])


def _rows(table: str) -> Column:
    return F.count_if(F.col("_from") == table)


def proven(expected: DataFrame, claims: DataFrame) -> DataFrame:
    """``key, scope, claims, state`` of ``expected(key, scope)`` against ``claims(key, scope, passed, clean)``.

    ``unknown``: claimed, not expected there. ``missing``: no claim in the scope. ``unproven``: none of the claims passed
    and was clean. ``repeated``: more than one did. ``covered``: exactly one did. Null outcomes prove nothing.
    """
    good = F.coalesce(F.col("passed") & F.col("clean"), F.lit(False))
    summed = _together(["key", "scope"], {"e": expected.select("key", "scope"), "c": claims.select("key", "scope", "passed", "clean")},
                       wanted=_rows("e"), claims=_rows("c"), proofs=F.count_if((F.col("_from") == "c") & good))
    state = (F.when(F.col("wanted") == 0, "unknown").when(F.col("claims") == 0, "missing").when(F.col("proofs") == 0, "unproven")
             .when(F.col("proofs") > 1, "repeated").otherwise("covered"))
    return summed.select("key", "scope", "claims", state.alias("state"))


def coverage_map(units: DataFrame, mapped: DataFrame) -> DataFrame:
    """``id, state`` of source units ``id, place`` against a map ``id, target, place, retained``.

    ``unknown``: mapped, no unit. ``repeated``: mapped or stated more than once. ``missing``: not mapped. ``moved``: mapped at another
    place. ``retained``: kept as it is, which needs no target. ``empty``: a blank target. ``covered`` otherwise.
    """
    at = lambda t, c: F.max(F.when(F.col("_from") == t, F.col(c)))
    summed = _together(["id"], {"u": units.select("id", "place"), "m": mapped.select("id", "target", "place", "retained")},
                       units=_rows("u"), maps=_rows("m"), here=at("u", "place"), there=at("m", "place"), target=at("m", "target"), retained=at("m", "retained"))
    state = (F.when(F.col("units") == 0, "unknown").when((F.col("units") > 1) | (F.col("maps") > 1), "repeated").when(F.col("maps") == 0, "missing")
             .when(~F.col("here").eqNullSafe(F.col("there")), "moved").when(F.coalesce("retained", F.lit(False)), "retained")
             .when(F.trim(F.coalesce("target", F.lit(""))) == "", "empty").otherwise("covered"))
    return summed.select("id", state.alias("state"))


def receipts(runs: DataFrame, found: DataFrame) -> DataFrame:
    """``nonce, state`` of ``runs(nonce, arguments)`` against receipts ``nonce, arguments, completed, code``.

    ``stray``: a receipt of no run. ``none``: a run without one. ``several``: more than one, or a nonce used twice. ``unbound``: for
    other arguments. ``unfinished``: not completed. ``failed``: a code that is not 0. ``accepted`` otherwise. Arguments are
    compared by their 256-bit digest where they are read.
    """
    hashed = lambda t: t.withColumn("arguments", F.sha2(F.col("arguments").cast("string").cast("binary"), 256))
    at = lambda t, c: F.max(F.when(F.col("_from") == t, F.col(c)))
    summed = _together(["nonce"], {"r": hashed(runs.select("nonce", "arguments")), "f": hashed(found.select("nonce", "arguments", "completed", "code"))},
                       runs=_rows("r"), receipts=_rows("f"), asked=at("r", "arguments"), told=at("f", "arguments"), completed=at("f", "completed"), code=at("f", "code"))
    state = (F.when(F.col("runs") == 0, "stray").when(F.col("receipts") == 0, "none").when((F.col("receipts") > 1) | (F.col("runs") > 1), "several")
             .when(~F.col("asked").eqNullSafe(F.col("told")), "unbound").when(~F.coalesce("completed", F.lit(False)), "unfinished")
             .when(F.coalesce(F.col("code") != 0, F.lit(True)), "failed").otherwise("accepted"))
    return summed.select("nonce", state.alias("state"))


def membership(checks: DataFrame, passed: DataFrame, events: DataFrame) -> DataFrame:
    """``scope, witness, checks, state`` of the ids that ``checks(scope, witnesses)`` name, against ``passed(scope, id)`` and ``events(scope, id)``.

    ``twice``: the scope has the id in both populations, or more than once in one. ``absent``: no scope has it. ``foreign``: only
    other scopes do. ``member`` otherwise. Ids that no check names are left out; a check without witnesses names none.
    """
    named = checks.select("scope", F.explode("witnesses").alias("id"))
    held = {"p": passed.select("scope", "id"), "e": events.select("scope", "id")}
    here = _together(["scope", "id"], {"c": named, **held}, checks=_rows("c"), have=_rows("p") + _rows("e")).where("checks > 0")
    anywhere = held["p"].unionByName(held["e"]).select(F.col("id").alias("_id")).distinct().withColumn("_known", F.lit(True))
    state = (F.when(F.col("have") > 1, "twice").when(F.col("have") == 1, "member").when(F.col("_known"), "foreign").otherwise("absent"))
    return here.join(anywhere, F.col("id").eqNullSafe(F.col("_id")), "left").select("scope", F.col("id").alias("witness"), "checks", state.alias("state"))


def scanner_agreement(reports: DataFrame, findings: DataFrame, most: int = 100_000) -> DataFrame:
    """``report, n, state`` of ``reports(report, code)`` against ``findings(report, rule, line)``.

    ``unknown``: findings of no report. ``malformed``: a row without a rule or with a line below 1. ``too-many``: more than ``most`` rows.
    ``contradiction``: code 0 with findings, 1 without, or two codes for one report. ``error``: another code. ``clean`` or ``found`` otherwise.
    """
    bad = F.coalesce((F.trim("rule") == "") | (F.col("line") < 1), F.lit(True)) & (F.col("_from") == "f")
    summed = _together(["report"], {"r": reports.select("report", "code"), "f": findings.select("report", "rule", "line")},
                       reports=_rows("r"), n=_rows("f"), bad=F.count_if(bad), low=F.min("code"), high=F.max("code"))
    state = (F.when(F.col("reports") == 0, "unknown").when(F.col("bad") > 0, "malformed").when(F.col("n") > most, "too-many")
             .when((F.col("low") != F.col("high")) | (F.col("low") == 0) & (F.col("n") > 0) | (F.col("low") == 1) & (F.col("n") == 0), "contradiction")
             .when(F.coalesce(~F.col("low").isin(0, 1), F.lit(True)), "error").when(F.col("low") == 0, "clean").otherwise("found"))
    return summed.select("report", "n", state.alias("state"))


def census(baseline: DataFrame, mapping: DataFrame, platform: str) -> DataFrame:
    """``id, state`` of ``baseline(id)`` against ``mapping(id, target, platforms)``; a target stands for one id.

    ``unknown``: mapped, not in the baseline. ``duplicate``: mapped more than once. ``pending``: not mapped or without a target. ``shared``: the
    target of another id as well. ``unavailable``: limited to other platforms; an empty or null list allows all. ``placed`` otherwise.
    """
    uses = mapping.where("target is not null").groupBy(F.col("target").alias("_t")).agg(F.count_distinct("id").alias("ids")).where("ids > 1")
    marked = mapping.join(uses, F.col("target") == F.col("_t"), "left").select(
        "id", "target", F.col("_t").isNotNull().alias("shared"),
        (F.coalesce(F.size("platforms"), F.lit(0)) <= 0).alias("free"), F.array_contains("platforms", platform).alias("own"))
    summed = _together(["id"], {"b": baseline.select("id"), "m": marked}, base=_rows("b"), maps=_rows("m"), target=F.max("target"), shared=F.max("shared"),
                       allowed=F.max(F.coalesce(F.col("free") | F.col("own"), F.lit(False))))
    state = (F.when(F.col("base") == 0, "unknown").when(F.col("maps") > 1, "duplicate").when(F.col("target").isNull(), "pending")
             .when(F.col("shared"), "shared").when(~F.col("allowed"), "unavailable").otherwise("placed"))
    return summed.select("id", state.alias("state"))
