"""Reconciliation: expectations against evidence, as sums over whole tables.

Two sides are put together and summed by key, so null keys are keys that equal each other, repeated rows
are counted, and a key that holds a third of all rows is pre-aggregated where it is read. An empty side
lacks every key of the other. Where a result names further columns, inputs may have any others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scan import running


def _sides(keys: list[str], **tables: DataFrame) -> DataFrame:
    """Every key of the tables with the number of rows each one has for it, as ``_<name>``."""
    parts = [t.select(*keys, *[F.lit(int(n == name)).cast("bigint").alias(f"_{n}") for n in tables]) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in tables])


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys with no evidence, each once."""
    return _sides(keys, e=expected, f=found).where("_e > 0 and _f = 0").select(*keys)


def set_equal(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side that lacks them."""
    return _sides(keys, e=expected, a=actual).where("_e = 0 or _a = 0").select(
        *keys, F.when(F.col("_e") == 0, "unexpected").otherwise("missing").alias("status"))


def bad_names(df: DataFrame, column: str, most_bytes: int) -> DataFrame:
    """Names that are blank, too long, hold control characters or occur more than once."""
    counted = df.groupBy(column).agg(F.count("*").alias("rows"))
    fault = (F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", "blank")
             .when(F.octet_length(column) > most_bytes, "too-long")
             .when(F.col(column).rlike(r"[\x00-\x1f\x7f]"), "control")
             .when(F.col("rows") > 1, "repeated"))
    return counted.withColumn("fault", fault).where("fault is not null")


def coverage(expected: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """``missing``, ``covered`` or ``repeated`` for each expected key by its number of claims, and
    ``unknown`` for claims of no expected key."""
    status = (F.when(F.col("_w") == 0, "unknown").when(F.col("_c") == 0, "missing")
              .when(F.col("_c") == 1, "covered").otherwise("repeated"))
    return _sides([key], w=expected, c=claims).select(key, F.col("_c").alias("claims"), status.alias("status"))


def reciprocal(ab: DataFrame, ba: DataFrame, a: str, b: str) -> DataFrame:
    """Relations that only one direction states."""
    return _sides([a, b], l=ab, r=ba).where("_l = 0 or _r = 0").select(
        a, b, F.when(F.col("_l") == 0, "backward").otherwise("forward").alias("only"))


def relations(ab: DataFrame, ba: DataFrame, a: str, b: str, known_a: DataFrame, known_b: DataFrame) -> DataFrame:
    """``a, b, forward, backward, state`` of every relation that ``ab(a, <b>s)`` or ``ba(b, <a>s)`` states, whose second
    columns are arrays of ids.

    ``dangling`` if an end is not known, else ``one-sided`` if a direction lacks it, else ``repeated`` if a
    direction states it more than once, else ``mutual``. Both tables are exploded once and summed
    together; known ids join the sums. A null array states nothing; a null id is never known.
    """
    left = ab.select(a, F.explode(ab.columns[1]).alias(b))
    right = ba.select(F.explode(ba.columns[1]).alias(a), b)
    summed = _sides([a, b], f=left, r=right)
    ka, kb = (k.select(F.col(k.columns[0]).alias(c)).distinct().withColumn(f"_k{c}", F.lit(True)) for k, c in ((known_a, a), (known_b, b)))
    state = (F.when(F.col(f"_k{a}").isNull() | F.col(f"_k{b}").isNull(), "dangling").when((F.col("_f") == 0) | (F.col("_r") == 0), "one-sided")
             .when((F.col("_f") > 1) | (F.col("_r") > 1), "repeated").otherwise("mutual"))
    return summed.join(ka, a, "left").join(kb, b, "left").select(
        a, b, F.col("_f").alias("forward"), F.col("_r").alias("backward"), state.alias("state"))


def scope_matrix(dims: list[DataFrame], cells: DataFrame, keys: list[str]) -> DataFrame:
    """Required cells, the combinations of small dimension tables, against reported ones."""
    required = dims[0]
    for d in dims[1:]:  # a handful of rows each
        required = required.crossJoin(F.broadcast(d))
    status = (F.when(F.col("_r") == 0, "unexpected").when(F.col("_c") == 0, "missing")
              .when(F.col("_c") == 1, "once").otherwise("repeated"))
    return _sides(keys, r=required.distinct(), c=cells).select(*keys, F.col("_c").alias("reports"), status.alias("status"))


def sequence_contract(events: DataFrame, scope: str, sequence: str) -> DataFrame:
    """Per scope: number of events, and whether sequences are 0, 1, 2, ... without gap or repeat."""
    return events.groupBy(scope).agg(
        F.count("*").alias("n"), F.min(sequence).alias("lo"), F.max(sequence).alias("hi"),
        F.countDistinct(sequence).alias("distinct")).select(
        scope, "n", ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("distinct") == F.col("n"))).alias("ordered"))


def event_contract(events: DataFrame, first: int = 1, width: int = 1024) -> DataFrame:
    """``scope, id, faults`` of events ``scope, id, parent, sequence, passed``: what each event's place breaks.

    - ``duplicate``: the scope has the id more than once.
    - ``gap``: the sequence before it is missing in the scope; the first is ``first``.
    - ``orphan``: its parent has no event in the scope; a null parent is the scope's owner.
    - ``early``: its parent comes at the same place or later.
    - ``failed``: an event of the id did not pass; null counts as not passed.

    Of repeated ids the first place and parent count. The place of the parent is joined to that of the
    child; sequences are scanned in ranges of ``width``, so a scope with very many events is spread. Events with a null scope,
    id or sequence can't be placed and are left out.
    """
    one = events.where("scope is not null and id is not null and sequence is not null").groupBy("scope", "id").agg(
        F.min_by("parent", F.struct("sequence", "parent")).alias("parent"), F.min("sequence").alias("sequence"), F.count("*").alias("_n"),
        F.bool_and(F.coalesce("passed", F.lit(False))).alias("_passed"))
    steps = one.select("scope", "sequence").distinct()
    before = running(steps, ["scope"], ["sequence"], {"_b": ("max", F.col("sequence"))}, F.floor(F.col("sequence") / width), inclusive=False)
    above = one.select("scope", F.col("id").alias("parent"), F.col("sequence").alias("_p"))
    placed = one.join(before, ["scope", "sequence"]).join(above, ["scope", "parent"], "left")
    faults = {"duplicate": F.col("_n") > 1, "gap": F.col("sequence") > F.coalesce(F.col("_b"), F.lit(first - 1)) + 1,
              "orphan": F.col("parent").isNotNull() & F.col("_p").isNull(), "early": F.col("_p") >= F.col("sequence"), "failed": ~F.col("_passed")}
    return placed.select("scope", "id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in faults.items()])).alias("faults"))


def latest_attempt(jobs: DataFrame, name: Column, attempt: list[str]) -> DataFrame:
    """The last attempt of each case-insensitive name, how many rows the name has, and whether it is
    ``refused``: a generation that comes twice leaves open which row is its result, even an old one."""
    rest = [c for c in jobs.columns if c not in attempt]
    once = jobs.withColumn("_key", F.lower(name)).groupBy("_key", *attempt).agg(
        F.max(F.struct(*rest)).alias("_rest"), F.count("*").alias("_n"))
    top = once.groupBy("_key").agg(F.max(F.struct(*attempt, "_rest")).alias("_b"), F.sum("_n").alias("attempts"), (F.max("_n") > 1).alias("refused"))
    return top.select(F.col("_key").alias("key"), "attempts", "refused", *[F.col(f"_b.{c}").alias(c) for c in attempt],
                      *[F.col(f"_b._rest.{c}").alias(c) for c in rest])


def worst_of(required: DataFrame, results: DataFrame, group: list[str], key: str, state: str) -> DataFrame:
    """Worst state per group over its required items; an item without result counts as error."""
    rank = F.create_map(*[F.lit(x) for pair in (("success", 0), ("pending", 1), ("failure", 2), ("error", 3)) for x in pair])
    names = F.array(*map(F.lit, ("success", "pending", "failure", "error")))
    joined = required.join(results.select(*group, key, state), [*group, key], "left")
    return joined.groupBy(*group).agg(F.max(F.coalesce(rank[F.col(state)], F.lit(3))).alias("_w")).select(
        *group, F.element_at(names, F.col("_w") + 1).alias("worst"))


def stale(approvals: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Approvals whose value is no longer the current one, or whose key is gone."""
    now = current.select(key, F.col(value).alias("_now"))
    return approvals.join(now, key, "left").where(~F.col(value).eqNullSafe(F.col("_now"))).select(
        key, F.when(F.col("_now").isNull(), "gone").otherwise("changed").alias("reason"))


def crosswalk(items: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """One independent state column per source: its state for the item, else ``not-performed``; a
    source that has several states for a key is ``ambiguous`` there. Each key once."""
    out = items.select(key).distinct()
    for name, table in sources.items():
        one = table.groupBy(key).agg(F.when(F.count_distinct("state") > 1, "ambiguous").otherwise(F.max("state")).alias(name)).withColumnRenamed(key, "_k")
        out = out.join(one, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit("not-performed")))
    return out


def placed(df: DataFrame, group: str, order: list[str], width: int = 1024) -> DataFrame:
    """Adds ``ordinal``, from one, and ``n`` of each ordered sequence. The first order column, a number, is scanned
    in ranges of ``width``, so a sequence with very many rows is spread; rows that the order leaves equal may come in any order."""
    counted = running(df.withColumn("_one", F.lit(1)), [group], order, {"ordinal": ("sum", F.col("_one"))}, F.floor(F.col(order[0]) / width)).drop("_one")
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"))
    return counted.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
