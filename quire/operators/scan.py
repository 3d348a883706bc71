"""Running aggregates and as-of lookups that stay whole when one key is very large."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_bucket"


def running(df: DataFrame, keys: list[str], order: list[str | Column],
            aggregates: dict[str, tuple[str, Column]], bucket: Column | None = None,
            inclusive: bool = True) -> DataFrame:
    """Running ``sum``, ``max``, ``min`` or ``last`` per key.

    ``order`` must be total, or rows it leaves equal must be equal in what is aggregated.
    ``bucket`` must be derived from the leading order column and never decrease with it. Each
    (key, bucket) is scanned on its own and the totals of earlier buckets are carried in through
    a join, so a key that holds a third of all rows is spread over its buckets. Null keys and
    positions are keys and positions like others.
    """
    upper = 0 if inclusive else -1
    if bucket is None:
        window = (Window.partitionBy(*keys).orderBy(*order)
                  .rowsBetween(Window.unboundedPreceding, upper))
        return df.select("*", *[_apply(kind, value).over(window).alias(name)
                                for name, (kind, value) in aggregates.items()])
    df = df.withColumn(_BUCKET, bucket)
    local = (Window.partitionBy(*keys, _BUCKET).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, upper))
    rows = df.select("*", *[_apply(kind, value).over(local).alias(f"_l_{name}")
                            for name, (kind, value) in aggregates.items()])
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    totals = df.groupBy(*keys, _BUCKET).agg(*[
        _total(kind, value, ordering).alias(f"_t_{name}")
        for name, (kind, value) in aggregates.items()])
    earlier = (Window.partitionBy(*keys).orderBy(_BUCKET)
               .rowsBetween(Window.unboundedPreceding, -1))
    carries = totals.select(
        *keys, _BUCKET,
        *[_apply(kind, F.col(f"_t_{name}")).over(earlier).alias(f"_c_{name}")
          for name, (kind, _) in aggregates.items()])
    same = [*keys, _BUCKET]
    carries = carries.withColumnsRenamed({c: f"_k_{c}" for c in same})
    joined = rows.join(carries, reduce(and_, [
        rows[c].eqNullSafe(carries[f"_k_{c}"]) for c in same]), "left")
    keep = [c for c in df.columns if c != _BUCKET]
    return joined.select(*keep, *[
        _combine(kind, F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name)
        for name, (kind, _) in aggregates.items()])


def _apply(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _total(kind: str, value: Column, ordering: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), ordering))
    return _apply(kind, value)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        both = F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        return F.when(carried.isNotNull() | local.isNotNull(), both)
    if kind == "last":
        return F.coalesce(local, carried)
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str,
         values: list[str], width: int | None = None) -> DataFrame:
    """Attach to each left row the values of the last right row at or before it.

    Both sides meet in one union ordered by position, so the cost is one sort and never the
    product of the sides. Positions keep the common type of both sides. Give ``width`` when one key can hold far more rows than a task
    should: positions are then scanned in ranges of that width.
    """
    payload = F.struct(*values)
    shape = right.select(payload.alias("_v")).schema["_v"].dataType
    lefts = left.select(
        *keys, F.col(left_on).alias("_pos"), F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_row"), F.lit(None).cast(shape).alias("_v"))
    empty = left.select(F.struct(*left.columns).alias("_row")).schema["_row"].dataType
    rights = right.select(
        *keys, F.col(right_on).alias("_pos"), F.lit(0).alias("_side"),
        F.lit(None).cast(empty).alias("_row"), payload.alias("_v"))
    bucket = F.floor(F.col("_pos") / width) if width else None
    # equal positions: right rows first, and among them the largest value wins
    found = running(lefts.unionByName(rights), keys, ["_pos", "_side", "_v"],
                    {"_seen": ("last", F.col("_v"))}, bucket)
    return found.where("_side = 1").select("_row.*", *[F.col(f"_seen.{v}").alias(v)
                                                        for v in values])
