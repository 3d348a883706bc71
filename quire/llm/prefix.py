"""Running totals over a table of any size, and lookups that no frequent key slows down.

Rows are range-sorted, so a key with many rows lies in several neighbouring partitions. Each
partition is scanned once as a stream; what a key has in earlier partitions is carried in from one
summary row per partition. Nothing but these summaries, as many as there are partitions, reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import save

_FOLD = {"sum": (np.add.accumulate, np.subtract), "xor": (np.bitwise_xor.accumulate, np.bitwise_xor)}


def _starts(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """Whether each row begins a key; nulls are equal to each other."""
    new = np.zeros(batch.num_rows, bool)
    for key in keys:
        column = batch.column(key)
        if batch.num_rows > 1:
            a, b = column.slice(1), column.slice(0, batch.num_rows - 1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            new[1:] |= differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    new[0] = last is not None and tuple(batch.column(k)[0].as_py() for k in keys) != last
    return new


def scan(rows: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, str], name: str) -> DataFrame:
    """``rows`` with ``before_<v>`` for each long column of ``values``, which names ``sum`` or ``xor``: what the earlier rows
    of the same key give together; 0 for the first row.

    Rows that ``keys`` and ``order`` leave equal may come in any order. ``_part`` stays, the number
    of the range a row lies in, for ``attach``. Values must not be null; no keys means one group.
    An empty table stays empty.
    """
    source = rows.columns
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # lets equal rows lie in several ranges
    by = [*[F.asc_nulls_last(k) for k in keys], *order, F.col("_tie")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, head = TaskContext.get().partitionId(), 0, None, True
        carry = dict.fromkeys(values, np.int64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, keys, last)
            begins, segment = np.flatnonzero(new), np.cumsum(new)
            out = {c: batch.column(c) for c in source}
            out["_part"] = pa.array(np.full(batch.num_rows, part, np.int32))
            out["_at"] = pa.array(np.arange(at, at + batch.num_rows))
            out["_head"] = pa.array(head & (segment == 0))
            for v, kind in values.items():
                accumulate, inverse = _FOLD[kind]
                x = batch.column(v).to_numpy(zero_copy_only=False)
                upto = accumulate(x)
                before = inverse(upto, x)
                base = np.concatenate([[inverse(np.int64(0), carry[v])], before[begins]])
                out[f"before_{v}"] = pa.array(inverse(before, base[segment]))
                carry[v] = inverse(upto[-1], base[-1])
            head, at = head and not len(begins), at + batch.num_rows
            last = tuple(batch.column(k)[-1].as_py() for k in keys)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in source)
    added = ", ".join(f"before_{v} long" for v in values)
    placed = save(tied.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        run, f"{schema}, _part int, _at long, _head boolean, {added}"), name)
    carried = _carried(placed, keys, values)
    joined = placed.join(F.broadcast(carried), "_part", "left")  # one row per partition
    plus = lambda v: F.col(f"_c_{v}").bitwiseXOR(F.col(f"before_{v}")) if values[v] == "xor" else F.col(f"_c_{v}") + F.col(f"before_{v}")
    return joined.select(*source, "_part", *[
        F.when(F.col("_head"), plus(v)).otherwise(F.col(f"before_{v}")).alias(f"before_{v}") for v in values])


def _carried(placed: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """``_part, _c_<v>``: what the first key of each partition has in the partitions before."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    ends = placed.groupBy("_part").agg(
        F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last"), F.bool_and("_head").alias("single"),
        *[F.max_by(F.struct(F.col(f"before_{v}").alias("b"), F.col(v).alias("x")), "_at").alias(f"_l_{v}") for v in values])
    found, before, held = [], None, dict.fromkeys(values, 0)
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):
        joins = before is not None and before == row["first"]
        carry = held if joins else dict.fromkeys(values, 0)
        found.append((row["_part"], *[carry[v] for v in values]))
        held = {v: _joined(kind, row[f"_l_{v}"]["b"], row[f"_l_{v}"]["x"]) for v, kind in values.items()}
        if row["single"]:
            held = {v: _joined(kind, carry[v], held[v]) for v, kind in values.items()}
        before = row["last"]
    schema = "_part int, " + ", ".join(f"_c_{v} long" for v in values)
    return placed.sparkSession.createDataFrame(found, schema)


def _joined(kind: str, a: int, b: int) -> int:
    return a ^ b if kind == "xor" else a + b


def attach(rows: DataFrame, info: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The columns of ``info``, one row a key, joined to ``rows`` that carry ``_part``.

    ``info`` first meets the distinct pairs of key and range, then the rows by these pairs, so a
    key with very many rows is met in each of its ranges apart. Null keys meet null keys.
    """
    def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        named = right.withColumnsRenamed({k: f"_k_{k}" for k in on})
        return left.join(named, reduce(and_, [left[k].eqNullSafe(named[f"_k_{k}"]) for k in on]), how).drop(
            *[f"_k_{k}" for k in on])

    pairs = rows.select(*keys, "_part").distinct()
    return meet(rows, meet(pairs, info, keys), [*keys, "_part"])
