"""Array helpers that stay inside one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda variable is bound to a computed value, so neither the optimizer nor an
    enclosing lambda can make the expression run again per use.
    """
    return F.transform(F.array(value), body)[0]


def _blocked(values: Column, fold: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Exclusive running fold of an array in blocks.

    Growing an accumulator array element by element copies it every time; folding at most
    ``BLOCK`` elements per position and one carry per block keeps long arrays affordable.
    """
    def with_values(arr: Column) -> Column:
        blocks = F.transform(
            F.filter(arr, lambda _, i: i % BLOCK == 0),
            lambda _, b: F.aggregate(F.slice(arr, b * BLOCK + 1, F.lit(BLOCK)), zero, fold),
        )
        carries = F.aggregate(
            blocks,
            F.array(zero),
            lambda acc, x: F.concat(acc, F.array(fold(F.element_at(acc, -1), x))),
        )
        return let(carries, lambda carry: F.transform(
            arr,
            lambda _, i: F.aggregate(
                F.slice(arr, i - i % BLOCK + 1, i % BLOCK),
                F.get(carry, F.floor(i / BLOCK).cast("int")),
                fold,
            ),
        ))

    return let(values, with_values)


def running_sum(values: Column) -> Column:
    """For each position, the sum of all earlier elements (INT arrays)."""
    return _blocked(values, lambda a, x: a + x, F.lit(0))


def running_max(values: Column, floor: int = 0) -> Column:
    """For each position, the largest earlier element, or ``floor``."""
    return _blocked(values, lambda a, x: F.greatest(a, x), F.lit(floor))
