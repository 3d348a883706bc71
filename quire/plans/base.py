"""Shape of a registered query, and table access."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from quire.session import table

__all__ = ["Query", "hits_sql", "longs", "table"]


class Query(NamedTuple):
    """A plan over the supplied tables, its checking SQL, and the operators it shows."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str


def longs(run: Callable[[SparkSession, str], DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """The plan with columns as long integers, which is what its SQL gives."""
    return lambda spark, folder: (df := run(spark, folder)).withColumns({c: df[c].cast("bigint") for c in columns})


def hits_sql(table: str, key: str, text: str, pattern: str, where: str = "true") -> str:
    """SQL that lists matches of a pattern that contains no line break, found line by line: the
    offset of a hit is its line's offset and the text before it in the line."""
    p = pattern.replace("'", "''")
    return f"""
      SELECT {key}, hit_text, line, token, line_start + off AS start,
             line_start + off + length(token) AS "end", off + 1 AS col
      FROM (SELECT *, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY {key}, line ORDER BY i) AS BIGINT)
                      - length(token) AS off
            FROM (SELECT {key}, hit_text, line, line_start, unnest(ms) AS token, unnest(gs[1:len(ms)]) AS gap,
                         unnest(range(1, len(ms) + 1)) AS i
                  FROM (SELECT {key}, hit_text, line, line_start, regexp_extract_all(piece, '{p}') AS ms,
                               string_split_regex(piece, '{p}') AS gs
                        FROM (SELECT {key}, hit_text, line, piece,
                                     CAST(coalesce(sum(length(piece) + 1) OVER (PARTITION BY {key} ORDER BY line
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start
                              FROM (SELECT {key}, {text} AS hit_text, unnest(string_split({text}, chr(10))) AS piece,
                                           unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS line
                                    FROM {table} WHERE {where})))))"""
