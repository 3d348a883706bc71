"""Text expressions. Offsets count code points, as ``length`` and ``substring`` do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import constants as K


def strip_bidi(text: Column) -> Column:
    """Remove directional control characters."""
    return F.regexp_replace(text, f"[{K.BIDI_CONTROLS}]", "")


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s.casefold(), na_action="ignore")


def casefold(text: Column) -> Column:
    """Full Unicode case folding; ASCII rows travel to the function as nulls."""
    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_only, F.lower(text)).otherwise(_casefold(F.when(~ascii_only, text)))


def trimmed(text: Column) -> Column:
    """Text without white space at its ends, tabs and no-break spaces included."""
    return F.regexp_replace(text, f"^[{K.WHITE}]+|[{K.WHITE}]+$", "")


def excerpt(text: Column, start: Column) -> Column:
    """Sixty characters of context from at most twenty before a zero-based offset."""
    first = F.greatest(F.lit(1), start - 19)
    return trimmed(F.replace(F.substr(text, first, F.lit(60)), F.lit("\n"), F.lit(" ")))


def is_cjk(text: Column) -> Column:
    return text.rlike(f"[{K.CJK}]")


def is_word_char(char: Column) -> Column:
    """Letters, digits and underscore of any script."""
    return char.rlike(r"^[\p{IsAlphabetic}\p{N}_]$")


def plural_stem(word: Column) -> Column:
    """Singular stem of an English plural, or null when the word is not one."""
    lower = F.lower(word)
    size = F.length(word)
    cut = lambda n: F.substr(word, F.lit(1), size - n)
    before_ies = F.substr(word, size - 3, F.lit(1))
    return (
        F.when(word.rlike("^[A-Z]{2,}s$"), cut(1))
        .when((size < 4) | ~word.rlike("[a-z]"), F.lit(None).cast("string"))
        .when(lower.isin(K.PLURAL_EXCEPTIONS), F.lit(None).cast("string"))
        .when(
            lower.endswith("ies") & (size > 4),
            F.concat(cut(3), F.when(before_ies.rlike("[A-Z]"), F.lit("Y")).otherwise(F.lit("y"))),
        )
        .when(lower.rlike("(?:ches|shes|[sxz]es)$") & (size > 4), cut(2))
        .when(lower.endswith("s") & ~lower.rlike("[suioa]s$"), cut(1))
    )
