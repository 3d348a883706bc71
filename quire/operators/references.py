"""References of documents resolved against the files there are, by column expressions and one ranked join.

A reference is refused if it names a scheme or an authority, is badly percent-encoded, holds a NUL, or leaves
the root by its dot segments. What is left loses query and fragment, is decoded once, and stands from the root
or from the folder of its document. A path whose last segment has no extension may stand for itself or for
itself with one of the candidate extensions; exactly one existing file must answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import let

STATES = ("refused", "resolved", "ambiguous", "missing")


def decoded(path: Column) -> Column:
    """A path with its percent escapes decoded as UTF-8; null if one is malformed, no UTF-8 or NUL."""
    valid = path.rlike("^(?s:[^%]|%[0-9A-Fa-f]{2})*$")
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    broken = F.contains(plain, F.lit("�")) & ~F.contains(path, F.lit("�")) | F.contains(plain, F.lit("\0"))
    return F.when(valid & ~F.coalesce(broken, F.lit(True)), plain)


def normal_path(path: Column, base: Column | None = None) -> Column:
    """A path from the root without empty and dot segments; null if it leaves the root. A relative
    path begins at ``base``, the path of a folder, or at the root."""
    whole = path if base is None else F.when(path.startswith("/"), path).otherwise(F.concat(F.coalesce(base, F.lit("")), F.lit("/"), path))
    state = lambda parts, out: F.struct(parts.alias("p"), out.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        size = F.size(acc["p"])
        return (F.when(part.isin("", "."), acc)
                .when(part == "..", state(F.slice(acc["p"], F.lit(1), F.greatest(size - 1, F.lit(0))), acc["out"] | (size == 0)))
                .otherwise(state(F.concat(acc["p"], F.array(part)), acc["out"])))

    folded = F.aggregate(F.split(whole, "/", -1), state(F.array().cast("array<string>"), F.lit(False)), step)
    return let(folded, lambda x: F.when(~x["out"], F.concat(F.lit("/"), F.array_join(x["p"], "/"))))


def admitted(ref: Column, base: Column | None = None) -> Column:
    """The normal path that a reference names, or null where it is refused."""
    foreign = ref.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")
    return F.when(~foreign, normal_path(decoded(F.regexp_replace(ref, r"(?s)[?#].*$", "")), base))


def resolve(refs: DataFrame, files: DataFrame, extensions: list[str], base: str | None = None) -> DataFrame:
    """``refs(ref, ...)`` with ``path``, ``state`` and the ``file`` that answers, against ``files(path)``.

    Each distinct path is looked up once with all its candidates, so a reference that a third of all documents have costs
    one lookup; the outcome is joined to the rows. ``file`` is the answer with the first extension where it
    is the only one. A null reference is refused; null files and repeated files don't count; repeated references stay.
    """
    named = refs.withColumn("path", admitted(F.col("ref"), F.col(base) if base else None))
    paths = named.select("path").where("path is not null").distinct()
    open_ = ~F.col("path").rlike(r"[^/]\.[^./]+$")
    tried = F.when(open_, F.array(*[F.concat("path", F.lit(e)) for e in ("", *extensions)])).otherwise(F.array("path"))
    known = files.select(F.col("path").alias("file")).where("file is not null").distinct()
    answers = paths.select("path", F.posexplode(tried).alias("rank", "file")).join(known, "file").groupBy("path").agg(
        F.count("*").alias("_n"), F.min_by("file", "rank").alias("file"))
    state = (F.when(F.col("path").isNull(), "refused").when(F.col("_n").isNull(), "missing")
             .when(F.col("_n") == 1, "resolved").otherwise("ambiguous"))
    return named.join(answers, "path", "left").withColumn("state", state).withColumn(
        "file", F.when(F.col("state") == "resolved", F.col("file"))).select(*refs.columns, "path", "state", "file")


def unreferenced(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Files that no reference resolves to, each once."""
    used = resolved.select("file").where("file is not null").distinct()
    return files.select(F.col("path").alias("file")).where("file is not null").distinct().join(used, "file", "left_anti")
