"""Grouping rows by their whole text without shuffling the texts.

Two phases. First, rows are combined by a 128-bit digest of their text, together with the
smallest and largest value of a second, independent digest. Where the two differ, different
texts share the first digest; only the rows of such digests are read again, in the second
phase, and grouped by the digest followed by the text itself. So equal keys mean equal texts
unless texts agree in both digests, 256 bits in all. As no two texts of one key digest are
known, the second phase normally has no rows, is not planned, and no exchange holds a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark.operators.vocab import sized
from ticketspark.session import materialize


def digest(text: Column) -> Column:
    """The first half of the SHA-256 of a text (null for a null text)."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def check(text: Column) -> Column:
    """The second digest of a text: its MD5."""
    return F.md5(text.cast("binary"))


def text_groups(df: DataFrame, text_col: str, by: list[Column] | None = None,
                digest: Callable[[Column], Column] = digest,
                check: Callable[[Column], Column] = check) -> DataFrame:
    """(_key, by..., _md5, _n): the rows of each text and ``by`` values; ``_key`` is one
    for equal texts and differs for different ones, ``_md5`` is ``check`` of the text, ``_n``
    the number of rows. Null texts are one group with a null key.

    Rows are combined within tasks, so a text on a third of all rows ships a row per task.
    The groups are saved once; what an operator aggregates further reads digests only.
    """
    by = by or []
    text = F.col(f"`{text_col}`")
    keyed = df.select(digest(text).alias("_key"), check(text).alias("_md5"), *by)
    names = keyed.columns[2:]
    one = materialize(keyed.groupBy("_key", *names).agg(
        F.min("_md5").alias("_md5"), F.max("_md5").alias("_max"), F.count(F.lit(1)).alias("_n")), "text-groups")
    spread = one.groupBy("_key").agg(F.min("_md5").alias("_md5"), F.max("_max").alias("_max")) if names else one
    met = spread.where(F.col("_md5") != F.col("_max")).select("_key")
    if names:  # a pass over the saved groups of its own
        met = materialize(met, "text-collisions")
    out = one.select("_key", *names, "_md5", "_n")
    if met.isEmpty():
        return out
    met = sized(met, "text-met")
    again = df.select(digest(text).alias("_key"), text.alias("_text"), check(text).alias("_md5"), *by).join(
        met, "_key").withColumn("_key", F.concat("_key", F.col("_text").cast("binary")))
    settled = again.groupBy("_key", *names).agg(F.first("_md5").alias("_md5"), F.count(F.lit(1)).alias("_n"))
    return out.join(met, "_key", "left_anti").unionByName(settled)
