"""Exact "first q rows of each group" in a seeded order, without a per-group sort.

Stratified splits and per-class samples need, for every class g, the q_g rows that
come first in the order (md5(seed|id), id). The textbook plan, ``row_number()`` over
``partition by class``, sends a whole class to one task; with few classes and one of
them holding a third of the table, that task is the job. Instead:

1. histogram of (class, first ``digits`` hex digits of the key) -- a grouped count
   with map-side combine, at most classes * 16**digits rows;
2. a running sum over each class's histogram finds the prefix bucket that holds the
   q_g-th row, and how many rows of that bucket are still needed;
3. only the rows in that one bucket (about n_g / 16**digits of them) are ranked, which
   yields the q_g-th key itself: the per-class cut (cut_h, cut_id);
4. every row is then selected by ``(h, id) <= (cut_h, cut_id)`` against a table of
   one row per class, broadcast if its measured size allows -- then no shuffle of the
   wide rows at all.

With 4 digits the histogram window holds <= 65,536 rows per class and the cut bucket
about n_g / 65,536 rows; larger tables take more digits (``digits_for``), so that the
bucket stays below a million rows.
The result equals the plain window (checked in tests).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketspark.functions.hashing import hex_prefix, order_key
from ticketspark.operators.vocab import sized
from ticketspark.session import materialize

DEFAULT_DIGITS = 4
# Rows of a cut bucket that one task ranks, about.
BUCKET_ROWS = 1_000_000


def digits_for(k: DataFrame) -> int:
    """Prefix digits with which a bucket of the whole table holds BUCKET_ROWS rows at most."""
    return max(DEFAULT_DIGITS, math.ceil(math.log(max(k.count(), 1) / BUCKET_ROWS, 16)))


def keyed(df: DataFrame, group_col: str, id_col: str, seed: int) -> DataFrame:
    """(g, _id, _h): the only columns the histogram and cut passes read."""
    return df.select(F.col(group_col).alias("g"), F.col(id_col).alias("_id"),
                     order_key(F.col(id_col), seed).alias("_h"))


def histogram(k: DataFrame, digits: int = DEFAULT_DIGITS) -> DataFrame:
    """(g, _p, cnt): rows per class and key prefix."""
    return k.groupBy("g", hex_prefix(F.col("_h"), digits).alias("_p")).agg(
        F.count(F.lit(1)).alias("cnt"))


def class_sizes(hist: DataFrame) -> DataFrame:
    """(g, n_rows) from the histogram (re-aggregates the small table, no data scan)."""
    return hist.groupBy("g").agg(F.sum("cnt").cast("long").alias("n_rows"))


def cuts(k: DataFrame, hist: DataFrame, quotas: DataFrame,
         digits: int = DEFAULT_DIGITS) -> DataFrame:
    """(g, cut_h, cut_id): the quota-th smallest (h, id) of every class with quota > 0.

    ``quotas`` is (g, quota), one row per class. A null class is a class like any other.
    """
    w = Window.partitionBy("g").orderBy("_p").rowsBetween(Window.unboundedPreceding,
                                                          Window.currentRow)
    h = hist.withColumn("_cum", F.sum("cnt").over(w))
    cut_bucket = (
        h.join(sized(quotas.withColumnRenamed("g", "_g"), "quotas"), F.col("g").eqNullSafe(F.col("_g")))
        .where((F.col("_cum") - F.col("cnt") < F.col("quota")) & (F.col("_cum") >= F.col("quota")))
        .select("g", F.col("_p").alias("_cut_p"),
                (F.col("quota") - (F.col("_cum") - F.col("cnt"))).alias("_need"))
    )
    in_bucket = (
        k.join(sized(cut_bucket.withColumnRenamed("g", "_g"), "cut-buckets"), F.col("g").eqNullSafe(F.col("_g")))
        .where(hex_prefix(F.col("_h"), digits) == F.col("_cut_p"))
    )
    rank = F.row_number().over(Window.partitionBy("g").orderBy("_h", "_id"))
    return (
        in_bucket.withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_need"))
        .select("g", F.col("_h").alias("cut_h"), F.col("_id").alias("cut_id"))
    )


def within_cut(df: DataFrame, cut_table: DataFrame, group_col: str, id_col: str,
               seed: int, flag: str) -> DataFrame:
    """``df`` plus boolean ``flag``: the row is among its class's first ``quota`` rows.

    Ids must be unique (they break ties of the md5 key). A class without a cut row
    (quota 0) selects nothing.
    """
    h = order_key(F.col(id_col), seed)
    joined = df.join(sized(cut_table.withColumnRenamed("g", "_g"), "cuts"),
                     F.col(group_col).eqNullSafe(F.col("_g")), "left")
    inside: Column = F.when(F.col("cut_h").isNull(), F.lit(False)).otherwise(
        F.struct(h.alias("h"), F.col(id_col).alias("i"))
        <= F.struct(F.col("cut_h").alias("h"), F.col("cut_id").alias("i")))
    return joined.withColumn(flag, inside).drop("_g", "cut_h", "cut_id")


def first_per_group(df: DataFrame, group_col: str, id_col: str, quota_of: "callable",
                    seed: int = 42, digits: int | None = None) -> DataFrame:
    """Rows among the first ``quota_of(n_rows)`` of their class in seeded order.

    ``quota_of`` maps the class-size column to a quota column (and may raise).
    """
    k = keyed(df, group_col, id_col, seed)
    digits = digits or digits_for(k)
    hist = materialize(histogram(k, digits), "histogram")
    quotas = class_sizes(hist).select("g", quota_of(F.col("n_rows")).alias("quota"))
    ct = cuts(k, hist, quotas, digits)
    return within_cut(df, ct, group_col, id_col, seed, "_in").where("_in").drop("_in")
