"""Profiling aggregates over a labelled table.

Every profile is a grouped aggregate with map-side partial aggregation, so a class or
text holding a third of all rows costs one partial row per task, not a hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketspark.functions.hashing import order_key
from ticketspark.functions.text import word_count


def row_count(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns, columns)."""
    cols = ",".join(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(cols).alias("columns"))


def intent_counts(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """(intent, n, share): rows per label, most frequent first (label breaks ties)."""
    counts = df.groupBy(F.col(label_col).alias("intent")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.round(F.col("n") / total, 6)).orderBy(
        F.desc("n"), F.asc("intent"))


def intent_cardinality(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """(n_intents): exact number of distinct labels (nulls not counted)."""
    return df.agg(F.count_distinct(F.col(label_col)).alias("n_intents"))


def class_extremes(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """Smallest and largest class with sizes; ties go to the first label in order."""
    counts = df.groupBy(F.col(label_col).alias("intent")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.min_by("intent", F.struct("n", "intent")).alias("smallest_intent"),
        F.min("n").alias("smallest_n"),
        F.min_by("intent", F.struct(-F.col("n"), F.col("intent"))).alias("largest_intent"),
        F.max("n").alias("largest_n"),
    )


def sample_rows(df: DataFrame, n: int = 5, seed: int = 42, id_col: str = "ticket_id",
                cols: tuple[str, ...] = ("ticket_id", "instruction", "intent")) -> DataFrame:
    """``n`` rows in seeded md5 order: planned as a map-side top-k (TakeOrderedAndProject)."""
    k = order_key(id_col, seed)
    return df.select(*cols, k.alias("_k")).orderBy("_k", id_col).limit(n).drop("_k")


def class_balance(phases: dict[str, DataFrame], label_col: str = "intent") -> DataFrame:
    """Per phase: rows, classes, smallest/largest class size and their ratio."""
    out = None
    for phase, df in phases.items():
        counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg(
            F.sum("n").cast("long").alias("n_rows"),
            F.count(F.lit(1)).alias("n_classes"),
            F.min("n").alias("min_class"),
            F.max("n").alias("max_class"),
        ).select(
            F.lit(phase).alias("phase"), "*",
            F.round(F.col("max_class") / F.col("min_class"), 6).alias("max_min_ratio"))
        out = row if out is None else out.unionByName(row)
    return out


def length_profile(df: DataFrame, text_col: str = "instruction",
                   limits: tuple[int, ...] = (192, 512)) -> DataFrame:
    """Whitespace-token length profile: mean, max, exact p50/p95, rows over limits.

    Exact percentiles come from a histogram of lengths (one row per distinct length,
    bounded by the longest text), not from collecting every length into one buffer:
    the running sum over that histogram locates the ranks each percentile needs, with
    the same linear interpolation as ``percentile``/``quantile_cont``.
    """
    lengths = df.select(word_count(F.col(text_col)).alias("len"))
    hist = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("cum", F.sum("cnt").over(w)).withColumn(
        "before", F.col("cum") - F.col("cnt"))

    def value_at(rank: F.Column) -> F.Column:
        # length whose cumulative range [before, cum) holds the 0-based rank
        return F.min(F.when((F.col("before") <= rank) & (rank < F.col("cum")), F.col("len")))

    total = F.sum("cnt").over(Window.partitionBy())
    hist = hist.withColumn("total", total)
    aggs = [
        F.first("total").alias("n_rows"),
        F.round(F.sum(F.col("len") * F.col("cnt")) / F.first("total"), 6).alias("mean_tokens"),
        F.max("len").alias("max_tokens"),
    ]
    for p in (0.5, 0.95):
        pos = (F.col("total") - 1) * F.lit(p)
        lo, hi = F.floor(pos), F.ceil(pos)
        v_lo, v_hi = value_at(lo), value_at(hi)
        frac = F.first(pos - lo)
        aggs.append(F.round(v_lo + (v_hi - v_lo) * frac, 6).alias(f"p{int(p * 100)}_tokens"))
    for lim in limits:
        aggs.append(F.sum(F.when(F.col("len") > lim, F.col("cnt")).otherwise(0))
                    .cast("long").alias(f"over_{lim}"))
    return hist.agg(*aggs)
