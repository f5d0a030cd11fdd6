"""Label vocabulary (B5-B7), and the size checks of small tables.

The vocabulary is the sorted set of distinct labels. It is small by nature (tens to
thousands of classes), but not by proof. Results over it have no limit. What is inlined
into every row as one array passes :func:`label_array`, which gathers ``max_classes``
labels at most and fails beyond; what is joined passes :func:`sized`, which measures the
table and broadcasts it only within a budget of rows and bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark.operators.ranks import ranked
from ticketspark.session import materialize

# Labels of an array that goes with every row.
MAX_CLASSES = 100_000
# Budget of a table that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def guard_size(arr: Column, max_size: int, what: str) -> Column:
    """``arr`` unchanged, or a runtime error when it holds more than ``max_size`` items."""
    return F.when(F.size(arr) > F.lit(max_size),
                  F.raise_error(F.lit(f"{what} exceeds {max_size} entries"))).otherwise(arr)


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a table: lengths of strings, and eight bytes for other values."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8)
                 for c, t in df.dtypes), F.lit(8))
    n, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return n, size or 0


def fits(saved: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Is the measured size of a saved table within the budget of a broadcast?"""
    rows, size = measure(saved)
    return rows <= (BROADCAST_ROWS if max_rows is None else max_rows) and size <= (
        BROADCAST_BYTES if max_bytes is None else max_bytes)


def sized(df: DataFrame, name: str, max_rows: int | None = None,
          max_bytes: int | None = None) -> DataFrame:
    """``df`` as a saved table, marked for broadcast only if its measured size is within
    the budget; a larger one is left to a shuffle join."""
    saved = materialize(df, name)
    return F.broadcast(saved) if fits(saved, max_rows, max_bytes) else saved


def label_vocab(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """(label, label_rank): distinct labels ranked in ascending code-point order, by ranges."""
    labels = df.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return ranked(labels, [F.col("label")], "label_rank")


def _gathered(df: DataFrame, label_col: str, max_classes: int, item=lambda c: c) -> Column:
    """Sorted distinct labels as one value. The limit stands before the gathering, so a
    column of very many values fails without any task holding them all."""
    labels = df.select(F.col(label_col).alias("l")).where(F.col("l").isNotNull()).distinct().limit(
        max_classes + 1)
    arr = F.array_sort(F.collect_list("l"))
    return labels.select(guard_size(arr, max_classes, "label vocabulary").alias("l")).select(
        F.transform("l", item).alias("labels")).scalar()


def label_array(df: DataFrame, label_col: str = "intent",
                max_classes: int = MAX_CLASSES) -> Column:
    """Sorted distinct labels as one array value (a scalar subquery, computed once)."""
    return _gathered(df, label_col, max_classes)


def lower_label_array(df: DataFrame, label_col: str = "intent",
                      max_classes: int = MAX_CLASSES) -> Column:
    """The labels of :func:`label_array`, lower-cased, same order (scalar subquery)."""
    return _gathered(df, label_col, max_classes, F.lower)


def label_prompt_line(df: DataFrame, label_col: str = "intent", sep: str = ", ") -> DataFrame:
    """One row: the sorted labels joined by ``sep`` (the label line of the prompt)."""
    return df.select(
        F.array_join(F.array_sort(F.collect_set(F.col(label_col))), sep).alias("label_line"),
        F.count_distinct(F.col(label_col)).alias("n_labels"),
    )


def label_drift(declared: DataFrame, observed: DataFrame, declared_col: str = "label",
                observed_col: str = "label", by: list[str] | None = None) -> DataFrame:
    """Labels on one side only: (by..., side, label).

    ``side`` is ``declared_only`` (declared, never observed) or ``observed_only``
    (observed, not declared). Both sides are tagged, unioned and grouped once (a set
    difference in both directions with map-side combine), so there is no join and a
    hot label costs one partial row per task.
    """
    by = by or []
    d = declared.select(*by, F.col(declared_col).alias("label"), F.lit(1).alias("_d"), F.lit(0).alias("_o"))
    o = observed.select(*by, F.col(observed_col).alias("label"), F.lit(0).alias("_d"), F.lit(1).alias("_o"))
    g = d.unionByName(o).groupBy(*by, "label").agg(F.max("_d").alias("_d"), F.max("_o").alias("_o"))
    return g.where(F.col("_d") != F.col("_o")).select(
        *by, F.when(F.col("_d") == 1, F.lit("declared_only")).otherwise(F.lit("observed_only")).alias("side"),
        "label")
