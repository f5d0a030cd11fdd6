"""Exact deduplication and duplicate audits.

Keep-first dedup is ``row_number() over (partition by text order by id) = 1``.
Spark plans it with a *partial* WindowGroupLimit before the shuffle: each task keeps
only its lowest id per text, so a text repeated across a third of the table ships one
row per task, not a third of the table to one reducer. ``dropDuplicates`` is not used:
it keeps an arbitrary row, not the first. The audits count texts by digests
(``textkeys``): no text is shuffled for a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketspark.operators.textkeys import text_groups


def dedup_first(df: DataFrame, text_col: str = "instruction", id_col: str = "ticket_id") -> DataFrame:
    """Rows whose text appears for the first time (lowest id); byte-equal, case-sensitive."""
    # rows are sorted by a digest first; the text itself is compared only among equal ones
    w = Window.partitionBy("_md5", text_col).orderBy(id_col)
    return df.withColumn("_md5", F.md5(F.col(text_col))).withColumn("_rn", F.row_number().over(w)).where(
        F.col("_rn") == 1).drop("_rn", "_md5")


def dedup_report(df: DataFrame, text_col: str = "instruction") -> DataFrame:
    """(n_before, n_after, n_removed) from one pass over per-text counts."""
    return text_groups(df, text_col).agg(
        F.sum("_n").cast("long").alias("n_before"),
        F.count(F.lit(1)).alias("n_after"),
    ).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def duplicate_groups(df: DataFrame, text_col: str = "instruction") -> DataFrame:
    """Distribution of duplicate groups: (group_size, n_groups, redundant_rows)."""
    g = text_groups(df, text_col).where(F.col("_n") > 1).withColumnRenamed("_n", "group_size")
    return g.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups")).withColumn(
        "redundant_rows", (F.col("group_size") - 1) * F.col("n_groups"))


def label_conflicts(df: DataFrame, text_col: str = "instruction", label_col: str = "intent",
                    label_cols: list[str] | None = None) -> DataFrame:
    """(text_md5, n_rows, n_labels, labels): texts whose copies carry more than one label. With
    ``label_cols`` the same for each of these columns, named in a column ``key``.

    One pass over the texts serves all columns: rows are combined to distinct (text, labels)
    groups first, and the per-text label list is bounded by the number of classes.
    """
    cols = label_cols or [label_col]
    groups = text_groups(df, text_col, [F.col(f"`{c}`").alias(f"_label{i}") for i, c in enumerate(cols)])
    each = groups.select("_key", "_md5", "_n", F.inline(F.array(*[F.struct(
        F.lit(c).alias("key"), F.col(f"_label{i}").alias("label")) for i, c in enumerate(cols)])))
    pairs = each.groupBy("_key", "_md5", "key", "label").agg(F.sum("_n").alias("n"))
    per_text = pairs.groupBy("_key", "_md5", "key").agg(
        F.sum("n").cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_labels"),
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"),
    ).where(F.col("n_labels") > 1)
    return per_text.select(*(["key"] if label_cols else []), F.col("_md5").alias("text_md5"), "n_rows", "n_labels", "labels")
