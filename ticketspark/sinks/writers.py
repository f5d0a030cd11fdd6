"""Sinks (A3-A5): split Parquet, prediction CSV, metric documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark.operators import metrics as M

# CSV dialect that round-trips embedded quotes and newlines: fields quoted when
# needed, quotes doubled (RFC 4180), header row, no index column.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
# A CSV file with multi-line fields is read by one task, so files are kept small.
CSV_FILE_ROWS = 500_000


def write_split(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One Parquet dataset partitioned by split (train/ and test/ sub-folders)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_predictions_csv(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", CSV_FILE_ROWS)
    for k, v in CSV_OPTIONS.items():
        writer = writer.option(k, v)
    writer.csv(path)


def metrics_document(oc: DataFrame, model: str, eval_type: str,
                     n_per_class: int | None = None) -> DataFrame:
    """One nested row per arm: scalar metrics plus ``per_class_report`` as
    map<label | average name, struct<precision, recall, f1-score, support>>.

    The report is assembled from the small outcome table with ``map_from_entries``.
    (The reference writes the ``accuracy`` entry as a bare number; a Spark map needs
    one value type, so here it is a struct whose three scores all equal accuracy.)
    """
    entries = M.report_entries(oc, None).select(
        M.ARM, F.struct(F.col("key"), F.struct(
            F.col("precision"), F.col("recall"), F.col("f1").alias("f1-score"),
            F.col("support"))).alias("e"))
    report = entries.groupBy(M.ARM).agg(
        F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("per_class_report"))
    summary = M.metrics_summary(oc, n_per_class, model, eval_type, places=None)
    return summary.join(report, M.ARM)


def write_metrics_document(doc: DataFrame, path: str) -> None:
    """JSON lines, one document per arm (a handful of rows, written as one file)."""
    doc.coalesce(1).write.mode("overwrite").json(path)
