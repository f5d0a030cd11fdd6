"""Two-arm comparison and error analysis.

All inputs except ``misses`` and ``run_agreement`` are the small outcome table or the
per-class report derived from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketspark.operators import metrics as M

ARM = M.ARM


def arm_comparison(oc: DataFrame, baseline: str, tuned: str) -> DataFrame:
    """(metric, baseline, tuned, delta): headline metrics side by side."""
    s = M.metrics_summary(oc)
    long = s.select(ARM, F.expr(
        "stack(4, 'accuracy', accuracy, 'macro_f1', macro_f1, "
        "'weighted_f1', weighted_f1, 'unparseable_rate', unparseable_rate) as (metric, value)"))
    wide = long.groupBy("metric").pivot(ARM, [baseline, tuned]).agg(F.first("value"))
    return wide.select(
        "metric", F.col(baseline).alias("baseline"), F.col(tuned).alias("tuned"),
        F.round(F.col(tuned) - F.col(baseline), 6).alias("delta"))


METRICS = ["accuracy", "macro_f1", "weighted_f1", "unparseable_rate"]


def document_comparison(baseline: DataFrame, tuned: DataFrame, places: int = 6) -> DataFrame:
    """(metric, baseline, tuned, delta) of two stored metric documents, as
    ``sources.readers.read_metrics_document`` returns them; one document each."""
    def values(doc: DataFrame, name: str) -> DataFrame:
        one = doc.select(*METRICS).distinct()
        return one.select(F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.round(m, places).alias(name)) for m in METRICS])).alias("m")).select("m.*")
    both = values(baseline, "baseline").join(values(tuned, "tuned"), "metric")
    return both.withColumn("delta", F.round(F.col("tuned") - F.col("baseline"), places))


def failed_classes(oc: DataFrame) -> DataFrame:
    """(arm, label, support, n_predicted): classes with F1 = 0."""
    r = M.class_report(oc)
    return r.where(F.col("f1") == 0).select(ARM, "label", "support", "n_predicted")


def top_classes(oc: DataFrame, k: int = 1) -> DataFrame:
    """(arm, rank, label, f1): the k strongest classes per arm (ties: label order)."""
    r = M.class_report(oc)
    w = Window.partitionBy(ARM).orderBy(F.desc("f1"), F.asc("label"))
    return r.withColumn("rank", F.row_number().over(w).cast("long")).where(
        F.col("rank") <= k).select(ARM, "rank", "label", F.round("f1", 6).alias("f1"))


def dominant_confusion(oc: DataFrame) -> DataFrame:
    """(arm, actual, predicted, n, support, share): per actual class, the most frequent
    wrong output (out-of-label outputs included) and its share of the class.

    Support and rank use the same (arm, actual) partitioning: one shuffle, no join.
    """
    part = Window.partitionBy(ARM, "actual")
    ranked = oc.withColumn("support", F.sum("n").over(part)).where(
        F.col("actual") != F.col("predicted")).withColumn(
        "_r", F.row_number().over(part.orderBy(F.desc("n"), F.asc("predicted"))))
    return ranked.where(F.col("_r") == 1).select(
        ARM, "actual", "predicted", F.col("n").cast("long").alias("n"),
        F.col("support").cast("long").alias("support"),
        F.round(F.col("n") / F.col("support"), 6).alias("share"))


def misses(predicted: DataFrame, actual: str = "intent", pred: str = "predicted_intent") -> DataFrame:
    """Rows whose prediction differs from the true label."""
    return predicted.where(~F.col(pred).eqNullSafe(F.col(actual)))


def prediction_coverage(oc: DataFrame) -> DataFrame:
    """(arm, label, n_predicted, ever_predicted) for every label of the arm."""
    r = M.class_report(oc)
    return r.select(ARM, "label", "n_predicted", (F.col("n_predicted") > 0).alias("ever_predicted"))


def run_agreement(a: DataFrame, b: DataFrame, id_col: str = "ticket_id",
                  pred: str = "predicted_intent") -> DataFrame:
    """(n_common, n_agree, agreement_rate) of two runs over the same inputs."""
    j = a.select(id_col, F.col(pred).alias("_a")).join(
        b.select(id_col, F.col(pred).alias("_b")), id_col)
    return j.agg(F.count(F.lit(1)).alias("n_common"),
                 F.count(F.when(F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("n_agree")
                 ).withColumn("agreement_rate", F.round(
                     F.when(F.col("n_common") > 0, F.col("n_agree") / F.col("n_common"))
                     .otherwise(F.lit(0.0)), 6))


def class_delta(oc: DataFrame, baseline: str, tuned: str) -> DataFrame:
    """(label, f1_baseline, f1_tuned, delta, repaired) per label of either arm.

    One grouped pass over the per-class report (a label missing from an arm counts as
    F1 0), instead of a full outer join of the two arms' reports.
    """
    r = M.class_report(oc).where(F.col(ARM).isin(baseline, tuned))
    j = r.groupBy("label").agg(
        F.coalesce(F.max(F.when(F.col(ARM) == baseline, F.col("f1"))), F.lit(0.0)).alias("f1_baseline"),
        F.coalesce(F.max(F.when(F.col(ARM) == tuned, F.col("f1"))), F.lit(0.0)).alias("f1_tuned"))
    return j.select(
        "label", F.round("f1_baseline", 6).alias("f1_baseline"),
        F.round("f1_tuned", 6).alias("f1_tuned"),
        F.round(F.col("f1_tuned") - F.col("f1_baseline"), 6).alias("delta"),
        ((F.col("f1_baseline") == 0) & (F.col("f1_tuned") > 0)).alias("repaired"))
