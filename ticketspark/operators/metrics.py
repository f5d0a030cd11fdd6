"""Classification metrics (H1-H9).

Everything derives from one small table, ``outcomes``: (arm, actual, predicted, n),
built by a single grouped count with map-side combine. Its size is bounded by
arms * K * (K + out-of-label outputs), independent of the number of rows scored, so
every metric after it is a computation on a few hundred rows.

Label set per arm = sorted distinct *actual* labels (as in the reference, where the
labels are taken from the evaluated sample). Predictions outside that set (e.g.
``UNPARSEABLE``) count as wrong in accuracy and recall, are left out of precision's
denominator and of the confusion matrix, and turn the report's ``accuracy`` row into
``micro avg``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark.functions.decode import UNPARSEABLE

ARM = "arm"


def _safe_div(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0 (``zero_division=0``)."""
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(0.0))


def outcomes(df: DataFrame, actual: str = "intent", predicted: str = "predicted_intent",
             arm: str | None = ARM) -> DataFrame:
    """(arm, actual, predicted, n). Without an arm column everything is arm ``all``."""
    a = F.col(arm) if arm else F.lit("all")
    return df.groupBy(a.alias(ARM), F.col(actual).alias("actual"),
                      F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def label_stats(oc: DataFrame) -> DataFrame:
    """(arm, label, support, tp, n_predicted) for every value seen as actual or predicted.

    Each outcome cell contributes to its actual label (support, tp) and to its
    predicted label (n_predicted) through one ``explode``, so one aggregation yields
    all per-label counts -- no self-joins of the outcome table. Labels of the arm's
    label set are exactly the rows with support > 0; rows with support 0 are
    out-of-label outputs such as ``UNPARSEABLE``.
    """
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    contrib = oc.select(ARM, F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), hit.alias("tp"),
                 zero.alias("n_predicted")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), zero.alias("tp"),
                 F.col("n").alias("n_predicted")),
    )).alias("c")).select(ARM, "c.*").where(F.col("label").isNotNull())
    return contrib.groupBy(ARM, "label").agg(
        F.sum("support").cast("long").alias("support"), F.sum("tp").cast("long").alias("tp"),
        F.sum("n_predicted").cast("long").alias("n_predicted"))


def arm_labels(oc: DataFrame, as_col: str = "label") -> DataFrame:
    """(arm, label): the distinct actual labels per arm, as a relation of any size."""
    return oc.where(F.col("actual").isNotNull()).select(ARM, F.col("actual").alias(as_col)).distinct()


def _with_scores(stats: DataFrame) -> DataFrame:
    return stats.select(
        ARM, "label",
        _safe_div(F.col("tp"), F.col("n_predicted")).alias("precision"),
        _safe_div(F.col("tp"), F.col("support")).alias("recall"),
        _safe_div(2 * F.col("tp"), F.col("support") + F.col("n_predicted")).alias("f1"),
        "support", "tp", "n_predicted",
    )


def class_report(oc: DataFrame) -> DataFrame:
    """(arm, label, precision, recall, f1, support, tp, n_predicted) per label."""
    return _with_scores(label_stats(oc).where(F.col("support") > 0))


def rounded(df: DataFrame, cols: list[str], places: int | None = 6) -> DataFrame:
    """Round ``cols`` at the query edge (None: leave exact)."""
    if places is None:
        return df
    return df.select(*[F.round(F.col(c), places).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def classification_report(oc: DataFrame, places: int | None = 6) -> DataFrame:
    r = class_report(oc).select(ARM, "label", "precision", "recall", "f1", "support")
    return rounded(r, ["precision", "recall", "f1"], places)


def accuracy(oc: DataFrame, places: int | None = 6) -> DataFrame:
    """(arm, n_rows, n_correct, accuracy): UNPARSEABLE and out-of-label rows are wrong."""
    a = oc.groupBy(ARM).agg(
        F.sum("n").cast("long").alias("n_rows"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).cast("long").alias("n_correct"),
    ).withColumn("accuracy", _safe_div(F.col("n_correct"), F.col("n_rows")))
    return rounded(a, ["accuracy"], places)


def unparseable_rate(oc: DataFrame, sentinel: str = UNPARSEABLE, places: int | None = 6) -> DataFrame:
    u = oc.groupBy(ARM).agg(
        F.sum("n").cast("long").alias("n_rows"),
        F.sum(F.when(F.col("predicted") == sentinel, F.col("n")).otherwise(0)).cast("long").alias("n_unparseable"),
    ).withColumn("unparseable_rate", _safe_div(F.col("n_unparseable"), F.col("n_rows")))
    return rounded(u, ["unparseable_rate"], places)


def macro_avg(oc: DataFrame, places: int | None = 6) -> DataFrame:
    """Unweighted mean of per-class P, R, F1 (mean of F1s, not F1 of means)."""
    r = class_report(oc).groupBy(ARM).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").cast("long").alias("support"))
    return rounded(r, ["precision", "recall", "f1"], places)


def weighted_avg(oc: DataFrame, places: int | None = 6) -> DataFrame:
    r = class_report(oc).groupBy(ARM).agg(
        _safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision"),
        _safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"),
        F.sum("support").cast("long").alias("support"))
    return rounded(r, ["precision", "recall", "f1"], places)


def micro_avg(oc: DataFrame, places: int | None = 6) -> DataFrame:
    """(arm, row_kind, precision, recall, f1, support).

    ``row_kind`` is ``accuracy`` when every prediction is a listed label (then all
    three equal accuracy) and ``micro avg`` otherwise, as in the reference's report.
    """
    in_set = F.col("support") > 0
    m = label_stats(oc).groupBy(ARM).agg(
        F.sum(F.when(in_set, F.col("tp")).otherwise(0)).alias("tp"),
        F.sum(F.when(in_set, F.col("n_predicted")).otherwise(0)).alias("in_label_pred"),
        F.sum("support").alias("support"))
    p = _safe_div(F.col("tp"), F.col("in_label_pred"))
    r = _safe_div(F.col("tp"), F.col("support"))
    m = m.select(
        ARM,
        F.when(F.col("in_label_pred") == F.col("support"), F.lit("accuracy"))
        .otherwise(F.lit("micro avg")).alias("row_kind"),
        p.alias("precision"), r.alias("recall"),
        _safe_div(2 * p * r, p + r).alias("f1"),
        F.col("support").cast("long").alias("support"))
    return rounded(m, ["precision", "recall", "f1"], places)


def confusion_matrix(oc: DataFrame) -> DataFrame:
    """(arm, actual, predicted, n) over label x label, zero cells present, out-of-label
    predictions dropped. The grid is as large as the result: each label of an arm with each."""
    grid = arm_labels(oc, "actual").join(arm_labels(oc, "predicted"), ARM)
    return grid.join(oc, [ARM, "actual", "predicted"], "left").select(
        ARM, "actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def confusion_cells(oc: DataFrame) -> DataFrame:
    """(arm, actual, predicted, n): the cells of the matrix that aren't zero, for label sets
    whose square is too large. Membership in the label set is a semi-join."""
    return oc.where(F.col("actual").isNotNull()).join(
        arm_labels(oc, "predicted"), [ARM, "predicted"], "left_semi").select(
        ARM, "actual", "predicted", F.col("n").cast("long").alias("n"))


def confusion_pivot(oc: DataFrame, labels: list[str]) -> DataFrame:
    """Wide form: one row per (arm, actual), one column per predicted label.

    ``labels`` must be given (the column set is part of the schema), which also spares
    Spark the extra job it would otherwise run to discover pivot values.
    """
    cm = confusion_matrix(oc)
    return cm.groupBy(ARM, "actual").pivot("predicted", labels).agg(F.sum("n")).fillna(0, labels)


def metrics_summary(oc: DataFrame, n_per_class: int | None = None,
                    model: str = "", eval_type: str = "", places: int | None = 6,
                    sentinel: str = UNPARSEABLE) -> DataFrame:
    """(arm, model, eval_type, n_samples, samples_per_class, accuracy, macro_f1,
    weighted_f1, unparseable_rate): the scalar part of the metric document, in one
    aggregation over the per-label statistics."""
    sc = _with_scores(label_stats(oc))
    in_set = F.col("support") > 0
    n = F.sum("support")
    agg = sc.groupBy(ARM).agg(
        n.cast("long").alias("n_samples"),
        _safe_div(F.sum("tp"), n).alias("accuracy"),
        F.avg(F.when(in_set, F.col("f1"))).alias("macro_f1"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"),
        _safe_div(F.sum(F.when(F.col("label") == sentinel, F.col("n_predicted")).otherwise(0)), n)
        .alias("unparseable_rate"),
    )
    agg = rounded(agg, ["accuracy", "macro_f1", "weighted_f1", "unparseable_rate"], places)
    spc = F.lit(n_per_class).cast("long") if n_per_class is not None else F.lit(None).cast("long")
    return agg.select(
        ARM, F.lit(model).alias("model"), F.lit(eval_type).alias("eval_type"), "n_samples",
        spc.alias("samples_per_class"), "accuracy", "macro_f1", "weighted_f1", "unparseable_rate")


def metrics_rounded(summary: DataFrame, places: int = 3) -> DataFrame:
    """The printed summary: the four headline metrics at ``places`` decimals."""
    return summary.select(
        ARM, *[F.round(c, places).alias(c) for c in
               ("accuracy", "macro_f1", "weighted_f1", "unparseable_rate")])


def report_entries(oc: DataFrame, places: int | None = None) -> DataFrame:
    """(arm, key, precision, recall, f1, support) -- per-class rows plus the average
    rows, keyed as in the reference's ``per_class_report``."""
    cls = classification_report(oc, places).select(ARM, F.col("label").alias("key"), "precision",
                                           "recall", "f1", F.col("support").cast("double"))
    mic = micro_avg(oc, places).select(ARM, F.col("row_kind").alias("key"), "precision", "recall", "f1",
                               F.col("support").cast("double"))
    mac = macro_avg(oc, places).select(ARM, F.lit("macro avg").alias("key"), "precision", "recall", "f1",
                               F.col("support").cast("double"))
    wei = weighted_avg(oc, places).select(ARM, F.lit("weighted avg").alias("key"), "precision", "recall",
                                  "f1", F.col("support").cast("double"))
    return cls.unionByName(mic).unionByName(mac).unionByName(wei)
