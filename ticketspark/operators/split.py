"""Stratified split, per-class samples, leakage audits.

Sizes follow the reference's contract: the test side holds ``ceil(frac * N)`` rows;
each class gets the floor of its proportional share and the remaining rows go to the
classes with the largest fractional parts (ties: label order). Which rows go where is
decided by the seeded md5 order, so the split is reproducible on any cluster layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketspark.functions.hashing import fingerprint_term
from ticketspark.operators import quota as Q
from ticketspark.operators.textkeys import text_groups
from ticketspark.session import materialize

TEST_FRACTION = 0.15


def allocation(sizes: DataFrame, test_frac: float = TEST_FRACTION) -> DataFrame:
    """(g, n_rows, n_test, n_train) by largest remainder on the test shares.

    ``sizes`` is (g, n_rows), one row per class: every window here runs over that
    small table only.
    """
    all_rows = Window.partitionBy()
    a = sizes.withColumn("_N", F.sum("n_rows").over(all_rows))
    a = a.withColumn("_T", F.ceil(F.col("_N").cast("double") * F.lit(float(test_frac))))
    a = a.withColumn("_share", F.col("n_rows").cast("double") * F.col("_T") / F.col("_N"))
    a = a.withColumn("_floor", F.floor("_share"))
    a = a.withColumn("_left", F.col("_T") - F.sum("_floor").over(all_rows))
    order = Window.orderBy(F.desc(F.col("_share") - F.col("_floor")), F.asc("g"))
    a = a.withColumn("_rk", F.row_number().over(order))
    n_test = (F.col("_floor") + F.when(F.col("_rk") <= F.col("_left"), 1).otherwise(0)).cast("long")
    return a.select("g", "n_rows", n_test.alias("n_test"),
                    (F.col("n_rows") - n_test).alias("n_train"))


def stratified_split(df: DataFrame, label_col: str = "intent", id_col: str = "ticket_id",
                     test_frac: float = TEST_FRACTION, seed: int = 42,
                     digits: int | None = None) -> DataFrame:
    """``df`` plus ``split`` ('train' | 'test'). Disjoint and exhaustive.

    ``df`` is scanned three times (histogram, cut bucket, final pass); pass a table
    that is cheap to re-read (a Parquet scan, or a materialised intermediate).
    """
    k = Q.keyed(df, label_col, id_col, seed)
    digits = digits or Q.digits_for(k)
    hist = materialize(Q.histogram(k, digits), "histogram")
    alloc = allocation(Q.class_sizes(hist), test_frac)
    ct = Q.cuts(k, hist, alloc.select("g", F.col("n_test").alias("quota")), digits)
    flagged = Q.within_cut(df, ct, label_col, id_col, seed, "_is_test")
    return flagged.withColumn(
        "split", F.when(F.col("_is_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_is_test")


def split_allocation(df: DataFrame, label_col: str = "intent", id_col: str = "ticket_id",
                     test_frac: float = TEST_FRACTION, seed: int = 42) -> DataFrame:
    """(intent, n_rows, n_test, n_train)."""
    hist = Q.histogram(Q.keyed(df, label_col, id_col, seed))
    return allocation(Q.class_sizes(hist), test_frac).withColumnRenamed("g", label_col)


def sample_strict(df: DataFrame, n: int, label_col: str = "intent", id_col: str = "ticket_id",
                  seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of every class; the query fails if a class is smaller."""
    def quota(size: Column) -> Column:
        return F.when(size < F.lit(n), F.raise_error(
            F.concat(F.lit(f"class has fewer than {n} rows: "), size.cast("string")))
        ).otherwise(F.lit(n).cast("long"))
    return Q.first_per_group(df, label_col, id_col, quota, seed)


def sample_capped(df: DataFrame, n: int, label_col: str = "intent", id_col: str = "ticket_id",
                  seed: int = 42) -> DataFrame:
    """``min(n, class size)`` rows of every class."""
    return Q.first_per_group(df, label_col, id_col,
                             lambda size: F.least(size, F.lit(n).cast("long")), seed)


def split_report(df: DataFrame, split_col: str = "split", label_col: str = "intent") -> DataFrame:
    """(split, n_rows, n_intents)."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.count_distinct(label_col).alias("n_intents"))


def arm_alignment(left: DataFrame, right: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """(n_both, n_left_only, n_right_only) of two row-id sets.

    A full outer join on ids, expressed as one grouped pass over the tagged union.
    """
    lids = left.select(F.col(id_col).alias("_id"), F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    rids = right.select(F.col(id_col).alias("_id"), F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    g = lids.unionByName(rids).groupBy("_id").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return g.agg(
        F.count(F.when((F.col("_l") == 1) & (F.col("_r") == 1), 1)).alias("n_both"),
        F.count(F.when((F.col("_l") == 1) & (F.col("_r") == 0), 1)).alias("n_left_only"),
        F.count(F.when((F.col("_l") == 0) & (F.col("_r") == 1), 1)).alias("n_right_only"),
    )


def leakage(train: DataFrame, test: DataFrame, text_col: str = "instruction") -> DataFrame:
    """(n_test, n_leaked, leak_rate): test rows whose exact text also occurs in train.

    One grouped pass over the tagged union of both sides by the texts' digests: per text,
    the number of test copies and whether any train copy exists (combined within tasks, so a
    text repeated a million times is one partial row per task), then a global sum.
    """
    both = test.select(F.col(text_col).alias("_t"), F.lit(False).alias("_train")).unionByName(
        train.select(F.col(text_col).alias("_t"), F.lit(True).alias("_train")))
    per_text = text_groups(both, "_t", [F.col("_train")]).groupBy("_key").agg(
        F.sum(F.when(~F.col("_train"), F.col("_n")).otherwise(0)).alias("_n"), F.max("_train").alias("_train"))
    return per_text.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_test"),
        F.coalesce(F.sum(F.when(F.col("_train"), F.col("_n"))), F.lit(0)).cast("long").alias("n_leaked"),
    ).withColumn("leak_rate", F.round(
        F.when(F.col("n_test") > 0, F.col("n_leaked") / F.col("n_test")).otherwise(F.lit(0.0)), 6))


def flag_leaked(rows: DataFrame, train: DataFrame, text_col: str = "instruction") -> DataFrame:
    """``rows`` plus ``leaked``: its text occurs in ``train``. Only digests of the texts are
    shuffled (two, so that different texts don't meet), one of a text from each task."""
    def key(c):
        return F.concat(F.md5(c), F.xxhash64(c).cast("string"))
    train_texts = train.select(key(F.col(text_col)).alias("_k")).distinct().withColumn("leaked", F.lit(True))
    return rows.withColumn("_k", key(F.col(text_col))).join(train_texts, "_k", "left").drop("_k").withColumn(
        "leaked", F.coalesce(F.col("leaked"), F.lit(False)))


def accuracy_by_leak(predicted: DataFrame, label_col: str = "intent",
                     pred_col: str = "predicted_intent") -> DataFrame:
    """(leaked, n_rows, n_correct, accuracy) of rows that :func:`flag_leaked` has flagged."""
    correct = (F.col(pred_col) == F.col(label_col)).cast("long")
    return predicted.groupBy("leaked").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(correct).cast("long").alias("n_correct"),
    ).withColumn("accuracy", F.round(F.col("n_correct") / F.col("n_rows"), 6))


def split_fingerprint(df: DataFrame, split_col: str = "split", text_col: str = "instruction",
                      label_col: str = "intent", id_col: str = "ticket_id") -> DataFrame:
    """(split, n_rows, fingerprint): order-insensitive fingerprint of ids, labels and texts.

    Terms are 60-bit integers, summed as DECIMAL(38, 0), which no table overflows; the sum
    is returned as text, as not every engine has integers of that size.
    """
    term = fingerprint_term([F.col(id_col), F.col(label_col), F.col(text_col)])
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(term.cast("decimal(28,0)")).cast("string").alias("fingerprint"))
