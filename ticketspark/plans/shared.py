"""Shared, materialised intermediates for the registered queries.

Several queries start from the same derived tables: the deduplicated tickets, the
stratified split (with and without dedup), the two evaluation arms and the fitted
naive Bayes models. Each is written once per session under the checkpoint
folder (like the reference's train/test Parquet files and saved model) and re-read
by later queries, instead of re-deriving its lineage in every plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.operators import dedup, predict, split
from ticketspark.operators.vocab import label_array
from ticketspark.session import apply_runtime_conf, materialize
from ticketspark.sources import fixtures as fx
from ticketspark.sources.readers import load_tickets

EVAL_PER_CLASS = 10
SUBSET_CAP = 370
MAX_TOKENS = 192
ROUTE_THRESHOLD = 0.9
RELIABILITY_BINS = 20
WANTED_ACCURACY = [0.85, 0.9, 0.95, 0.99]
SEED = 42

_memo: dict[tuple, object] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), _state(spark, sf_dir), name)


def _state(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes with any input file's path, length or modification time."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files, seen = fs.listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(seen)))


def memo(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    k = _key(spark, sf_dir, name)
    if k not in _memo:
        apply_runtime_conf(spark)
        _memo[k] = build()
    return _memo[k]


def tickets(spark, d) -> DataFrame:
    """The usable tickets: every pipeline starts from the valid side of the reject path."""
    return load_tickets(fx.tickets(spark, d))[0]


def deduped(spark, d) -> DataFrame:
    return memo(spark, d, "dedup", lambda: materialize(dedup.dedup_first(tickets(spark, d)), "dedup"))


def split_dedup(spark, d) -> DataFrame:
    """Deduplicated tickets with ``split`` (the current, leak-free split)."""
    return memo(spark, d, "split", lambda: materialize(
        split.stratified_split(deduped(spark, d), seed=SEED), "split", ["split"]))


def split_rows(spark, d) -> DataFrame:
    """Split of the raw rows without dedup (the superseded, leaky split)."""
    return memo(spark, d, "rowsplit", lambda: materialize(
        split.stratified_split(tickets(spark, d), seed=SEED), "rowsplit", ["split"]))


def side(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name).drop("split")


def nb_model(spark, d, which: str = "split") -> predict.NaiveBayesModel:
    def build():
        src = split_dedup(spark, d) if which == "split" else split_rows(spark, d)
        return predict.fit_and_save_naive_bayes(side(src, "train"), f"nb-{which}")
    return memo(spark, d, f"nb-{which}", build)


def train_labels(spark, d):
    """Scalar subquery: sorted labels of the train split."""
    return label_array(side(split_dedup(spark, d), "train"))


def keyword_rules_for(df: DataFrame, label_col: str = "intent") -> DataFrame:
    return predict.keyword_rules(df.select(F.col(label_col).alias("label")))


def eval_arms(spark, d) -> DataFrame:
    """(ticket_id, intent, instruction, arm, predicted_intent) for both arms on every
    held-out row: ``zero_shot`` keyword rules vs. ``tuned`` naive Bayes. (The
    reference compares its arms on a 10-per-class sample to save model time; here
    the full test split is scored, and the sample operator itself is ``sample_strict``.)"""
    def build():
        ev = side(split_dedup(spark, d), "test").select("ticket_id", "intent", "instruction")
        rules = keyword_rules_for(side(split_dedup(spark, d), "train"))
        zs = predict.predict_keyword(ev, rules, carry=["intent"]).withColumn("arm", F.lit("zero_shot"))
        nb = predict.predict_naive_bayes(nb_model(spark, d), ev, carry=["intent"]).select(
            "ticket_id", "intent", "predicted_intent").withColumn("arm", F.lit("tuned"))
        both = zs.unionByName(nb).join(ev.select("ticket_id", "instruction"), "ticket_id")
        return materialize(both, "eval-arms")
    return memo(spark, d, "eval-arms", build)
