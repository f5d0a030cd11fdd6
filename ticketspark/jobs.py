"""End-to-end jobs on user paths: the reference's workflows as Spark jobs.

    python -m ticketspark.jobs prepare  --input tickets.parquet --output out/split --rejects out/rejects
    python -m ticketspark.jobs train    --split out/split --model nb --output out/model
    python -m ticketspark.jobs subset   --split out/split --per-class 60 --output out/subset
    python -m ticketspark.jobs evaluate --split out/split --per-class 10 --model nb --output out/eval
    python -m ticketspark.jobs compare  --baseline out/eval-a/metrics --tuned out/eval-b/metrics
    python -m ticketspark.jobs score    --requests in/ --format lines --model nb --model-path out/model \\
                                        --output out/responses --checkpoint ck/

Inputs are Parquet, JSON lines or CSV with a text column, a label column and a unique
row id (``--id-col``; when the input has none, one is derived from the row's contents).
Each job prints a one-line JSON summary and deletes the intermediates that it saved.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark.operators import dedup, metrics, predict, profile, split
from ticketspark.operators.labelmatch import decode_outputs
from ticketspark.session import apply_runtime_conf, materialize, release_saved, saved_paths
from ticketspark.sinks import writers
from ticketspark.sinks.manifest import clean, publish, read_published, versions
from ticketspark.sources.readers import load_tickets, read_tickets

TEXT, LABEL, ID = "instruction", "intent", "ticket_id"


def read_input(spark: SparkSession, path: str, fmt: str, text_col: str, label_col: str,
               id_col: str | None, schema: str | None = None) -> DataFrame:
    """The input with text, label and id under their own names and all other columns.

    ``schema`` declares the columns of JSON or CSV as DDL. Without one, JSON lines are read
    for the names of their columns first, and CSV for its header; all are strings then,
    nested ones as JSON. Records that can't be parsed are rows with their raw text in
    ``raw_record``. Parquet brings its own columns. Without an id column, ids are an order of
    the rows' own values: equal rows are told apart by their count, so the same rows get
    the same ids however the files are laid out.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        if schema is None and fmt == "json":
            fields = dict.fromkeys([text_col, label_col, *([id_col] if id_col else [])])
            taken = {c.lower() for c in fields}
            found = spark.read.option("primitivesAsString", "true").option("mode", "DROPMALFORMED").json(path).columns
            schema = ", ".join(f"`{c}` string" for c in [*fields, *(c for c in found if c.lower() not in taken)])
        elif schema is None:
            header = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path).columns
            schema = ", ".join(f"`{c}` string" for c in header)
        df = read_tickets(spark, path, fmt, T.StructType.fromDDL(schema), keep_malformed=True)
    df = df.withColumnRenamed(text_col, TEXT).withColumnRenamed(label_col, LABEL)
    if id_col:
        return df.withColumn(ID, F.col(id_col).cast("long"))
    every = F.concat_ws("|", *[F.coalesce(F.md5(F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns])
    one = df.withColumn("_h", F.xxhash64(every)).withColumn("_m", F.md5(every))
    # rows of one content differ in nothing, so which of them is first doesn't matter: they
    # are numbered in the parts that tasks saved, from where the parts before end
    one = materialize(one.withColumn("_part", F.spark_partition_id()), "jobs-numbered")
    before = Window.partitionBy("_h", "_m").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = one.groupBy("_h", "_m", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_h", "_m", "_part").orderBy("_m"))
    numbered = one.withColumn("_i", nth).join(parts, ["_h", "_m", "_part"])
    return numbered.select(*df.columns, F.xxhash64("_h", "_m", (F.col("_i") + F.col("_n")).cast("int")).alias(ID))


def prepare(spark, a) -> dict:
    df = materialize(read_input(spark, a.input, a.format, a.text_col, a.label_col, a.id_col, a.schema), "jobs-input")
    good, bad = load_tickets(df, TEXT, LABEL)
    rejected = {r["reject_reason"]: r["count"] for r in bad.groupBy("reject_reason").count().collect()}
    if a.rejects:
        bad.write.mode("overwrite").parquet(a.rejects)
    deduped = materialize(dedup.dedup_first(good), "jobs-dedup")
    sp = split.stratified_split(deduped, test_frac=a.test_fraction, seed=a.seed)
    # published as a whole: until then, and if it fails, an earlier split is read on
    counts = {k: n for k, (n, _) in publish(sp, a.output, "split").parts.items()}
    clean(spark, a.output)
    ext = profile.class_extremes(deduped).first()
    return {"rows": df.count(), "rejected": rejected, "after_dedup": deduped.count(),
            "train": counts.get("train", 0), "test": counts.get("test", 0),
            "smallest_class": [ext.smallest_intent, ext.smallest_n],
            "largest_class": [ext.largest_intent, ext.largest_n], "output": a.output}


def side(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A side of a split: of the newest published version, checked against its manifest, or
    of a plain table partitioned by split."""
    if versions(spark, path):
        return read_published(spark, path).where(F.col("split") == name).drop("split")
    return spark.read.parquet(os.path.join(path, f"split={name}"))


def subset(spark, a) -> dict:
    train = side(spark, a.split, "train")
    sub = (split.sample_capped(train, a.per_class, seed=a.seed) if a.capped
           else split.sample_strict(train, a.per_class, seed=a.seed))
    sub.write.mode("overwrite").parquet(a.output)
    back = spark.read.parquet(a.output)
    return {"classes": back.select(LABEL).distinct().count(), "rows": back.count(),
            "per_class": a.per_class, "output": a.output}


def evaluate(spark, a) -> dict:
    train, test = side(spark, a.split, "train"), side(spark, a.split, "test")
    rows = test if a.per_class <= 0 else split.sample_strict(test, a.per_class, seed=a.seed)
    rows = materialize(rows, "jobs-eval-rows")
    scored = scorer(spark, a.model, a.model_path, train)(rows, ID, TEXT, [LABEL])
    pred = scored.select(ID, LABEL, F.col("predicted_intent").alias("raw_output"))
    # labels from the evaluated rows, as in the reference; free text decoded leniently
    pred = materialize(decode_outputs(pred, "raw_output", rows, LABEL), "jobs-predictions")
    # the CSV has every column of the rows; ids are unique, as the split requires
    out = rows.join(pred.drop(LABEL), ID)
    writers.write_predictions_csv(out, os.path.join(a.output, "predictions"))
    oc = metrics.outcomes(pred, arm=None)
    doc = writers.metrics_document(oc, a.model, "evaluation", a.per_class if a.per_class > 0 else 0)
    writers.write_metrics_document(doc, os.path.join(a.output, "metrics"))
    s = metrics.metrics_summary(oc, places=3).first()
    return {"n_samples": s.n_samples, "accuracy": s.accuracy, "macro_f1": s.macro_f1,
            "weighted_f1": s.weighted_f1, "unparseable_rate": s.unparseable_rate,
            "output": a.output}


def scorer(spark, kind: str, path: str | None, train: DataFrame | None):
    """(rows, id_col, text_col, carry) -> rows with ``predicted_intent``, by keyword rules
    (from the train split's labels) or a model, loaded from ``path`` or fitted on train."""
    if kind == "keyword":
        rules = materialize(predict.keyword_rules(train.select(F.col(LABEL).alias("label"))), "jobs-rules")
        return lambda df, i, t, carry: predict.predict_keyword(df, rules, id_col=i, text_col=t, carry=carry)
    if kind == "nb":
        model = predict.load_naive_bayes(spark, path) if path else predict.fit_and_save_naive_bayes(train, "jobs-nb")
        return lambda df, i, t, carry: predict.predict_naive_bayes(
            model, df, id_col=i, text_col=t, carry=carry).drop("confidence", "margin")
    fitted = predict.load_logistic(path) if path else predict.fit_logistic(train.select(TEXT, LABEL))
    return lambda df, i, t, carry: predict.predict_logistic(fitted, df.select(
        i, t, *carry), text_col=t).select(i, *carry, "predicted_intent")


def train(spark, a) -> dict:
    rows = side(spark, a.split, "train")
    if a.model == "nb":
        predict.save_naive_bayes(predict.fit_and_save_naive_bayes(rows, "jobs-nb"), a.output)
    else:
        predict.save_logistic(predict.fit_logistic(rows.select(TEXT, LABEL)), a.output)
    return {"model": a.model, "rows": rows.count(), "output": a.output}


def score(spark, a) -> dict:
    from ticketspark.streaming.scoring import (
        request_line_stream, request_stream, start_appending, start_scoring)
    if a.append and a.model == "nb":
        raise ValueError("naive Bayes does not score row by row: leave --append out")
    rows = side(spark, a.labels, "train") if a.labels else None
    predictor = scorer(spark, a.model, a.model_path, rows)
    stream = (request_line_stream(spark, a.requests) if a.format == "lines"
              else request_stream(spark, a.requests, fmt=a.format))
    if a.append:
        # row by row: the file sink's own log says which responses count
        start_appending(stream, lambda df: predictor(df, "request_id", "text", ["message", "error_kind"]),
                        a.output, a.checkpoint).awaitTermination()
        return {"output": a.output, "responses": spark.read.parquet(a.output).count()}
    seen = {"batches": 0}

    def predict_batch(df: DataFrame) -> DataFrame:
        seen["batches"] += 1  # the progress log keeps the last hundred only
        return predictor(df, "request_id", "text", ["message", "error_kind"])

    start_scoring(stream, predict_batch, a.output, a.checkpoint, available_now=True).awaitTermination()
    return {"output": a.output, "batches": seen["batches"]}


def compare(spark, a) -> dict:
    from ticketspark.operators.compare import document_comparison
    from ticketspark.sources.readers import read_metrics_document
    rows = document_comparison(read_metrics_document(spark, a.baseline), read_metrics_document(spark, a.tuned))
    return {r["metric"]: [r["baseline"], r["tuned"], r["delta"]] for r in rows.collect()}


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ticketspark.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    pr = sub.add_parser("prepare", help="dedup + stratified split, written partitioned by split")
    pr.add_argument("--input", required=True)
    pr.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    pr.add_argument("--text-col", default=TEXT)
    pr.add_argument("--label-col", default=LABEL)
    pr.add_argument("--id-col", default=None)
    pr.add_argument("--schema", default=None, help="columns of JSON or CSV as DDL; spares a pass over JSON")
    pr.add_argument("--test-fraction", type=float, default=0.15)
    pr.add_argument("--seed", type=int, default=42)
    pr.add_argument("--output", required=True)
    pr.add_argument("--rejects", default=None, help="folder for rows without text or label, and broken records")
    tr = sub.add_parser("train", help="fit a model on the train split and save it")
    tr.add_argument("--split", required=True)
    tr.add_argument("--model", default="nb", choices=["nb", "lr"])
    tr.add_argument("--output", required=True)
    co = sub.add_parser("compare", help="two stored metric documents side by side")
    co.add_argument("--baseline", required=True)
    co.add_argument("--tuned", required=True)
    su = sub.add_parser("subset", help="n rows per class of the train split")
    su.add_argument("--split", required=True)
    su.add_argument("--per-class", type=int, default=60)
    su.add_argument("--capped", action="store_true", help="min(n, class size) instead of exactly n")
    su.add_argument("--seed", type=int, default=42)
    su.add_argument("--output", required=True)
    ev = sub.add_parser("evaluate", help="predict, decode, metrics JSON + predictions CSV")
    ev.add_argument("--split", required=True)
    ev.add_argument("--per-class", type=int, default=10, help="0 = every test row")
    ev.add_argument("--model", default="nb", choices=["nb", "lr", "keyword"])
    ev.add_argument("--model-path", default=None, help="a saved model; else one is fitted on train")
    ev.add_argument("--seed", type=int, default=42)
    ev.add_argument("--output", required=True)
    sc = sub.add_parser("score", help="score request files as a stream (availableNow)")
    sc.add_argument("--requests", required=True)
    sc.add_argument("--format", default="json", choices=["json", "parquet", "lines"],
                    help="lines: a request body per line, without an id")
    sc.add_argument("--model", default="keyword", choices=["keyword", "nb", "lr"])
    sc.add_argument("--model-path", default=None, help="a saved model")
    sc.add_argument("--labels", default=None, help="split folder, for keyword rules or to fit a model on")
    sc.add_argument("--output", required=True)
    sc.add_argument("--checkpoint", required=True)
    sc.add_argument("--append", action="store_true", help="an append stream (keyword rules and lr)")
    return p


JOBS = {"prepare": prepare, "train": train, "subset": subset, "evaluate": evaluate, "score": score,
        "compare": compare}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = build_parser().parse_args(argv)
    if spark is None:
        spark = SparkSession.builder.appName(f"ticketspark-{args.job}").getOrCreate()
    apply_runtime_conf(spark)
    before = len(saved_paths())
    try:
        result = JOBS[args.job](spark, args)
    finally:
        release_saved(spark, keep=before)  # the intermediates of this job only
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
