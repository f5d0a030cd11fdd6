"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (through the fixtures) over their whole extent.
Output columns are flat scalars with stable names; long texts that are outputs of a
builder (prompts, chats) are reported as md5 + length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.functions.decode import decode_raw
from ticketspark.functions.hashing import bucket
from ticketspark.functions.text import strip_ws
from ticketspark.operators import calibrate as CA
from ticketspark.operators import compare as C
from ticketspark.operators import dedup as D
from ticketspark.operators import labelmatch as LM
from ticketspark.operators import logistic as LT
from ticketspark.operators import metrics as M
from ticketspark.operators import predict as P
from ticketspark.operators import profile as PR
from ticketspark.operators import prompts as PT
from ticketspark.operators import serving as S
from ticketspark.operators import split as SP
from ticketspark.operators import vocab as V
from ticketspark.plans import shared as SH
from ticketspark.sinks import manifest as MF
from ticketspark.sinks import writers as W
from ticketspark.sources import fixtures as fx
from ticketspark.session import materialize
from ticketspark.sources.readers import with_reject_reason

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def wrap(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return wrap


# ------------------------------------------------------------------ A: sources

@query("load_tickets")
def q_load_tickets(spark, d):
    return with_reject_reason(fx.tickets(spark, d))


# ------------------------------------------------------------- B: vocabulary

@query("clean_messages")
def q_clean_messages(spark, d):
    return S.clean_messages(S.validate_requests(fx.requests(spark, d)))


@query("label_vocab")
def q_label_vocab(spark, d):
    return V.label_vocab(fx.tickets(spark, d))


@query("label_prompt_line")
def q_label_prompt_line(spark, d):
    return V.label_prompt_line(fx.tickets(spark, d))


@query("label_drift")
def q_label_drift(spark, d):
    sc = fx.scored(spark, d)
    return V.label_drift(sc.select("arm", F.col("intent").alias("label")),
                         sc.select("arm", decode_raw(F.col("raw_output")).alias("label")),
                         by=["arm"])


# -------------------------------------------------------------- C: profiling

@query("row_count")
def q_row_count(spark, d):
    return PR.row_count(fx.tickets(spark, d))


@query("intent_counts")
def q_intent_counts(spark, d):
    return PR.intent_counts(fx.tickets(spark, d))


@query("intent_cardinality")
def q_intent_cardinality(spark, d):
    return PR.intent_cardinality(fx.tickets(spark, d))


@query("class_extremes")
def q_class_extremes(spark, d):
    return PR.class_extremes(fx.tickets(spark, d))


@query("sample_rows")
def q_sample_rows(spark, d):
    return PR.sample_rows(fx.tickets(spark, d), 5, SH.SEED)


@query("class_balance")
def q_class_balance(spark, d):
    t = fx.tickets(spark, d)
    return PR.class_balance({"raw": t, "dedup": D.dedup_first(t)})


@query("length_profile")
def q_length_profile(spark, d):
    return PR.length_profile(fx.tickets(spark, d))


# ------------------------------------------------------------------ D: dedup

@query("dedup_tickets")
def q_dedup_tickets(spark, d):
    return D.dedup_first(fx.tickets(spark, d))


@query("dedup_report")
def q_dedup_report(spark, d):
    return D.dedup_report(fx.tickets(spark, d))


@query("duplicate_groups")
def q_duplicate_groups(spark, d):
    return D.duplicate_groups(fx.tickets(spark, d))


@query("label_conflicts")
def q_label_conflicts(spark, d):
    # the audit of the intent label, and one of the source: copies differ in the latter only
    return D.label_conflicts(fx.tickets(spark, d), label_cols=["intent", "category"])


# -------------------------------------------------------- E: split, sampling

@query("split_train")
def q_split_train(spark, d):
    return SH.side(SH.split_dedup(spark, d), "train").select("ticket_id", "intent")


@query("split_test")
def q_split_test(spark, d):
    return SH.side(SH.split_dedup(spark, d), "test").select("ticket_id", "intent")


@query("split_allocation")
def q_split_allocation(spark, d):
    return SP.split_allocation(SH.deduped(spark, d), seed=SH.SEED)


@query("sample_strict")
def q_sample_strict(spark, d):
    return SP.sample_strict(SH.side(SH.split_dedup(spark, d), "test"), SH.EVAL_PER_CLASS,
                            seed=SH.SEED).select("ticket_id", "intent")


@query("sample_capped")
def q_sample_capped(spark, d):
    return SP.sample_capped(SH.side(SH.split_dedup(spark, d), "train"), SH.SUBSET_CAP,
                            seed=SH.SEED).select("ticket_id", "intent")


@query("split_report")
def q_split_report(spark, d):
    return SP.split_report(SH.split_dedup(spark, d))


@query("arm_alignment")
def q_arm_alignment(spark, d):
    sc = fx.scored(spark, d)
    return SP.arm_alignment(sc.where("arm = 'A'"), sc.where("arm = 'B'"))


@query("leakage_row_split")
def q_leakage_row_split(spark, d):
    s = SH.split_rows(spark, d)
    return SP.leakage(SH.side(s, "train"), SH.side(s, "test"))


@query("leakage_dedup_split")
def q_leakage_dedup_split(spark, d):
    s = SH.split_dedup(spark, d)
    return SP.leakage(SH.side(s, "train"), SH.side(s, "test"))


@query("accuracy_by_leak")
def q_accuracy_by_leak(spark, d):
    # every test row of the leaky split, and the per-class sample of them that an arm with
    # a costly model would be scored on
    s = SH.split_rows(spark, d)
    test = SH.side(s, "test").select("ticket_id", "instruction", "intent")
    flagged = materialize(SP.flag_leaked(test, SH.side(s, "train")), "flagged")
    pred = P.predict_naive_bayes(SH.nb_model(spark, d, "rowsplit"), flagged, carry=["intent", "leaked"])
    pred = materialize(pred.select("ticket_id", "intent", "leaked", "predicted_intent"), "leak-predictions")
    sample = SP.sample_capped(pred, SH.EVAL_PER_CLASS, seed=SH.SEED)
    return SP.accuracy_by_leak(pred).withColumn("rows_of", F.lit("all")).unionByName(
        SP.accuracy_by_leak(sample).withColumn("rows_of", F.lit("sample")))


@query("split_fingerprint")
def q_split_fingerprint(spark, d):
    return SP.split_fingerprint(SH.split_dedup(spark, d))


# ------------------------------------------------------------- F: prompts

def _text_digest(col: str, prefix: str) -> list:
    """md5 and length of a built text (the text itself can be long)."""
    return [F.md5(F.col(col)).alias(f"{prefix}_md5"), F.length(col).cast("long").alias(f"{prefix}_chars")]


@query("sft_examples")
def q_sft_examples(spark, d):
    train = SH.side(SH.split_dedup(spark, d), "train")
    ex = PT.sft_examples(train, train)
    return ex.select("ticket_id", "intent", *_text_digest("text", "text"))


@query("inference_prompts")
def q_inference_prompts(spark, d):
    test = SH.side(SH.split_dedup(spark, d), "test")
    p = PT.inference_prompts(test, test)
    return p.select("ticket_id", *_text_digest("prompt", "prompt"))


@query("render_chat")
def q_render_chat(spark, d):
    c = PT.render_chat(fx.chat(spark, d))
    return c.select("conv_id", "n_turns", *_text_digest("chat", "chat"))


@query("truncate_examples")
def q_truncate_examples(spark, d):
    train = SH.side(SH.split_dedup(spark, d), "train")
    t = PT.truncate_examples(PT.sft_examples(train, train), SH.MAX_TOKENS)
    return t.select("ticket_id", "n_tokens", "truncated", *_text_digest("text_cut", "cut"))


# ------------------------------------------------------- G: predict, decode

@query("predict_batch")
def q_predict_batch(spark, d):
    test = SH.side(SH.split_dedup(spark, d), "test").select("ticket_id", "intent", "instruction")
    train = SH.side(SH.split_dedup(spark, d), "train")
    # a model on the driver needs its label set there, which the guard of the array bounds
    labels = spark.range(1).select(V.label_array(train).alias("labels")).first()["labels"]
    raw = P.predict_batch(test, P.KeywordPredictor(labels), "instruction", keep=["ticket_id", "intent"])
    return LM.decode_outputs(raw, "raw_output", train, "intent").select(
        "ticket_id", "intent", "raw_output", "predicted_intent")


@query("predict_keyword")
def q_predict_keyword(spark, d):
    s = SH.split_dedup(spark, d)
    rules = SH.keyword_rules_for(SH.side(s, "train"))
    return P.predict_keyword(SH.side(s, "test").select("ticket_id", "intent", "instruction"),
                             rules, carry=["intent"])


def _nb_test_predictions(spark, d) -> DataFrame:
    """Naive Bayes predictions for every held-out row, saved once per session (as the
    reference saves its predictions) and shared by prediction, routing and automation."""
    def build():
        test = SH.side(SH.split_dedup(spark, d), "test").select("ticket_id", "intent", "instruction")
        p = P.predict_naive_bayes(SH.nb_model(spark, d), test, carry=["intent"])
        return materialize(p.select("ticket_id", "intent", "predicted_intent", "confidence"),
                           "nb-test-predictions")
    return SH.memo(spark, d, "nb-test-predictions", build)


@query("predict_nb")
def q_predict_nb(spark, d):
    p = _nb_test_predictions(spark, d)
    return p.select("ticket_id", "intent", "predicted_intent",
                    F.round("confidence", 6).alias("confidence"))


@query("predict_lr")
def q_predict_lr(spark, d):
    """Is each held-out row's prediction a train label? And, as row -1, is the held-out
    accuracy above the majority class's share? (The coefficients are beyond SQL.)"""
    s = SH.split_dedup(spark, d)
    train, test = SH.side(s, "train"), SH.side(s, "test").select("ticket_id", "intent", "instruction")
    fitted = P.fit_logistic(train.select("instruction", "intent"))
    return _checked_lr(spark, d, P.predict_logistic(fitted, test))


@query("predict_lr_table")
def q_predict_lr_table(spark, d):
    """The same of the fit whose coefficients are a table of blocks, every token a feature."""
    s = SH.split_dedup(spark, d)
    train, test = SH.side(s, "train"), SH.side(s, "test").select("ticket_id", "intent", "instruction")
    model = LT.fit_logistic_table(train.select("instruction", "intent"), reg=1e-2, tol=1e-2)
    return _checked_lr(spark, d, LT.predict_logistic_table(model, test))


def _checked_lr(spark, d, predicted: DataFrame) -> DataFrame:
    pred = materialize(predicted.select("ticket_id", "intent", "predicted_intent"), "lr")
    rows = pred.withColumn("_labels", SH.train_labels(spark, d)).select(
        "ticket_id", "intent", F.array_contains("_labels", F.col("predicted_intent")).alias("ok"))
    hits = pred.groupBy("intent").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("predicted_intent") == F.col("intent"), 1)).alias("k"))
    whole = hits.agg(F.sum("k").alias("k"), F.max("n").alias("most")).select(
        F.lit(-1).cast("long").alias("ticket_id"), F.lit("(all)").alias("intent"),
        (F.col("k") > F.col("most")).alias("ok"))
    return rows.unionByName(whole)


def _decoded(spark, d) -> DataFrame:
    # decoded once per session, for the decoding query and the metrics alike
    def build():
        sc = fx.scored(spark, d)
        return materialize(LM.decode_outputs(sc, "raw_output", sc, "intent"), "decoded")
    return SH.memo(spark, d, "decoded", build)


@query("decode_lenient")
def q_decode_lenient(spark, d):
    return _decoded(spark, d).select("ticket_id", "arm", "intent", "raw_output", "predicted_intent")


@query("decode_strict")
def q_decode_strict(spark, d):
    sc = fx.scored(spark, d)
    return LM.flag_labels(sc, strip_ws(F.col("raw_output")), sc, "intent").select("ticket_id", "arm", "is_label")


@query("decode_raw")
def q_decode_raw(spark, d):
    return fx.scored(spark, d).select("ticket_id", "arm", decode_raw(F.col("raw_output")).alias("output"))


# ------------------------------------------------------------ H: metrics

def _oc(spark, d) -> DataFrame:
    # the outcome count of the decoded scored table is saved once per session (like
    # the reference's saved predictions); every metric reads that small table
    return SH.memo(spark, d, "scored-outcomes",
                   lambda: materialize(M.outcomes(_decoded(spark, d)), "scored-outcomes"))


@query("accuracy")
def q_accuracy(spark, d):
    return M.accuracy(_oc(spark, d))


@query("classification_report")
def q_classification_report(spark, d):
    return M.classification_report(_oc(spark, d))


@query("macro_avg")
def q_macro_avg(spark, d):
    return M.macro_avg(_oc(spark, d))


@query("weighted_avg")
def q_weighted_avg(spark, d):
    return M.weighted_avg(_oc(spark, d))


@query("micro_avg")
def q_micro_avg(spark, d):
    return M.micro_avg(_oc(spark, d))


@query("confusion_matrix")
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(_oc(spark, d))


@query("confusion_cells")
def q_confusion_cells(spark, d):
    return M.confusion_cells(_oc(spark, d))


@query("confusion_pivot")
def q_confusion_pivot(spark, d):
    return M.confusion_pivot(_oc(spark, d), fx.EVENT_TYPES)


@query("unparseable_rate")
def q_unparseable_rate(spark, d):
    return M.unparseable_rate(_oc(spark, d))


@query("metrics_summary")
def q_metrics_summary(spark, d):
    # samples_per_class 0: every row was evaluated, no per-class sampling
    return M.metrics_summary(_oc(spark, d), 0, "scored-outputs", "full table")


@query("metrics_rounded")
def q_metrics_rounded(spark, d):
    return M.metrics_rounded(M.metrics_summary(_oc(spark, d)))


DOC_SCALARS = ["arm", "model", "eval_type", "n_samples", "samples_per_class", "accuracy",
               "macro_f1", "weighted_f1", "unparseable_rate"]
DOC_SCORES = ["accuracy", "macro_f1", "weighted_f1", "unparseable_rate", "precision", "recall", "f1"]


def _doc(spark, d) -> DataFrame:
    # samples_per_class 0: every row was evaluated, no per-class sampling
    return W.metrics_document(_oc(spark, d), "scored-outputs", "full table", 0)


def _flat_doc(entries: DataFrame) -> DataFrame:
    return entries.select(*[F.round(c, 6).alias(c) if c in DOC_SCORES else F.col(c)
                            for c in DOC_SCALARS + ["key", "precision", "recall", "f1", "support"]])


@query("metrics_document")
def q_metrics_document(spark, d):
    doc = _doc(spark, d)
    e = doc.select(*DOC_SCALARS, F.explode("per_class_report").alias("key", "v"))
    return _flat_doc(e.select(*DOC_SCALARS, "key", F.col("v.precision").alias("precision"),
                              F.col("v.recall").alias("recall"), F.col("v.f1-score").alias("f1"),
                              F.col("v.support").alias("support")))


@query("metrics_reload")
def q_metrics_reload(spark, d):
    from ticketspark.sources.readers import read_metrics_document
    path = _out_path(spark, "metrics-doc")
    W.write_metrics_document(_doc(spark, d), path)
    return _flat_doc(read_metrics_document(spark, path))


def _out_path(spark, name: str) -> str:
    import os
    import uuid

    from ticketspark.session import checkpoint_root
    return os.path.join(checkpoint_root(spark), f"tables/{name}-{uuid.uuid4().hex}")


@query("split_roundtrip")
def q_split_roundtrip(spark, d):
    """A3: the split published as one Parquet dataset partitioned by split, read back and
    checked against its manifest."""
    path = _out_path(spark, "split-out")
    MF.publish(SH.split_dedup(spark, d), path, "split")
    back = MF.read_published(spark, path)
    return back.select("ticket_id", "intent", "split", F.md5("instruction").alias("text_md5"))


@query("predictions_csv")
def q_predictions_csv(spark, d):
    """A4: evaluation predictions (multi-line texts included) written as CSV, read back."""
    from ticketspark.sources.readers import read_tickets
    arms = SH.eval_arms(spark, d)
    path = _out_path(spark, "predictions-csv")
    W.write_predictions_csv(arms, path)
    back = read_tickets(spark, path, fmt="csv", schema=arms.schema)
    return back.select("arm", "ticket_id", "intent", "predicted_intent",
                       F.md5("instruction").alias("text_md5"))


# ------------------------------------------------- I: comparison, errors

def _eval_oc(spark, d) -> DataFrame:
    return M.outcomes(SH.eval_arms(spark, d))


@query("arm_comparison")
def q_arm_comparison(spark, d):
    return C.arm_comparison(_eval_oc(spark, d), "zero_shot", "tuned")


@query("document_comparison")
def q_document_comparison(spark, d):
    """The two arms' metric documents, written, read back and compared."""
    from ticketspark.sources.readers import read_metrics_document
    oc = materialize(_eval_oc(spark, d), "eval-outcomes")
    docs = []
    for arm in ("zero_shot", "tuned"):
        path = _out_path(spark, f"metrics-{arm}")
        W.write_metrics_document(W.metrics_document(oc.where(F.col("arm") == arm), arm, "test split", 0), path)
        docs.append(read_metrics_document(spark, path))
    return C.document_comparison(*docs)


@query("failed_classes")
def q_failed_classes(spark, d):
    return C.failed_classes(_eval_oc(spark, d))


@query("top_classes")
def q_top_classes(spark, d):
    return C.top_classes(_eval_oc(spark, d), 1)


@query("dominant_confusion")
def q_dominant_confusion(spark, d):
    return C.dominant_confusion(_eval_oc(spark, d))


@query("misses")
def q_misses(spark, d):
    return C.misses(SH.eval_arms(spark, d)).select(
        "arm", "ticket_id", "intent", "predicted_intent", F.md5("instruction").alias("text_md5"))


@query("prediction_coverage")
def q_prediction_coverage(spark, d):
    return C.prediction_coverage(_eval_oc(spark, d))


@query("run_agreement")
def q_run_agreement(spark, d):
    e = SH.eval_arms(spark, d)
    return C.run_agreement(e.where("arm = 'zero_shot'"), e.where("arm = 'tuned'"))


@query("class_delta")
def q_class_delta(spark, d):
    return C.class_delta(_eval_oc(spark, d), "zero_shot", "tuned")


# -------------------------------------------------------------- J: serving

@query("validate_requests")
def q_validate_requests(spark, d):
    return S.validate_requests(fx.requests(spark, d))


@query("validate_props_requests")
def q_validate_props_requests(spark, d):
    # the events' own JSON column as request bodies, message under key "k"
    return S.validate_requests(fx.props_requests(spark, d), key="k")


def event_label_rules(spark, d) -> DataFrame:
    """Keyword rules of the endpoint's declared labels (the event types)."""
    return SH.keyword_rules_for(fx.read_table(spark, d, "events"), "event_type")


@query("score_requests")
def q_score_requests(spark, d):
    rules = event_label_rules(spark, d)
    return S.score_requests(fx.requests(spark, d), lambda df: P.predict_keyword(
        df, rules, id_col="request_id", text_col="text", carry=["message", "error_kind"]))


def _routed(spark, d) -> DataFrame:
    return S.route(_nb_test_predictions(spark, d), SH.side(SH.split_dedup(spark, d), "train"), SH.ROUTE_THRESHOLD)


@query("route_tickets")
def q_route_tickets(spark, d):
    return _routed(spark, d).select("ticket_id", "intent", "predicted_intent",
                                    F.round("confidence", 6).alias("confidence"), "auto", "routed_to")


@query("out_of_scope_audit")
def q_out_of_scope_audit(spark, d):
    test = SH.side(SH.split_dedup(spark, d), "test").select(
        "ticket_id", "instruction", F.lit(True).alias("in_scope"))
    off = fx.offtopic(spark, d).select("ticket_id", "instruction", F.lit(False).alias("in_scope"))
    msgs = test.unionByName(off)
    p = P.predict_naive_bayes(SH.nb_model(spark, d), msgs, carry=["in_scope"])
    train = SH.side(SH.split_dedup(spark, d), "train")
    r = S.route(p, train, SH.ROUTE_THRESHOLD)
    # both arms come from one prediction
    arms = r.select("in_scope", F.explode(F.array(
        F.struct(F.lit("forced").alias("arm"), F.col("predicted_intent").alias("output")),
        F.struct(F.lit("routed").alias("arm"), F.col("routed_to").alias("output")))).alias("a"))
    return S.out_of_scope_audit(arms.select("in_scope", "a.arm", "a.output"), train, "output")


@query("automation_rate")
def q_automation_rate(spark, d):
    return S.automation_rate(_routed(spark, d))


def _quality_predictions(spark, d) -> DataFrame:
    """Naive Bayes for the two-class quality label, fitted on half of the labelled documents;
    of the others, half calibrate the confidence (``fit``) and half are ``unseen``."""
    def build():
        t = fx.tickets2(spark, d).select("ticket_id", "intent", "instruction").withColumn(
            "_b", bucket("Q", "ticket_id"))
        t = materialize(t, "quality-tickets")
        model = P.fit_and_save_naive_bayes(t.where(F.col("_b") < 8), "nb-quality")
        held = t.where(F.col("_b") >= 8).withColumn("part", F.when(F.col("_b") < 12, "fit").otherwise("unseen"))
        p = P.predict_naive_bayes(model, held, carry=["intent", "part"])
        return materialize(p.select("part", (F.col("predicted_intent") == F.col("intent")).alias("ok"), "confidence"),
                           "quality-predictions")
    return SH.memo(spark, d, "quality-predictions", build)


@query("reliability")
def q_reliability(spark, d):
    p = _quality_predictions(spark, d)
    cal = CA.fit(p.where("part = 'fit'"), F.col("ok"), bins=SH.RELIABILITY_BINS)
    return CA.reliability(p, F.col("ok"), cal, by=["part"])


@query("calibrated_routing")
def q_calibrated_routing(spark, d):
    p = _quality_predictions(spark, d)
    cal = CA.fit(p.where("part = 'fit'"), F.col("ok"))
    return CA.calibrated_routing(p.where("part = 'unseen'"), F.col("ok"), cal, SH.WANTED_ACCURACY)


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
