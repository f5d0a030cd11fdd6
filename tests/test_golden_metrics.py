"""Golden metrics: prediction tables rebuilt from the marginals of the reference's
stored metric documents; every metric must reproduce the stored value (SURVEY 5.2)."""

import pytest
from pyspark.sql import functions as F

from ticketspark.operators import metrics as M
from test_decode import LABELS

# Fixed values from the reference's stored results (10 rows per class):
# per class (true positives, in-label predictions of that label).
BASELINE = {
    "cancel_order": (10, 15), "change_order": (8, 12), "change_shipping_address": (10, 27),
    "check_cancellation_fee": (9, 10), "check_invoice": (10, 26), "check_payment_methods": (10, 13),
    "check_refund_policy": (10, 25), "complaint": (10, 14), "contact_customer_service": (3, 3),
    "contact_human_agent": (10, 16), "create_account": (3, 3), "delete_account": (5, 5),
    "delivery_options": (8, 8), "delivery_period": (1, 2), "edit_account": (0, 1),
    "get_invoice": (0, 0), "get_refund": (0, 0), "newsletter_subscription": (6, 6),
    "payment_issue": (10, 10), "place_order": (9, 11), "recover_password": (7, 7),
    "registration_problems": (9, 25), "review": (7, 7), "set_up_shipping_address": (0, 0),
    "switch_account": (1, 1), "track_order": (2, 11), "track_refund": (1, 1),
}
FINETUNED = {lab: (10, 10) for lab in LABELS}
FINETUNED["edit_account"] = (10, 11)
FINETUNED["registration_problems"] = (9, 9)

# Stored metrics of the two arms.
EXPECTED = {
    "baseline": dict(accuracy=0.5888888888888889, macro_f1=0.5383268818193513,
                     weighted_f1=0.5383268818193513, unparseable_rate=0.040740740740740744,
                     micro=("micro avg", 0.6138996138996139, 0.5888888888888889, 0.6011342155009451),
                     macro_p=0.642845761919836, macro_r=0.5888888888888888),
    "finetuned": dict(accuracy=0.9962962962962963, macro_f1=0.9962870138308736,
                      weighted_f1=0.9962870138308736, unparseable_rate=0.0,
                      micro=("accuracy", 0.9962962962962963, 0.9962962962962963, 0.9962962962962963),
                      macro_p=0.9966329966329966, macro_r=0.9962962962962962),
}


def rebuild(marginals, arm, support=10):
    """Rows (arm, id, intent, predicted) with the given per-class TP and predicted counts."""
    fp_left = {lab: npred - tp for lab, (tp, npred) in marginals.items()}
    rows, rid = [], 0
    for lab in sorted(marginals):
        tp = marginals[lab][0]
        for i in range(support):
            if i < tp:
                pred = lab
            else:
                cands = [l for l, n in fp_left.items() if n > 0 and l != lab]
                if cands:
                    pred = max(cands, key=lambda l: (fp_left[l], l))
                    fp_left[pred] -= 1
                else:
                    pred = "UNPARSEABLE"
            rows.append((arm, rid, lab, pred))
            rid += 1
    assert all(v == 0 for v in fp_left.values())
    return rows


@pytest.fixture(scope="module")
def oc(spark):
    rows = rebuild(BASELINE, "baseline") + rebuild(FINETUNED, "finetuned")
    df = spark.createDataFrame(rows, "arm string, ticket_id long, intent string, predicted_intent string")
    return M.outcomes(df).cache()


@pytest.mark.parametrize("arm", ["baseline", "finetuned"])
def test_headline(oc, arm):
    exp = EXPECTED[arm]
    s = M.metrics_summary(oc, 10, places=None).where(F.col("arm") == arm).first()
    assert s.n_samples == 270 and s.samples_per_class == 10
    for k in ("accuracy", "macro_f1", "weighted_f1", "unparseable_rate"):
        assert getattr(s, k) == pytest.approx(exp[k], abs=1e-12), k


@pytest.mark.parametrize("arm", ["baseline", "finetuned"])
def test_micro_and_macro(oc, arm):
    exp = EXPECTED[arm]
    m = M.micro_avg(oc, None).where(F.col("arm") == arm).first()
    assert m.row_kind == exp["micro"][0]
    assert (m.precision, m.recall, m.f1) == pytest.approx(exp["micro"][1:], abs=1e-12)
    mac = M.macro_avg(oc, None).where(F.col("arm") == arm).first()
    assert mac.precision == pytest.approx(exp["macro_p"], abs=1e-12)
    assert mac.recall == pytest.approx(exp["macro_r"], abs=1e-12)


def test_failed_classes_baseline(oc):
    r = M.class_report(oc).where("arm = 'baseline' AND f1 = 0").select("label").collect()
    assert sorted(x.label for x in r) == ["edit_account", "get_invoice", "get_refund",
                                         "set_up_shipping_address"]


def test_recall_weighted_equals_accuracy(oc):
    w = {r.arm: r.recall for r in M.weighted_avg(oc, None).collect()}
    a = {r.arm: r.accuracy for r in M.accuracy(oc, None).collect()}
    for arm in w:
        assert w[arm] == pytest.approx(a[arm], abs=1e-12)


def test_confusion_rows_plus_out_of_label_equal_support(oc):
    cm = M.confusion_matrix(oc).groupBy("arm", "actual").agg(F.sum("n").alias("in_label"))
    sup = oc.groupBy("arm", "actual").agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("predicted") == "UNPARSEABLE", F.col("n")).otherwise(0)).alias("out"))
    bad = cm.join(sup, ["arm", "actual"]).where(F.col("in_label") + F.col("out") != F.col("support"))
    assert bad.count() == 0
    assert M.confusion_matrix(oc).count() == 2 * 27 * 27


def test_metric_document_round_trip(spark, oc, tmp_dir):
    from ticketspark.sinks.writers import metrics_document, write_metrics_document
    from ticketspark.sources.readers import read_metrics_document
    doc = metrics_document(oc, "golden", "rebuilt", 10)
    write_metrics_document(doc, tmp_dir + "/doc")
    back = read_metrics_document(spark, tmp_dir + "/doc")
    row = back.where("arm = 'baseline' AND key = 'macro avg'").first()
    assert row.f1 == pytest.approx(EXPECTED["baseline"]["macro_f1"], abs=1e-12)
    assert row.accuracy == pytest.approx(EXPECTED["baseline"]["accuracy"], abs=1e-12)
    assert back.where("arm = 'finetuned' AND key = 'accuracy'").count() == 1
    assert back.where("arm = 'baseline' AND key = 'micro avg'").count() == 1
    assert back.select("arm", "key").distinct().count() == 2 * 30


def test_reads_reference_layout(spark, tmp_dir):
    """A pretty-printed document with a bare-number accuracy entry (reference layout)."""
    from ticketspark.sources.readers import read_metrics_document
    text = """{
  "model": "m", "eval_type": "fine-tuned", "n_samples": 20, "samples_per_class": 10,
  "accuracy": 0.95, "macro_f1": 0.9, "weighted_f1": 0.9, "unparseable_rate": 0.0,
  "per_class_report": {
    "a": {"precision": 1.0, "recall": 0.9, "f1-score": 0.947, "support": 10.0},
    "accuracy": 0.95,
    "macro avg": {"precision": 0.9, "recall": 0.9, "f1-score": 0.9, "support": 20.0}
  }
}"""
    import os
    os.makedirs(tmp_dir + "/ref", exist_ok=True)
    with open(tmp_dir + "/ref/metrics.json", "w") as f:
        f.write(text)
    back = {r.key: r for r in read_metrics_document(spark, tmp_dir + "/ref", multi_line=True).collect()}
    assert back["accuracy"].precision == 0.95 and back["accuracy"].support is None
    assert back["a"].f1 == 0.947 and back["macro avg"].support == 20.0
