"""Decoding through the label index (G4) and metrics over label tables (H2-H6)."""

import random

import pytest
from pyspark.sql import functions as F

from ticketspark.functions.decode import UNPARSEABLE, decode_lenient
from ticketspark.operators import labelmatch as LM
from ticketspark.operators import metrics as M
from ticketspark.operators import vocab


def plain(raw, labels):
    labels = sorted(x for x in set(labels) if x is not None)
    if raw is None:
        return UNPARSEABLE
    clean = raw.strip(" \t\n\r\f\v").lower().strip(".\"'")
    for same in (lambda l: l.lower() == clean, lambda l: l.lower() in clean):
        for label in labels:
            if same(label):
                return label
    return UNPARSEABLE


def outputs_for(labels, n, seed):
    r = random.Random(seed)
    names = [x for x in labels if x]
    out = [None, "", " ", "none", "\"'.", "a" * 3, "🙂", "漢字 x"]
    for _ in range(n):
        a, b = r.choice(names), r.choice(names)
        out.append(r.choice([a, a.upper(), f' "{a}." ', f"Intent: {a}", f"{a} or {b}", a[:-1], a[1:], a + b, f"{b}\n{a}x", "no such"]))
    return out + out[:40]


SETS = {
    "plain": ["view", "click", "error", "purchase", "signup"],
    "nested and short": ["a", "ab", "abc", "abcd", "abcde", "bcd", "é", "漢字", "A", "View", "view", None, "x.y", "🙂z"],
    "with an empty one": ["", "view", "list"],
    "common grams": [f"order_status_{i}" for i in range(300)] + [f"status_order_{i}" for i in range(300)],
}


@pytest.mark.parametrize("name", sorted(SETS))
@pytest.mark.parametrize("small", [True, False])
def test_index_equals_scan_of_all_labels(spark, monkeypatch, name, small):
    labels = SETS[name]
    if not small:
        monkeypatch.setattr(vocab, "BROADCAST_ROWS", 0)
    raws = outputs_for(labels, 300, len(name))
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").repartition(3)
    table = spark.createDataFrame([(x,) for x in labels + labels[:2]], "label string")
    got = {r.i: r.predicted_intent for r in LM.decode_outputs(df, "raw", table).collect()}
    assert got == {i: plain(raw, labels) for i, raw in enumerate(raws)}
    arr = F.array_sort(F.array(*[F.lit(x) for x in set(labels) if x is not None]))
    rows = df.withColumn("_l", arr).select("i", decode_lenient(F.col("raw"), F.col("_l")).alias("p")).collect()
    assert got == {r.i: r.p for r in rows}


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "i int, raw string")
    none = spark.createDataFrame([], "label string")
    assert {r.predicted_intent for r in LM.decode_outputs(df, "raw", none).collect()} == {UNPARSEABLE}
    some = spark.createDataFrame([("x",)], "label string")
    assert LM.decode_outputs(df.limit(0), "raw", some).collect() == []


def label_name(c):
    return F.concat(F.lit("intent_"), F.lpad(c.cast("string"), 6, "0"), F.lit("_of_many"))


def test_two_hundred_thousand_labels(spark):
    n = 200_000
    labels = spark.range(n).select(label_name(F.col("id")).alias("label"))
    df = spark.range(4000).select("id", label_name(F.col("id") * 49).alias("intent")).withColumn("raw", F.when(
        F.col("id") % 4 == 0, F.col("intent")).when(F.col("id") % 4 == 1, F.concat(F.lit("It is "), F.upper("intent"), F.lit("!")))
        .when(F.col("id") % 4 == 2, label_name(F.col("id") * 49 + 1)).otherwise("nothing of that"))
    got = LM.decode_outputs(df, "raw", labels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan and "Subquery" not in plan
    wrong = got.where(F.col("predicted_intent") != F.when(F.col("id") % 4 == 2, label_name(F.col("id") * 49 + 1)).when(
        F.col("id") % 4 == 3, UNPARSEABLE).otherwise(F.col("intent")))
    assert got.count() == 4000 and wrong.count() == 0


def test_metrics_over_two_hundred_thousand_labels(spark):
    n = 200_000
    # each label once right and once, of every other label, taken for the next one
    oc = spark.range(n).select(F.lit("all").alias("arm"), label_name(F.col("id")).alias("actual"), F.inline(F.array(
        F.struct(label_name(F.col("id")).alias("predicted"), F.lit(1).cast("long").alias("n")),
        F.struct(F.when(F.col("id") % 2 == 0, label_name((F.col("id") + 1) % n)).otherwise("UNPARSEABLE").alias("predicted"),
                 F.lit(1).cast("long").alias("n")))))
    cells = M.confusion_cells(oc)
    results = [cells, M.macro_avg(oc), M.weighted_avg(oc), M.micro_avg(oc), M.accuracy(oc), M.unparseable_rate(oc),
               M.metrics_summary(oc), M.classification_report(oc)]
    for df in results:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_set" not in plan and "collect_list" not in plan
    assert cells.count() == n + n // 2
    assert M.accuracy(oc).first().accuracy == 0.5 and M.unparseable_rate(oc).first().unparseable_rate == 0.25
    # odd labels: predicted twice, right once, of two; even ones: predicted once
    assert M.macro_avg(oc).first().precision == 0.75 and M.micro_avg(oc).first().row_kind == "micro avg"
    assert M.classification_report(oc).count() == n
