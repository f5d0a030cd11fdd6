"""Hot keys: one text on a third of the rows, one class holding most rows.

The inputs are derived from the given tickets table; results are checked against a
brute-force pandas computation on the same rows.
"""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ticketspark.operators import dedup, predict, split
from ticketspark.sources import fixtures as fx


@pytest.fixture(scope="module")
def hot(spark):
    t = fx.tickets(spark, SF01)
    # a third of all rows share one text; two thirds of rows are relabelled 'en'
    return t.select(
        "ticket_id",
        F.when(F.col("ticket_id") % 3 == 0, F.lit("the same hot message")).otherwise(F.col("instruction")).alias("instruction"),
        F.when(F.col("ticket_id") % 3 != 2, F.lit("en")).otherwise(F.col("intent")).alias("intent"),
        "category", "n_chars").cache()


def test_dedup_hot_text(hot):
    pdf = hot.toPandas()
    expected = set(pdf.sort_values("ticket_id").drop_duplicates("instruction", keep="first").ticket_id)
    got = {r[0] for r in dedup.dedup_first(hot).select("ticket_id").collect()}
    assert got == expected


def test_split_hot_class_matches_brute_force(hot):
    pdf = hot.toPandas()
    n = len(pdf)
    t = math.ceil(n * 0.15)
    sizes = pdf.groupby("intent").size()
    share = {g: c * t / n for g, c in sizes.items()}
    floor = {g: math.floor(v) for g, v in share.items()}
    left = t - sum(floor.values())
    order = sorted(share, key=lambda g: (-(share[g] - floor[g]), g))
    quota = {g: floor[g] + (1 if i < left else 0) for i, g in enumerate(order)}
    pdf["h"] = [hashlib.md5(f"42|{i}".encode()).hexdigest() for i in pdf.ticket_id]
    expected = set()
    for g, grp in pdf.groupby("intent"):
        expected |= set(grp.sort_values(["h", "ticket_id"]).ticket_id.head(quota[g]))
    got = {r[0] for r in split.stratified_split(hot).where("split = 'test'").select("ticket_id").collect()}
    assert got == expected


def test_leakage_with_hot_text(hot):
    sp = split.stratified_split(hot)
    pdf = sp.select("instruction", "split").toPandas()
    train_texts = set(pdf[pdf.split == "train"].instruction)
    test = pdf[pdf.split == "test"]
    r = split.leakage(sp.where("split = 'train'"), sp.where("split = 'test'")).first()
    assert r.n_test == len(test)
    assert r.n_leaked == int(test.instruction.isin(train_texts).sum())


def test_split_two_class_imbalanced(spark):
    """tickets2: documents joined with labels, the quality flag as a two-class label."""
    t2 = fx.tickets2(spark, SF01)
    pdf = t2.select("ticket_id", "intent").toPandas()
    n = len(pdf)
    t = math.ceil(n * 0.15)
    sizes = pdf.groupby("intent").size()
    share = {g: c * t / n for g, c in sizes.items()}
    floor = {g: math.floor(v) for g, v in share.items()}
    left = t - sum(floor.values())
    order = sorted(share, key=lambda g: (-(share[g] - floor[g]), g))
    quota = {g: floor[g] + (1 if i < left else 0) for i, g in enumerate(order)}
    pdf["h"] = [hashlib.md5(f"42|{i}".encode()).hexdigest() for i in pdf.ticket_id]
    expected = set()
    for g, grp in pdf.groupby("intent"):
        expected |= set(grp.sort_values(["h", "ticket_id"]).ticket_id.head(quota[g]))
    got = {r[0] for r in split.stratified_split(t2).where("split = 'test'").select("ticket_id").collect()}
    assert got == expected and len(sizes) == 2


def test_split_with_null_labels_and_changed_fingerprint(spark):
    t = fx.tickets(spark, SF01).where("ticket_id < 100").withColumn(
        "intent", F.when(F.col("ticket_id") % 5 != 0, F.col("intent")))
    sp = split.stratified_split(t)
    n = t.count()
    assert sp.where("split = 'test'").count() == math.ceil(n * 0.15)
    want = {r.intent: r.n_test for r in split.split_allocation(t).collect()}
    got = {r.intent: r["count"] for r in sp.where("split = 'test'").groupBy("intent").count().collect()}
    assert got == {k: v for k, v in want.items() if v} and None in got
    one = sorted(split.split_fingerprint(sp).collect())
    swapped = sp.withColumn("intent", F.when(F.col("intent") == "en", "fr").when(
        F.col("intent") == "fr", "en").otherwise(F.col("intent")))
    assert sorted(split.split_fingerprint(swapped).collect()) != one


def test_naive_bayes_keeps_rows_of_one_id(spark):
    t = fx.tickets(spark, SF01).select("ticket_id", "intent", "instruction")
    m = predict.fit_and_save_naive_bayes(t, "nb-one-id")
    three = t.where("ticket_id < 3").withColumn("ticket_id", F.lit(7))
    got = predict.predict_naive_bayes(m, three.unionByName(three.limit(1).withColumn(
        "instruction", F.lit(None).cast("string"))), carry=["intent"])
    assert got.count() == 4


def test_saved_naive_bayes_predicts_alike(spark, tmp_dir):
    t = fx.tickets(spark, SF01).select("ticket_id", "intent", "instruction")
    for budget in (10 ** 6, 500):
        m = predict.fit_and_save_naive_bayes(t, "nb-disk", budget_rows=budget)
        predict.save_naive_bayes(m, f"{tmp_dir}/{budget}")
        again = predict.load_naive_bayes(spark, f"{tmp_dir}/{budget}")
        a, b = (sorted(predict.predict_naive_bayes(x, t, carry=[]).select("ticket_id", "predicted_intent").collect())
                for x in (m, again))
        assert a == b


def test_split_naive_bayes_ships_little(spark, monkeypatch):
    """The split of the weights broadcasts nothing, the frequent tokens' table is small in
    memory at any size, and long-tail occurrences are shuffled with a number alone."""
    assert predict.HOT_ROWS_BUDGET * 130 <= 100e6 and predict.HOT_BYTES_BUDGET <= 64 << 20
    rows = [(i, "de" if i % 2 else "en", f"w{i % 7} w{i % 5} only{i} w{i % 7}") for i in range(60)]
    t = spark.createDataFrame(rows, "ticket_id long, intent string, instruction string")
    sent = []
    real = predict.F.broadcast
    monkeypatch.setattr(predict.F, "broadcast", lambda df: sent.append(1) or real(df))
    m = predict.fit_and_save_naive_bayes(t, "nb-ships", budget_rows=20)
    assert not sent and m.cold_weights is not None
    assert m.hot_weights.count() + m.cold_weights.count() == m.weights.count()
    # no frequency whose tokens fit: all are the long tail
    none = predict.fit_and_save_naive_bayes(t, "nb-none", budget_rows=1)
    assert none.hot_weights.count() == 0 and none.cold_weights.count() == m.weights.count()
    odd = t.withColumn("ride", F.lit("ride along")).unionByName(spark.createDataFrame(
        [(99, None, None, "x"), (99, "en", "", None), (99, "en", "unknown words", "x")],
        "ticket_id long, intent string, instruction string, ride string"))
    lazy = predict.fit_naive_bayes(t)
    want, *got = (sorted(map(str, predict.predict_naive_bayes(x, odd, carry=["ride"]).select(
        "ticket_id", "ride", "predicted_intent", F.round("confidence", 9)).collect())) for x in (lazy, m, none))
    assert got == [want, want] and len(want) == 63
    plan = predict.predict_naive_bayes(m, odd, carry=["ride"])._jdf.queryExecution().optimizedPlan().toString()
    groups = [x for x in plan.splitlines() if "Aggregate [" in x]
    assert groups and not [x for x in groups if "ride#" in x]
