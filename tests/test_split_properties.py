"""Split, sampling and dedup properties."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from ticketspark.functions.hashing import order_key
from ticketspark.operators import dedup, split
from ticketspark.operators import quota as Q
from ticketspark.sources import fixtures as fx


@pytest.fixture(scope="module")
def tickets(spark):
    return fx.tickets(spark, SF01).cache()


def _plain_window_split(df, test_ids_per_class):
    w = Window.partitionBy("intent").orderBy(order_key("ticket_id"), "ticket_id")
    return df.withColumn("_rn", F.row_number().over(w))


def test_split_sizes_and_quotas(tickets):
    sp = split.stratified_split(tickets).cache()
    n = tickets.count()
    assert sp.count() == n
    assert sp.select("ticket_id").distinct().count() == n  # disjoint + exhaustive
    n_test = sp.where("split = 'test'").count()
    assert n_test == math.ceil(n * 0.15)
    per = sp.groupBy("intent").agg(F.count("*").alias("n"),
                                   F.sum((F.col("split") == "test").cast("int")).alias("t")).collect()
    for r in per:
        assert abs(r.t - r.n * n_test / n) < 1.0


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_histogram_cut_equals_plain_window(tickets, digits):
    alloc = split.split_allocation(tickets).select(F.col("intent").alias("g"), "n_test")
    k = Q.keyed(tickets, "intent", "ticket_id", 42)
    hist = Q.histogram(k, digits)
    cuts = Q.cuts(k, hist, alloc.withColumnRenamed("n_test", "quota"), digits)
    ours = Q.within_cut(tickets, cuts, "intent", "ticket_id", 42, "t").where("t").select("ticket_id")
    w = Window.partitionBy("intent").orderBy(order_key("ticket_id"), "ticket_id")
    plain = (tickets.withColumn("_rn", F.row_number().over(w))
             .join(alloc.withColumnRenamed("g", "intent"), "intent")
             .where(F.col("_rn") <= F.col("n_test")).select("ticket_id"))
    assert sorted(r[0] for r in ours.collect()) == sorted(r[0] for r in plain.collect())


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_split_independent_of_partitioning(spark, tickets, parts):
    base = split.stratified_split(tickets).where("split = 'test'").select("ticket_id")
    other = split.stratified_split(tickets.repartition(parts)).where("split = 'test'").select("ticket_id")
    assert sorted(r[0] for r in base.collect()) == sorted(r[0] for r in other.collect())


def test_strict_sample_exact_n(tickets):
    s = split.sample_strict(tickets, 50)
    counts = {r.intent: r["count"] for r in s.groupBy("intent").count().collect()}
    assert counts and set(counts.values()) == {50}


def test_strict_sample_fails_when_short(tickets):
    with pytest.raises(Exception, match="fewer than"):
        split.sample_strict(tickets, 10_000).collect()


def test_capped_sample(tickets):
    sizes = {r.intent: r["count"] for r in tickets.groupBy("intent").count().collect()}
    s = split.sample_capped(tickets, 150)
    got = {r.intent: r["count"] for r in s.groupBy("intent").count().collect()}
    assert got == {k: min(v, 150) for k, v in sizes.items()}


def test_sample_is_prefix_of_larger_sample(tickets):
    small = {r[0] for r in split.sample_capped(tickets, 20).select("ticket_id").collect()}
    big = {r[0] for r in split.sample_capped(tickets, 60).select("ticket_id").collect()}
    assert small < big


def test_dedup_keeps_lowest_id(spark):
    df = spark.createDataFrame([(7, "same", "b"), (3, "same", "c"), (5, "same", "a"), (4, "other", "a")],
                               "ticket_id long, instruction string, intent string")
    out = sorted((r.ticket_id, r.intent) for r in dedup.dedup_first(df).collect())
    assert out == [(3, "c"), (4, "a")]


def test_dedup_then_split_has_no_leak(tickets):
    sp = split.stratified_split(dedup.dedup_first(tickets))
    r = split.leakage(sp.where("split='train'"), sp.where("split='test'")).first()
    assert r.n_leaked == 0 and r.leak_rate == 0.0


def test_row_split_leaks(tickets):
    sp = split.stratified_split(tickets)
    r = split.leakage(sp.where("split='train'"), sp.where("split='test'")).first()
    assert r.n_leaked > 0


def test_label_conflicts_none_on_intent(tickets):
    assert dedup.label_conflicts(tickets).count() == 0
    assert dedup.label_conflicts(tickets, label_col="category").count() > 0


def test_naive_bayes_hot_cold_split_is_exact(spark, tickets):
    """Forcing a tiny broadcast budget splits the weights by token frequency; the
    predictions must equal the single-join model's."""
    from ticketspark.operators import predict as P
    sp = split.stratified_split(dedup.dedup_first(tickets)).cache()
    train = sp.where("split = 'train'")
    test = sp.where("split = 'test'").select("ticket_id", "intent", "instruction")
    lazy = P.fit_naive_bayes(train)
    split_model = P.fit_and_save_naive_bayes(train, "nb-test-split", budget_rows=500)
    assert split_model.cold_weights is not None
    assert split_model.hot_weights.count() <= 500
    assert split_model.cold_weights.count() > 0
    whole = P.fit_and_save_naive_bayes(train, "nb-test-whole")
    assert whole.cold_weights is None
    a = {(r.ticket_id, r.predicted_intent, round(r.confidence, 9))
         for r in P.predict_naive_bayes(lazy, test, carry=["intent"]).collect()}
    b = {(r.ticket_id, r.predicted_intent, round(r.confidence, 9))
         for r in P.predict_naive_bayes(split_model, test, carry=["intent"]).collect()}
    c = {(r.ticket_id, r.predicted_intent, round(r.confidence, 9))
         for r in P.predict_naive_bayes(whole, test, carry=["intent"]).collect()}
    assert a == b == c and len(a) == test.count()


def test_zero_quota_class_selects_nothing(spark):
    """A class whose test quota is 0 (too small for a 15 % share) stays all-train."""
    rows = [(i, f"t{i}", "big") for i in range(40)] + [(100, "t100", "tiny")]
    df = spark.createDataFrame(rows, "ticket_id long, instruction string, intent string")
    got = {(r.intent, r.split) for r in split.stratified_split(df).collect()}
    alloc = {r.intent: r.n_test for r in split.split_allocation(df).collect()}
    assert alloc["tiny"] == 0 and ("tiny", "test") not in got
    assert sum(1 for r in split.stratified_split(df).collect() if r.split == "test") == math.ceil(41 * 0.15)
