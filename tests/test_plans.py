"""Physical plan shape."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ticketspark.functions.decode import decode_lenient
from ticketspark.operators import dedup, predict, split, vocab
from ticketspark.operators.vocab import label_array, sized
from ticketspark.sources import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_prunes_map_side(spark):
    p = plan(dedup.dedup_first(fx.tickets(spark, SF01)))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_split_final_pass_broadcasts_cut_table(spark):
    sp = split.stratified_split(fx.tickets(spark, SF01))
    sp.collect()
    p = plan(sp)
    assert "BroadcastHashJoin" in p
    # no exchange ever carries the message text: the wide rows are scanned, joined to
    # the broadcast cut table and projected, never shuffled
    for line in p.splitlines():
        if "Exchange" in line:
            assert "text" not in line and "instruction" not in line, line


def test_saved_naive_bayes_broadcasts_bounded_weights(spark):
    t = fx.tickets(spark, SF01)
    m = predict.fit_and_save_naive_bayes(t, "nb-plan-test")
    assert m.cold_weights is None and m.hot_weights is not None
    df = predict.predict_naive_bayes(m, t.select("ticket_id", "intent", "instruction"), carry=["intent"])
    p = plan(df)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "Python" not in p


def test_decode_has_no_python(spark):
    sc = fx.scored(spark, SF01)
    d = sc.withColumn("_l", label_array(sc)).withColumn("p", decode_lenient(F.col("raw_output"), F.col("_l")))
    p = plan(d)
    assert "Python" not in p and "ArrowEval" not in p


def test_keyword_prediction_is_row_wise(spark):
    t = fx.tickets(spark, SF01)
    rules = predict.keyword_rules(t.select(F.col("intent").alias("label")))
    p = plan(predict.predict_keyword(t, rules, carry=["intent"])).split("Subquery")[0]
    assert "Exchange" not in p and "Join" not in p and "Python" not in p


def test_keyword_paths_agree(spark):
    t = fx.tickets(spark, SF01).select("ticket_id", "intent", "instruction")
    t = t.unionByName(t.where("ticket_id < 50"))  # equal ids stay rows of their own
    rules = predict.keyword_rules(fx.read_table(spark, SF01, "documents").select(F.col("source").alias("label"))
                                  .unionByName(t.select(F.lower("intent").alias("label"))))
    inline = predict.predict_keyword(t, rules, carry=["intent"])
    joined = predict.predict_keyword(t, rules, carry=["intent"], inline_rules=0)
    assert sorted(inline.collect()) == sorted(joined.collect()) and inline.count() == t.count()


def test_unbounded_tables_are_not_broadcast(spark):
    t = fx.tickets(spark, SF01)
    small = t.groupBy("intent").count()
    assert "ResolvedHint" in sized(small, "t")._jdf.queryExecution().analyzed().toString()
    for over in ({"max_rows": 1}, {"max_bytes": 1}):
        assert "ResolvedHint" not in sized(small, "t", **over)._jdf.queryExecution().analyzed().toString()


def test_split_is_equal_on_either_join(spark, monkeypatch):
    t = fx.tickets(spark, SF01)
    want = sorted(split.stratified_split(t).select("ticket_id", "split").collect())
    monkeypatch.setattr(vocab, "BROADCAST_ROWS", 1)
    assert sorted(split.stratified_split(t).select("ticket_id", "split").collect()) == want


def test_label_array_fails_beyond_its_bound(spark):
    t = fx.tickets(spark, SF01)
    assert len(spark.range(1).select(label_array(t, max_classes=4)).first()[0]) == 4
    with pytest.raises(Exception, match="exceeds 3"):
        spark.range(1).select(label_array(t, max_classes=3)).collect()


def test_scan_prunes_columns(spark):
    p = plan(fx.tickets(spark, SF01).groupBy("intent").count())
    assert "ReadSchema: struct<lang:string>" in p


def test_label_ranks_need_no_single_task(spark):
    t = fx.tickets(spark, SF01)
    labels = t.select(F.concat_ws("-", "intent", "ticket_id").alias("intent")).unionByName(t.select("intent"))
    v = vocab.label_vocab(labels)
    assert "SinglePartition" not in plan(v)
    want = sorted({r.intent for r in labels.collect()} - {None})
    assert [(r.label, r.label_rank) for r in sorted(v.collect(), key=lambda r: r.label_rank)] == [
        (x, i + 1) for i, x in enumerate(want)]
    assert vocab.label_vocab(labels.limit(0)).collect() == []
