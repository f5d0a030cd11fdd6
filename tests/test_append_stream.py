"""Scoring as an append stream (J2) by row-wise predictors, and failures of Python models (G1)."""

import glob
import os
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ticketspark.operators import predict as P
from ticketspark.operators import serving as S
from ticketspark.plans.catalog import event_label_rules
from ticketspark.sources import fixtures as fx
from ticketspark.streaming.scoring import request_line_stream, request_stream, start_appending, start_scoring

LABELS = fx.EVENT_TYPES


class PromptReader(P.Predictor):
    """A model that reads the user turn of its prompt, answers in free text, and fails for
    one message."""

    def predict(self, texts):
        out = []
        for t in texts:
            assert t.count("<|im_start|>") == 3 and "click, error, purchase" in t
            said = t.split("<|im_start|>user\n")[1].split("<|im_end|>")[0]
            if said == "signup":
                raise RuntimeError("no answer to that")
            out.append(f' "{said.upper()}." ')
        return pd.Series(out, index=texts.index)


def keyword(spark):
    rules = event_label_rules(spark, SF001).cache()
    return lambda df: P.predict_keyword(df, rules, id_col="request_id", text_col="text", carry=["message", "error_kind"])


def logistic(spark):
    train = spark.createDataFrame([(f"{x} {w}", x) for x in LABELS for w in ("now", "please", "it")],
                                  "instruction string, intent string")
    fitted = P.fit_logistic(train, num_features=1 << 10)
    return lambda df: P.predict_logistic(fitted, df, text_col="text").select(
        "request_id", "message", "error_kind", "predicted_intent")


def bayes(spark):
    train = spark.createDataFrame([(f"{x} {w}", x) for x in LABELS for w in ("now", "please", "it")],
                                  "instruction string, intent string")
    model = P.fit_and_save_naive_bayes(train, "nb-stream")
    return lambda df: P.predict_naive_bayes(model, df, id_col="request_id", text_col="text", carry=["message", "error_kind"])


PREDICTORS = {"keyword": keyword, "logistic": logistic, "bayes": bayes,
              "model": lambda spark: S.prompted(PromptReader(), LABELS)}


@pytest.mark.parametrize("name", sorted(PREDICTORS))
def test_stream_equals_batch_and_restarts_write_nothing_twice(spark, tmp_dir, name):
    predict = PREDICTORS[name](spark)
    start = start_scoring if name == "bayes" else start_appending
    reqs = fx.requests(spark, SF001).select("request_id", "body")
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "out", "ckpt"))
    reqs.where("request_id < 400").write.parquet(os.path.join(src, "part1"))

    def run():
        q = start(request_stream(spark, src + "/*", max_files_per_trigger=2), predict, sink, ckpt)
        q.awaitTermination(300)
        return sorted(map(tuple, spark.read.parquet(sink).select("request_id", "response").collect()))

    def batch(rows):
        return sorted(map(tuple, S.score_requests(rows, predict).collect()))

    first = run()
    assert first == batch(reqs.where("request_id < 400")) and any("predicted_intent" in r[1] for r in first)
    assert run() == first  # a restart with nothing new
    reqs.where("request_id >= 400").write.parquet(os.path.join(src, "part2"))
    assert run() == batch(reqs)
    if name == "model":
        failed = [r for r in first if S.MODEL_FAILED in r[1]]
        assert failed and len(failed) < len(first) / 2


def test_what_an_uncommitted_batch_left_is_not_read(spark, tmp_dir):
    predict = keyword(spark)
    reqs = fx.requests(spark, SF001).select("request_id", "body").where("request_id < 200")
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "out", "ckpt"))
    reqs.write.parquet(os.path.join(src, "part1"))
    start_appending(request_stream(spark, src + "/*"), predict, sink, ckpt).awaitTermination(300)
    n = spark.read.parquet(sink).count()
    # the files of a batch whose commit was lost: they are there, but not in the log
    some = glob.glob(os.path.join(sink, "part-*.parquet"))[0]
    shutil.copy(some, os.path.join(sink, "part-00099-lost.snappy.parquet"))
    assert spark.read.parquet(sink).count() == n == reqs.count()


def test_lines_without_ids(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "out", "ckpt"))
    os.mkdir(src)
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write('{"message":"click it"}\n{bad\n{"message":"click it"}\n')
    start_appending(request_line_stream(spark, src), keyword(spark), sink, ckpt).awaitTermination(300)
    got = spark.read.parquet(sink).collect()
    assert len({r.request_id for r in got}) == 3 and all(r.request_id.startswith("a.txt:") for r in got)
    assert sum('"predicted_intent":"click"' in r.response for r in got) == 2


class Picky(P.Predictor):
    calls = 0

    def predict(self, texts):
        if any("poison" in t for t in texts):
            raise ValueError("can't read this")
        return texts.str.upper()


class Short(P.Predictor):
    def predict(self, texts):
        return texts.iloc[:-1] if len(texts) > 1 else texts


def test_a_poisoned_row_costs_one_row(spark):
    rows = [(i, "poison" if i in (3, 700, 701) else None if i == 5 else f"text {i}", "wide " * 50) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, text string, other string").repartition(3)
    got = P.predict_batch(df, Picky(), "text", keep=["id"], error_col="error")
    assert got.columns == ["id", "raw_output", "error"]
    for r in got.collect():
        text = rows[r.id][1]
        if text == "poison":
            assert r.raw_output is None and r.error == "ValueError: can't read this"
        else:
            assert (r.raw_output, r.error) == (text and text.upper(), None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "other" not in plan.split("MapInPandas")[1].split("\n")[1]
    with pytest.raises(Exception, match="can't read this"):
        P.predict_batch(df, Picky(), "text").collect()


def test_wrong_number_of_outputs_is_a_failure(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, text string").coalesce(1)
    with pytest.raises(Exception, match="19 outputs for 20 texts"):
        P.predict_batch(df, Short(), "text").collect()
    got = P.predict_batch(df, Short(), "text", error_col="error").collect()
    assert all(r.raw_output == r.text and r.error is None for r in got)


def test_rows_of_a_split_model_keep_their_documents(spark):
    """The input numbers its rows differently each time it is read, and has rows twice."""
    t = fx.tickets(spark, SF001).select("ticket_id", "intent", "instruction")
    one = P.fit_and_save_naive_bayes(t, "nb-one")
    split = P.fit_and_save_naive_bayes(t, "nb-split", budget_rows=300)
    assert split.cold_weights is not None
    twice = t.unionByName(t.where("ticket_id % 3 = 0"))
    unsteady = twice.repartition(5).orderBy(F.rand())
    want, got = (sorted(map(tuple, P.predict_naive_bayes(m, df, carry=["intent"]).select(
        "ticket_id", "intent", "predicted_intent", F.round("confidence", 6)).collect()))
        for m, df in ((one, twice), (split, unsteady)))
    assert got == want
