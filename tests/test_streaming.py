"""Streaming request scoring equals the batch result; restarts write nothing twice."""

import os

from conftest import SF001
from ticketspark.operators import predict as P
from ticketspark.operators import serving as S
from ticketspark.plans.catalog import event_label_rules
from ticketspark.sources import fixtures as fx
from ticketspark.streaming.scoring import request_stream, start_scoring


def _predict(rules):
    return lambda df: P.predict_keyword(df, rules, id_col="request_id", text_col="text",
                                        carry=["message", "error_kind"])


def test_stream_equals_batch_and_restart_is_idempotent(spark, tmp_dir):
    reqs = fx.requests(spark, SF001).select("request_id", "body")
    src = os.path.join(tmp_dir, "in")
    reqs.where("request_id < 500").write.parquet(os.path.join(src, "part1"))
    rules = event_label_rules(spark, SF001).cache()
    sink, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")

    def run():
        q = start_scoring(request_stream(spark, src + "/*", max_files_per_trigger=1), _predict(rules), sink, ckpt)
        q.awaitTermination(300)

    run()
    first = spark.read.parquet(sink).select("request_id", "response")
    batch = S.score_requests(reqs.where("request_id < 500"), _predict(rules))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, batch.collect()))

    run()  # restart, nothing new
    assert spark.read.parquet(sink).count() == first.count()

    reqs.where("request_id >= 500").write.parquet(os.path.join(src, "part2"))
    run()  # only the new file is processed
    out = spark.read.parquet(sink).select("request_id", "response")
    full = S.score_requests(reqs, _predict(rules))
    assert out.count() == reqs.count()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, full.collect()))


def test_stream_from_json_lines(spark, tmp_dir):
    """A6 as a stream: one JSON request record per line, files landing in a folder."""
    reqs = fx.requests(spark, SF001).select("request_id", "body")
    src = os.path.join(tmp_dir, "in-json")
    reqs.write.json(os.path.join(src, "part1"))
    rules = event_label_rules(spark, SF001).cache()
    sink, ckpt = os.path.join(tmp_dir, "out-json"), os.path.join(tmp_dir, "ckpt-json")
    q = start_scoring(request_stream(spark, src + "/*", fmt="json"), _predict(rules), sink, ckpt)
    q.awaitTermination(300)
    out = spark.read.parquet(sink).select("request_id", "response")
    batch = S.score_requests(reqs, _predict(rules))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
