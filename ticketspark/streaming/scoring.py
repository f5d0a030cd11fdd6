"""Structured Streaming request scoring (J2), in two forms.

Predictors that work row by row (keyword rules, logistic regression, Python models behind a
prompt) make the batch scorer a plan without state, so it runs as an append query from the
file source to the file sink (:func:`start_appending`). The sink's own commit log says which
files count: what a failed or repeated batch left behind is not read.

Naive Bayes aggregates per request, which a streaming plan would turn into unbounded state;
:func:`start_scoring` runs the batch function on each micro-batch in ``foreachBatch``. Writing
each batch to ``batch_id=<n>`` with overwrite makes a replayed batch (after a failure between
write and commit) replace its own output, so restarts never duplicate rows.

The model (e.g. keyword rules) is a static table fitted in batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ticketspark.operators.serving import score_requests

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("body", T.StringType()),
])


def request_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (request_id, body) from files landing in ``source_dir``."""
    r = spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def request_line_stream(spark: SparkSession, source_dir: str,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (request_file, body) from files of one request body per line, as clients
    send them; the scorers give them ids."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir).select(F.col("_metadata.file_name").alias("request_file"),
                                     F.col("value").alias("body"))


def numbered(batch: DataFrame) -> DataFrame:
    """(request_id, body): requests without an id get their file's name and their place in
    the batch, which a repeated batch gives again."""
    if "request_id" in batch.columns:
        return batch
    return batch.select(F.concat_ws(":", F.col("request_file"), F.monotonically_increasing_id().cast(
        "string")).alias("request_id"), "body")


def named(stream: DataFrame) -> DataFrame:
    """(request_id, body): requests without an id get their file's name and a random UUID. A
    repeated batch gives others, but only the batch that was committed is ever read."""
    if "request_id" in stream.columns:
        return stream
    return stream.select(F.concat_ws(":", F.col("request_file"), F.expr("uuid()")).alias("request_id"), "body")


def _started(writer, available_now: bool, processing_time: str | None) -> StreamingQuery:
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def start_appending(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], sink_dir: str,
                    checkpoint_dir: str, available_now: bool = True,
                    processing_time: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """Score a stream with a row-wise ``predict`` and append the responses to ``sink_dir``,
    each exactly once. Spark refuses a ``predict`` that aggregates."""
    scored = score_requests(named(stream), predict)
    writer = scored.writeStream.format(fmt).outputMode("append").option("path", sink_dir).option(
        "checkpointLocation", checkpoint_dir)
    return _started(writer, available_now, processing_time)


def start_scoring(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], sink_dir: str,
                  checkpoint_dir: str, available_now: bool = True,
                  processing_time: str | None = None) -> StreamingQuery:
    """Score every micro-batch and append responses under ``sink_dir/batch_id=<n>``."""

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        score_requests(numbered(batch), predict).write.mode("overwrite").parquet(
            os.path.join(sink_dir, f"batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    return _started(writer, available_now, processing_time)
