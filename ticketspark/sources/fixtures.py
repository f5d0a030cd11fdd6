"""Bindings of the input tables to the shapes the operators work on.

``tickets``   labelled messages      <- documents (text as message, lang as intent)
``tickets2``  two-class labelled set <- documents joined with labels
``scored``    model outputs, two arms <- events, raw outputs from a fixed rule
``requests``  JSON request bodies    <- events, bodies from a fixed rule
``chat``      ordered chat turns     <- conversations
``offtopic``  out-of-scope messages  <- pages (raw HTML)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.functions.hashing import bucket
from ticketspark.sources.tables import read_table


# The types in the events table, which are the labels of ``scored``.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ticket_id"),
        F.col("text").alias("instruction"),
        F.col("lang").alias("intent"),
        F.col("source").alias("category"),
        "n_chars",
    )


def tickets2(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", label)
    return docs.join(lab, "doc_id").select(
        F.col("doc_id").alias("ticket_id"),
        F.col("text").alias("instruction"),
        F.col(label).cast("string").alias("intent"),
        F.col("source").alias("category"),
        "n_chars",
    )


def _pick(b: F.Column, first: list[F.Column], rest: F.Column) -> F.Column:
    """Value for bucket ``b`` (0..15): ``first[b]`` while listed, else ``rest``.

    One array lookup, so the bucket hash is evaluated once per use of the column,
    not once per branch of a CASE.
    """
    return F.element_at(F.array(*first, *([rest] * (16 - len(first)))), (b + 1).cast("int"))


def _arm_a_output(label: F.Column, b: F.Column) -> F.Column:
    # Raw outputs of the weak arm by bucket 0..6; 7..15 echo the label.
    return _pick(b, [
        F.lit("none"),
        F.lit("view"),
        F.lit("sort_list"),
        F.concat(F.lit('  "'), F.upper(label), F.lit('." ')),
        F.concat(F.lit("Intent: "), label),
        F.lit("click or view"),
        F.lit(""),
    ], label)


def _arm_b_output(label: F.Column, b: F.Column) -> F.Column:
    # Strong arm, bucket 0 -> "view", 1 -> label in double quotes.
    return _pick(b, [F.lit("view"), F.concat(F.lit('"'), label, F.lit('"'))], label)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticket_id, intent, arm, raw_output): every event scored by two arms."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    label = F.col("event_type")
    arm_a = ev.select(
        F.col("event_id").alias("ticket_id"), label.alias("intent"), F.lit("A").alias("arm"),
        _arm_a_output(label, bucket("A", "event_id")).alias("raw_output"))
    arm_b = ev.select(
        F.col("event_id").alias("ticket_id"), label.alias("intent"), F.lit("B").alias("arm"),
        _arm_b_output(label, bucket("B", "event_id")).alias("raw_output"))
    return arm_a.unionByName(arm_b)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, body, intent): JSON request bodies, some malformed."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    b = bucket("R", "event_id")
    label = F.col("event_type")
    # Request bodies by bucket 0..9; 10..15 are well-formed requests, and
    # those of bucket 10 come twice under one id.
    body = _pick(b, [
        F.lit("{bad"),
        F.lit("[1]"),
        F.concat(F.lit('{"msg":"'), label, F.lit('"}')),
        F.lit('{"message":null}'),
        F.lit('{"message":"  "}'),
        F.lit('{"message":5,"x":1}'),
        F.concat(F.lit('{"message":"'), label, F.lit('"} and more')),
        F.concat(F.lit("{'message':'"), label, F.lit("'}")),
        F.concat(F.lit('{"message":"first","message":"'), label, F.lit('"}')),
        F.concat(F.lit('{"message":"'), label, F.lit('"}]')),
    ], F.concat(F.lit('{"message":"'), label, F.lit('","user":'),
                F.col("user_id").cast("string"), F.lit("}")))
    return ev.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(b == 10, 2).otherwise(1)))).select(
        F.col("event_id").alias("request_id"), body.alias("body"), label.alias("intent"))


def props_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "props", "event_type")
    return ev.select(F.col("event_id").alias("request_id"), F.col("props").alias("body"),
                     F.col("event_type").alias("intent"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def offtopic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages outside every class: raw web pages."""
    return read_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ticket_id"), F.col("html").alias("instruction"))
