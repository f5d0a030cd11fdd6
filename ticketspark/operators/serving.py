"""Request validation, batch scoring, routing and audits (J1, J2 batch form, J3-J5).

All row-wise: validation and response building are JSON column functions, so a
stream of requests is scored by the same expressions (see ``streaming.scoring``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark.functions.decode import decode_lenient
from ticketspark.functions.prompts import CHATML, ChatTemplate, classification_text
from ticketspark.functions.text import strip_ws
from ticketspark.operators.labelmatch import flag_labels
from ticketspark.operators.predict import Predictor, predict_batch

# Error kinds, the human-routing sentinel and the beginning of error responses.
MALFORMED = "malformed"
NOT_OBJECT = "not_object"
MISSING_MESSAGE = "missing_message"
BLANK_MESSAGE = "blank_message"
MODEL_FAILED = "model_failed"
ROUTE_TO_HUMAN = "route_to_human"
ERROR_PREFIX = "A request is a JSON object with a message; this one is wrong: "


# What JSON counts as white space.
JSON_SPACE = " \t\n\r"


def _parsed(body: Column) -> Column:
    """(mark, members, values) of a body, by one strict parse: of an object its members, equal
    keys included, else what the body is beside the mark.

    Spark's parser stops at the end of a value, and takes single quotes unless told not to. So
    the body is parsed as the first member of an object whose second one has the body's own
    digest, the mark, for a key: if there are these two members, the body is one whole value
    with nothing after it. A body that ends the object itself leaves the mark unread, one that
    brings members of its own makes them more than two, and none can hold its own digest.
    """
    strict = {"allowSingleQuotes": "false"}
    is_object = F.startswith(F.ltrim(body, F.lit(JSON_SPACE)), F.lit("{"))
    mark = F.md5(body)

    def wrapped(end: str) -> Column:
        return F.concat(F.lit('{"b":'), body, F.lit(',"'), mark, F.lit(f'":{end}}}'))
    members = F.when(is_object, F.from_json(wrapped("{}"), "map<string,map<string,string>>", strict))
    values = F.when(~is_object, F.from_json(wrapped("0"), "map<string,string>", strict))
    return F.struct(mark.alias("mark"), members.alias("members"), values.alias("values"))


def _one(of: str) -> Column:
    return F.coalesce((F.size(of) == 2) & F.map_contains_key(F.col(of), F.col("mark")), F.lit(False))


def request_error(one: Column, members: Column, key: str = "message") -> Column:
    """Error kind of a parsed request body; null when accepted. Extra keys are ignored and
    the message's JSON type is not checked."""
    return (
        F.when(~one, F.lit(MALFORMED))
        .when(members.isNull(), F.lit(NOT_OBJECT))
        .when(~F.map_contains_key(members, F.lit(key)), F.lit(MISSING_MESSAGE))
    )


def validate_requests(df: DataFrame, body_col: str = "body", key: str = "message",
                      id_col: str = "request_id") -> DataFrame:
    """(id, accepted, error_kind, message): message is the JSON value as text, of equal
    keys the last one's.

    The body is parsed in a generator. A generator is a plan boundary that filters on its
    outputs are not pushed through, so later filters (``accepted``, blank message) test
    the parsed columns instead of parsing the body once per reference. The numbers NaN and
    Infinity, which strict JSON lacks, are accepted as Spark accepts them.
    """
    parsed = df.select(id_col, F.inline(F.array(_parsed(F.col(body_col)))))
    parsed = parsed.select(id_col, (_one("members") | _one("values")).alias("one"), F.when(
        _one("members"), F.try_element_at(F.col("members"), F.lit("b"))).alias("members"))
    err = request_error(F.col("one"), F.col("members"), key)
    return parsed.select(id_col, F.inline(F.array(F.struct(
        err.isNull().alias("accepted"),
        err.alias("error_kind"),
        # a parsed map holds equal keys side by side
        F.when(err.isNull(), F.try_element_at(F.filter(F.map_entries("members"), lambda e: e["key"] == key),
                                              F.lit(-1))["value"]).alias("message"),
    ))))


def clean_messages(validated: DataFrame, id_col: str = "request_id") -> DataFrame:
    """(id, message): accepted messages stripped of surrounding whitespace, blanks dropped."""
    m = strip_ws(F.col("message"))
    return validated.where(F.col("accepted")).select(id_col, m.alias("message")).where(
        F.length("message") > 0)


def score_requests(df: DataFrame, predict: Callable[[DataFrame], DataFrame],
                   body_col: str = "body", id_col: str = "request_id") -> DataFrame:
    """(id, response): one JSON response per request, in one pass.

    ``predict`` maps (id, text, message, error_kind) rows -- ``text`` is the stripped
    message the model sees (null for rejected requests, which therefore carry no
    tokens), ``message`` the value echoed back -- to the same rows plus
    ``predicted_intent``. Responses are chosen per row with a CASE, so the input is
    read once and never split into separately planned branches. Requests of one id are
    answered one by one. A ``predict`` that works row by row makes the whole scorer do so,
    and it takes a stream as well. ``predict`` may set ``error_kind`` where a model failed.
    """
    v = validate_requests(df, body_col, id_col=id_col)
    clean = strip_ws(F.col("message"))
    kind = F.when(F.col("accepted") & (clean.isNull() | (F.length(clean) == 0)),
                  F.lit(BLANK_MESSAGE)).otherwise(F.col("error_kind"))
    rows = v.select(id_col, "message", kind.alias("error_kind")).withColumn(
        "text", F.when(F.col("error_kind").isNull(), strip_ws(F.col("message"))))
    scored = predict(rows)
    response = F.when(
        F.col("error_kind").isNull(),
        F.to_json(F.struct(F.col("message"), F.col("predicted_intent"))),
    ).otherwise(F.to_json(F.struct(F.concat(F.lit(ERROR_PREFIX), F.col("error_kind")).alias("error"))))
    return scored.select(id_col, response.alias("response"))


def prompted(predictor: Predictor, labels: list[str], id_col: str = "request_id",
             template: ChatTemplate = CHATML) -> Callable[[DataFrame], DataFrame]:
    """A ``predict`` for :func:`score_requests`, row by row: the inference prompt of each
    accepted message goes to a Python model, whose answer is decoded leniently to one of
    ``labels``. They are in every prompt, so they are few. A message that the model fails
    for is answered with the error ``model_failed``; the others of its batch are not."""
    ordered = sorted(set(labels))
    known = F.array(*map(F.lit, ordered))
    low = F.array(*[F.lower(F.lit(x)) for x in ordered])

    def predict(rows: DataFrame) -> DataFrame:
        prompt = F.when(F.col("text").isNotNull(), classification_text(
            F.lit(", ".join(ordered)), F.col("text"), None, template))
        raw = predict_batch(rows.withColumn("_prompt", prompt), predictor, "_prompt", "_raw",
                            keep=[id_col, "message", "error_kind"], error_col="_error")
        kind = F.coalesce(F.col("error_kind"), F.when(F.col("_error").isNotNull(), F.lit(MODEL_FAILED)))
        return raw.select(id_col, "message", kind.alias("error_kind"), decode_lenient(
            F.col("_raw"), known, low).alias("predicted_intent"))

    return predict


def route(predicted: DataFrame, labels: DataFrame, threshold: float, label_col: str = "intent",
          pred_col: str = "predicted_intent", conf_col: str = "confidence") -> DataFrame:
    """``predicted`` plus ``routed_to`` (the label, or ``route_to_human``) and ``auto``.

    A prediction is routed automatically only when it is exactly one of the labels in the
    table ``labels`` and its confidence reaches ``threshold``.
    """
    p = flag_labels(predicted, F.col(pred_col), labels, label_col, "_known")
    auto = F.col("_known") & F.coalesce(F.col(conf_col) >= F.lit(threshold), F.lit(False))
    return p.withColumn("auto", auto).withColumn(
        "routed_to", F.when(F.col("auto"), F.col(pred_col)).otherwise(F.lit(ROUTE_TO_HUMAN))
    ).drop("_known")


def automation_rate(routed: DataFrame, actual: str = "intent") -> DataFrame:
    """(n_rows, n_auto, n_human, auto_rate, auto_accuracy)."""
    return routed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("auto"), 1)).alias("n_auto"),
        F.count(F.when(~F.col("auto"), 1)).alias("n_human"),
        F.count(F.when(F.col("auto") & (F.col("routed_to") == F.col(actual)), 1)).alias("_ok"),
    ).select(
        "n_rows", "n_auto", "n_human",
        F.round(F.when(F.col("n_rows") > 0, F.col("n_auto") / F.col("n_rows")).otherwise(0.0), 6).alias("auto_rate"),
        F.round(F.when(F.col("n_auto") > 0, F.col("_ok") / F.col("n_auto")).otherwise(0.0), 6).alias("auto_accuracy"),
    )


def out_of_scope_audit(outputs: DataFrame, labels: DataFrame, output_col: str, label_col: str = "intent",
                       arm_col: str = "arm", scope_col: str = "in_scope") -> DataFrame:
    """(arm, in_scope, n_rows, n_label, label_share): how often each arm answers with a
    real label (strict match), for in-scope and out-of-scope messages."""
    o = flag_labels(outputs, strip_ws(F.col(output_col)), labels, label_col, "_known")
    return o.groupBy(arm_col, scope_col).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("_known"), 1)).alias("n_label")
    ).withColumn("label_share", F.round(F.col("n_label") / F.col("n_rows"), 6))
