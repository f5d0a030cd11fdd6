"""Sources (A1, A2, A6, A7): labelled tickets with a reject path, request lines,
stored metric documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICKET_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.LongType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("response", T.StringType()),
])

REPORT_ENTRY = T.StructType([
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1-score", T.DoubleType()),
    T.StructField("support", T.DoubleType()),
])

# per_class_report is read as map<string,string>: one entry ("accuracy") may be a bare
# number among objects, so each value is parsed on its own after the read.
METRICS_DOC_SCHEMA = T.StructType([
    T.StructField("arm", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("eval_type", T.StringType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("samples_per_class", T.LongType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("macro_f1", T.DoubleType()),
    T.StructField("weighted_f1", T.DoubleType()),
    T.StructField("unparseable_rate", T.DoubleType()),
    T.StructField("per_class_report", T.MapType(T.StringType(), T.StringType())),
])


# Name of the column that holds a record as it stands in the file, where it can't be parsed.
RAW = "raw_record"


def read_tickets(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: T.StructType = TICKET_SCHEMA, keep_malformed: bool = False) -> DataFrame:
    """Read a labelled table with a declared schema (parquet, json or csv).

    With ``keep_malformed``, JSON lines and CSV records that the schema doesn't fit (broken
    JSON, a wrong number of fields, a value that is no number) are rows with their raw text
    in ``raw_record``, which is null for all others; :func:`load_tickets` rejects them.
    Otherwise such rows are nulls where the schema doesn't fit.
    """
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    if keep_malformed and fmt != "parquet":
        schema = T.StructType([*schema.fields, T.StructField(RAW, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
    return reader.schema(schema).format(fmt).load(path)


def with_reject_reason(df: DataFrame, text_col: str = "instruction",
                       label_col: str = "intent") -> DataFrame:
    """``df`` plus ``reject_reason`` (null for usable rows)."""
    reason = F.when(F.col(text_col).isNull(), F.lit("null_text")).when(F.col(label_col).isNull(), F.lit("null_label"))
    if RAW in df.columns:
        reason = F.when(F.col(RAW).isNotNull(), F.lit("malformed")).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def load_tickets(df: DataFrame, text_col: str = "instruction",
                 label_col: str = "intent") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rows with a null text or label, and records that couldn't be parsed,
    go to the reject output, the latter with their raw text. Every row is in one of the two."""
    tagged = with_reject_reason(df, text_col, label_col)
    return (tagged.where(F.col("reject_reason").isNull()).drop("reject_reason", RAW),
            tagged.where(F.col("reject_reason").isNotNull()))


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """One request body per line of text -> (body)."""
    return spark.read.text(path).select(F.col("value").alias("body"))


def read_metrics_document(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Stored metric documents -> (arm, model, ..., key, precision, recall, f1, support).

    Accepts both our documents and the reference's layout (pretty-printed, with a
    bare-number ``accuracy`` entry: pass ``multi_line=True``).
    """
    doc = spark.read.schema(METRICS_DOC_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)
    e = doc.select("*", F.explode("per_class_report").alias("key", "_v")).drop("per_class_report")
    parsed = F.from_json(F.col("_v"), REPORT_ENTRY)
    bare = F.col("_v").try_cast("double")
    is_obj = F.startswith(F.ltrim(F.col("_v")), F.lit("{"))
    return e.select(
        *[c for c in e.columns if c not in ("key", "_v")], "key",
        F.when(is_obj, parsed["precision"]).otherwise(bare).alias("precision"),
        F.when(is_obj, parsed["recall"]).otherwise(bare).alias("recall"),
        F.when(is_obj, parsed["f1-score"]).otherwise(bare).alias("f1"),
        F.when(is_obj, parsed["support"]).alias("support"),
    )
