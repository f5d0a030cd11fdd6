"""The training-data pipeline: five stages, each over all that the one before it kept.

Stages take (spark, docs, sf_dir), where docs has the columns of ``documents``, and return a
DataFrame. All but the last return the columns of ``documents`` again. Null texts, which
have no words, go in the first stage; an empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.llm import bpe, mixing, quality, secrets, simhash
from ticketspark.session import materialize, release, saved_paths
from ticketspark.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash.simhash(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that aren't widely copied examples are masked in the text,
    whose number of characters follows."""
    found = secrets.secrets(docs.select(*COLUMNS)).select(*COLUMNS, F.col("text").alias("_before"), "found")
    return secrets.redact(found).withColumn("n_chars", F.when(
        F.col("text") == F.col("_before"), F.col("n_chars")).otherwise(
        F.length("text").cast("long"))).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where(F.col("copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix and what they decode to, as digests."""
    return bpe.round_trip(docs.select(*COLUMNS), keep=["doc_id", "lang", "source"])


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("masked_secrets", masked_secrets), ("source_mix", source_mix), ("token_ids", token_ids)]

# Token merges, fingerprints and solved duals are beyond SQL; tests/llm compares with a
# plain version of all stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next. What a
    stage saved on its way goes once its result is written, and the result once the
    next one is."""
    docs = read_table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES:
        had = len(saved_paths())
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
            *used, result = saved_paths()[had:]
            release(spark, [*before, *used])
            before = [result]
    return docs
