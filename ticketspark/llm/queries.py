"""The registered queries of this package, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.llm import (ann, bpe, divergence, fim, langid, licenses, mixing, pii, pstable, quality,
                             secrets, simhash, tokens)
from ticketspark.llm.oracle import oracle_sql  # noqa: F401  (registered with the queries)
from ticketspark.sources.tables import read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), keep=["doc_id"])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(documents(spark, sf_dir), keep=["doc_id"]).drop("kept")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), keep=["doc_id"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), keep=["doc_id"])


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir), keep=["doc_id"]).drop("found")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 100 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(documents(spark, sf_dir), keep=["doc_id"]).drop("found")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    apart = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~apart))
    return langid.predict(docs.select("doc_id", "text", apart.alias("held_out")), model,
                          keep=["doc_id", "held_out"])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), keep=["doc_id"])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(documents(spark, sf_dir), keep=["doc_id"])
    return found.drop("found")


def op11_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(read_table(spark, sf_dir, "embeddings"), keep=["vec_id"])


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(documents(spark, sf_dir), keep=["doc_id"])
    back = fim.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_mixing, op2_simhash, op3_tokens, op4_quality, op5_licenses, op6_neighbours, op7_pii, op8_language,
        op9_bpe, op10_secrets, op11_vector_duplicates, op12_divergence, op13_fim)}
