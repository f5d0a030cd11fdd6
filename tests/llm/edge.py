"""Rows that every operator on texts has to take: nulls, empty and long texts, ties."""

from pyspark.sql import types as T

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [None, "", " ", "\n\t ", "a", "a b c", "Ünïcode straße 漢字 🙂", "x" * 50_000, LONG, LONG,
         "one line\none line\n\none line", "nul\x00in\x00side", "password = abcdefgh12345678",
         "mail me at a.b@c.example.org now", "All rights reserved. CC BY 4.0"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that outputs have, in another case too
    T.StructField("N_Words", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("Kept", T.StringType()), T.StructField("n_tokens", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("score", T.StringType()),
    # names that operators use inside
    *[T.StructField(n, T.StringType()) for n in ("_text", "_row", "_id", "_owner", "_found", "_size")]])


def rows():
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None, *["x"] * 12)
           for i, t in enumerate(TEXTS)]
    return [*out, out[5], out[5], (None, "a text of a null id", "en", "s1", 1, *["x"] * 12),
            (None, None, None, None, None, *[None] * 12)]


def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
