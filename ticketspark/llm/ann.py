"""Approximate nearest neighbours by cross-polytope hashing.

Pseudo-rotations (random signs and a fast Hadamard transform, three times) turn unit
vectors; a vector's hash is the signed axis nearest to it. In each of several tables a
query probes the buckets of its nearest axes, and the candidates there are ranked
exactly, by Euclidean distance of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark.operators.vocab import sized
from ticketspark.session import materialize

K, TABLES, PROBES, SEED = 10, 10, 10, 7
# Indexed vectors of a bucket that one task compares at once, about: larger buckets are dealt
# in parts.
PART_ROWS = 4096


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Rows of ``x``, padded to a power of two, under a table's pseudo-rotation."""
    n, d = x.shape
    wide = 1 << max(0, d - 1).bit_length()
    y = np.zeros((n, wide))
    y[:, :d] = x
    rng = np.random.default_rng([seed, table, wide])
    for _ in range(3):
        y = y * rng.choice([-1.0, 1.0], wide)
        h = 1
        while h < wide:  # fast Hadamard transform
            y = y.reshape(n, wide // (2 * h), 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, wide)
            h *= 2
        y /= np.sqrt(wide)
    return y


def axes(x: np.ndarray, table: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The ``probes`` signed axes nearest to each row, nearest first (ties: lower axis)."""
    y = rotate(x, table, seed)
    near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
    return 2 * near + (np.take_along_axis(y, near, 1) < 0)


def _hashed(df: DataFrame, tables: int, probes: Column | int, seed: int, vectors: bool) -> DataFrame:
    """A row for each class, table and probed bucket; ``probes`` of queries, one of others."""
    out = "cls long, query boolean, dim int, tab int, bucket int" + (", vec array<double>" if vectors else "")

    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vec"].map(len)):
                for a in range(0, len(part), 2048):
                    p = part.iloc[a:a + 2048]
                    x = np.array(p["vec"].tolist(), float)
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    cls, q = p["cls"].to_numpy(), p["query"].to_numpy(bool)
                    for t in range(tables):
                        b = axes(x, t, probes, seed)
                        n = np.where(q, b.shape[1], 1)
                        row = np.repeat(np.arange(len(p)), n)
                        col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                        got = {"cls": cls[row], "query": q[row], "dim": dim, "tab": t, "bucket": b[row, col]}
                        if vectors:
                            got["vec"] = p["vec"].to_numpy()[row]
                        yield pd.DataFrame(got)
    return df.select("cls", "query", "vec").mapInPandas(run, out)


def _compare(k: int):
    """Of a group's queries against its indexed vectors: the k nearest classes of each."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(q) or not len(x):
            return pd.DataFrame({"q": [], "cls": [], "dist": []}).astype({"q": "int64", "cls": "int64"})
        # ids in order, and a stable sort: ties go to the smaller id
        x = x.sort_values("cls")
        qv, xv = np.array(q["vec"].tolist(), float), np.array(x["vec"].tolist(), float)
        cls, out = x["cls"].to_numpy(), []
        step = max(1, (1 << 21) // xv.size)
        for a in range(0, len(qv), step):
            d = np.sqrt(((qv[a:a + step, None, :] - xv[None]) ** 2).sum(axis=2))
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({
                "q": np.repeat(q["cls"].to_numpy()[a:a + step], best.shape[1]),
                "cls": cls[best].ravel(), "dist": np.take_along_axis(d, best, 1).ravel()}))
        return pd.concat(out)
    return run


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int = K, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each query row, nearest first,
    ties to the smaller id; ``score`` is the Euclidean distance. The id column keeps its
    name (``query_id``, ``rank`` and ``score`` give way to the outputs).

    Vectors that are null, empty, zero or hold a null or non-finite component take no
    part, nor do rows with a null id; vectors of different lengths are not compared. Rows
    that agree in id are one, and never their own neighbours; of an id with several
    vectors the nearest counts. Equal vectors are one class in the index with the k + 1
    smallest ids of its members, which is all that any result can hold of it; so no bucket
    holds copies. A query with fewer than k found is compared with all vectors, in parts.
    An empty table has no result.
    """
    vec = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    src = df.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec"), F.coalesce(
        is_query, F.lit(False)).alias("query")).where(F.col("id").isNotNull())
    big = F.lit(float("inf"))
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(
        "vec", lambda x: x != 0)
    rows = materialize(src.where(F.coalesce(ok, F.lit(False))), "vectors")
    classes = materialize(rows.groupBy("vec").agg(
        F.min("id").alias("cls"), F.max("query").alias("asked")), "vector-classes")
    # at most k + 1 members of a class leave each task
    first = Window.partitionBy("vec").orderBy("id")
    members = rows.select("vec", "id").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    members = materialize(members.join(classes, "vec").select("cls", "id"), "vector-members")
    asking = materialize(rows.where("query").select("vec", "id").join(
        classes, "vec").select("cls", F.col("id").alias("qid")).distinct(), "vector-queries")

    queries = classes.where("asked").select("cls", "vec", F.lit(True).alias("query"))
    index = classes.select("cls", "vec", F.lit(False).alias("query"))
    key = ["dim", "tab", "bucket"]
    found = _in_parts(_hashed(index.unionByName(queries), tables, probes, seed, True), key,
                      _hashed(index, tables, probes, seed, False), k)
    found = _top(found, k)
    # (q, id, dist) of the k + 1 nearest members: the query itself may be among them
    found = materialize(_members(found, members, k), "vector-found")
    have = found.groupBy(F.col("q").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    short = queries.join(have, "cls", "left").where(F.coalesce("n", F.lit(0)) <= k).select(
        "cls", "vec", "query")
    short = materialize(short, "vector-short")
    if not short.isEmpty():
        whole = index.unionByName(short).select("*", F.size("vec").alias("dim"))
        again = _members(_top(_in_parts(whole, ["dim"], whole.where(~F.col("query")), k), k), members, k)
        found = found.join(short.select(F.col("cls").alias("q")), "q", "left_anti").unionByName(again)
    out = asking.withColumnRenamed("cls", "q").join(found, "q").where(F.col("qid") != F.col("id"))
    out = out.groupBy("qid", "id").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("qid").alias("query_id"), "rank", F.col("id").alias(id_col), F.col("dist").alias("score"))


def _in_parts(rows: DataFrame, key: list[str], indexed: DataFrame, k: int) -> DataFrame:
    """Nearest classes within each group of ``key``. The ``indexed`` rows of a group that has
    many more than PART_ROWS are dealt over parts of about so many, and the queries that probe
    this group go to each of its parts; all other groups stay whole."""
    large = indexed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS)
    large = sized(large.select(*key, F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")), "large-groups")
    rows = rows.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")))
    dealt = rows.withColumn("part", F.explode(part)).drop("parts")
    return dealt.groupBy(*key, "part").applyInPandas(_compare(k + 1), "q long, cls long, dist double")


def _top(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("q", "cls").agg(F.min("dist").alias("dist"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy("dist", "cls"))
    return one.withColumn("n", nth).where(F.col("n") <= k + 1).drop("n")


def _members(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))
    return found.join(members, "cls").withColumn("n", nth).where(F.col("n") <= k + 1).select("q", "id", "dist")
