"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors of unit length with a cosine of c at least are sqrt(2 - 2c) apart at most. A random
projection with normal weights, shifted and cut into cells of a fixed width, keeps near
vectors in one cell; the cells of several projections together are a bucket of a table, and
several tables make it likely that two near vectors share a bucket. Pairs of a bucket are
compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark.llm.common import field, plain
from ticketspark.llm.components import components
from ticketspark.llm.simhash import Sets
from ticketspark.operators.vocab import sized
from ticketspark.session import materialize

COSINE, SEED = 0.98, 11
# Width of a cell, in multiples of the distance that links; chance that a pair just at that
# distance is missed; unrelated vectors in a bucket, about, which says how many projections.
CELL, MISS, STRANGERS = 10.0, 0.001, 16
# Vectors of a task's group, about: larger buckets are dealt in pairs of parts.
PART_ROWS = 4096


def same_cell(distance: float, width: float) -> float:
    """Chance that two vectors so far apart have one cell of one projection."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - math.sqrt(2 / math.pi) / c * (1 - math.exp(-c * c / 2))


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[float, int, int]:
    """(width, projections of a table, tables) for ``n`` vectors that are compared with each
    other: more projections the more vectors, and as many tables as ``miss`` needs."""
    near = max(math.sqrt(2 - 2 * cosine), 1e-6)
    width = CELL * near
    k = max(1, math.ceil(math.log(max(n / STRANGERS, 1)) / -math.log(same_cell(math.sqrt(2), width))))
    return width, k, max(1, math.ceil(math.log(miss) / math.log1p(-same_cell(near, width) ** k)))


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(x: np.ndarray, width: float, k: int, tables: int, seed: int = SEED) -> np.ndarray:
    """A 64-bit bucket number for each row of ``x`` and table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    out = np.empty((len(x), tables), np.int64)
    for t in range(tables):
        cells = np.floor(x @ rng.standard_normal((x.shape[1], k)) / width + rng.random(k)).astype(np.int64)
        # a random odd factor for each projection; what collides is told apart by the cosine
        out[:, t] = (cells * (2 * rng.integers(1 << 62, size=k) + 1)).sum(axis=1)
    return out


def _searched(tables: int, cosine: float, block: int = 512):
    """Of a group's buckets: how many members of other classes each class is linked to by
    pairs that meet here for the first time, and a forest that joins linked classes."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "dim", "tab", "bucket"], kind="stable", ignore_index=True)
        run_of = pdf.groupby(["label", "dim", "tab", "bucket"], sort=False).ngroup().to_numpy()
        edges = np.flatnonzero(np.diff(run_of, prepend=-1, append=len(pdf)))
        cls, weight = pdf["cls"].to_numpy(), pdf["n"].to_numpy()
        part, lo, hi = (pdf[c].to_numpy() for c in ("part", "lo", "hi"))
        keys = np.array(pdf["keys"].tolist(), np.int64).reshape(len(pdf), tables)
        linked = np.zeros(len(pdf), np.int64)
        # one class may be in several buckets of the group
        _, node = np.unique(cls, return_inverse=True)
        sets = Sets(len(pdf))
        for a, z in zip(edges, edges[1:]):
            one, two = np.arange(a, z), np.arange(a, z)
            if lo[a] != hi[a]:
                one, two = one[part[a:z] == lo[a]], two[part[a:z] == hi[a]]
            if len(one) * len(two) < 2:
                continue
            x = unit(pdf["vec"][a:z])
            tab = int(pdf["tab"][a])
            for b in range(0, len(one), block):
                i, j = np.nonzero(x[one[b:b + block] - a] @ x[two - a].T >= cosine)
                i, j = one[b:b + block][i], two[j]
                if lo[a] == hi[a]:
                    i, j = i[i < j], j[i < j]
                new = np.ones(len(i), bool)
                for t in range(tab):
                    new &= keys[i, t] != keys[j, t]
                i, j = i[new], j[new]
                np.add.at(linked, i, weight[j])
                np.add.at(linked, j, weight[i])
                if len(i):
                    sets.join(node[i], node[j])
        some = np.flatnonzero(linked)
        counts = pd.DataFrame({"a": cls[some], "b": cls[some], "n": linked[some]})
        name = np.zeros(len(pdf), np.int64)
        name[node] = cls
        root = sets.find(np.arange(len(pdf)))
        tied = np.flatnonzero(root != np.arange(len(pdf)))
        return pd.concat([counts, pd.DataFrame({"a": name[tied], "b": name[root[tied]], "n": 0})])
    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    keep: list[str] | None = None, cosine: float = COSINE, miss: float = MISS, seed: int = SEED,
                    part_rows: int = PART_ROWS) -> DataFrame:
    """``keep`` columns (default: all) plus ``n_links`` (other rows whose cosine with the
    row's vector is ``cosine`` or more, found in any table), ``component_id`` (smallest id
    reachable over links, its own included) and ``kept`` (the id is its component's).

    Rows are compared only if their labels are equal and not null and their vectors as
    long. Vectors that are null, empty, zero or hold a null or non-finite component link
    with nothing. Equal vectors of a label are one class, whatever their number. Whatever
    is found has been compared in double precision; a pair at the limit itself is missed
    with probability ``miss``, a nearer one with less. A pair that shares several buckets
    counts in the first only. Every row gives one row, repeated rows and null ids too (ids
    that are null don't name a component where another does; a row that only reaches such
    has a null one and is kept). Input columns named like an output give way; an empty
    table stays empty.

    A bucket of over ``part_rows`` classes is dealt in parts, and pairs of parts are
    groups: no task holds more, and every pair of the bucket is still compared. Distinct
    vectors that are all near each other cost their square in comparisons, as their links
    are counted exactly, but not in rows.
    """
    df = plain(df)
    names = ["n_links", "component_id", "kept"]
    out = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    limit = F.lit(float("inf"))
    ok = F.col(f"`{label_col}`").isNotNull() & F.forall(
        "_vec", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < limit)) & F.exists(
        "_vec", lambda v: v != 0)
    src = df.withColumns({"_id": F.col(f"`{id_col}`"), "_label": F.col(f"`{label_col}`").cast("string"),
                          "_vec": F.col(f"`{vec_col}`")}).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = src.where("_ok")
    classes = good.groupBy(F.col("_label").alias("label"), F.col("_vec").alias("vec")).agg(
        F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "*", F.size("vec").alias("dim")),
                          "vector-classes")
    most = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    width, k, tables = plan(most[0] or 0, cosine, miss)

    def hashed(batches):
        for pdf in batches:
            for _, same in pdf.groupby("dim"):
                for a in range(0, len(same), 4096):
                    part = same.iloc[a:a + 4096]
                    yield part.assign(keys=list(buckets(unit(part["vec"]), width, k, tables, seed)))

    # saved, so that a repeated task can't part the copies of a row
    plain_rows = classes.select("cls", "label", "dim", "n", "vec")
    schema = T.StructType([*plain_rows.schema.fields, field("keys", T.ArrayType(T.LongType()))])
    rows = materialize(plain_rows.mapInPandas(hashed, schema), "vector-keys")
    key = ["label", "dim", "tab", "bucket"]
    large = rows.select("label", "dim", F.posexplode("keys").alias("tab", "bucket")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("size")).where(F.col("size") > part_rows).select(
        *key, F.ceil(F.col("size") / part_rows).cast("int").alias("parts"))
    large = sized(large, "large-buckets")
    bins = max(1, -(-(most[1] or 0) * tables // part_rows))
    each = rows.select("*", F.posexplode("keys").alias("tab", "bucket")).join(large, key, "left")
    each = each.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(
        "part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    with_each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
        F.least("part", other).alias("lo"), F.greatest("part", other).alias("hi")))
    number = F.xxhash64(*key)
    dealt = each.select("cls", "n", "vec", "keys", *key, "part", F.inline(with_each), F.when(
        F.col("parts") > 1, number).otherwise(F.pmod(number, F.lit(bins))).alias("bin"), "parts")
    found = materialize(dealt.groupBy("bin", "parts", "lo", "hi").applyInPandas(
        _searched(tables, cosine), "a long, b long, n long"), "vector-links")

    counts = found.where(F.col("n") > 0).groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    labels = components(found.where(F.col("n") == 0).select("a", "b"))
    named = labels.select(F.col("node").alias("cls"), F.col("label").alias("_top"))
    one = classes.join(named, "cls", "left").join(counts, "cls", "left").select(
        F.col("label").alias("_label"), F.col("vec").alias("_vec"), "first",
        F.coalesce("_top", "cls").alias("_top"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("_links"))
    one = materialize(one, "vector-classes-linked")
    tops = one.groupBy("_top").agg(F.min("first").alias("_component"))
    one = one.join(tops, "_top").select("_label", "_vec", "_links", "_component")
    kept = [F.col(f"`{c}`") for c in out]
    linked = good.join(one, ["_label", "_vec"]).select(*kept, F.col("_links").alias("n_links"), F.col(
        "_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))
    return linked.unionByName(src.where(~F.col("_ok")).select(
        *kept, F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept")))
