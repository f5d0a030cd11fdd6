import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketspark.llm import ann as A
from ticketspark.llm.queries import queries

DIR = "/root/testdata/sf0.1"


def exact(x, ids, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q]
    return [(ids[i], d[i]) for i in order[:k]]


def test_query_recall(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = queries()["op6_neighbours"](spark, DIR).collect()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        for _, v, s in own:
            assert s == pytest.approx(math.dist(x[ids == v][0], x[ids == q][0]), abs=1e-12)
        want = {v for v, _ in exact(x, ids, q)}
        hit += len(want & {r[1] for r in own})
        total += 10
    assert hit / total >= 0.9


SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def test_invalid_equal_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [nan, 1.0, 0.0]), (4, [inf, 0.0, 1.0]),
            (5, [None, 1.0, 1.0]), (6, []), (100, [1.0, 1.0]), (7, [0.0, 2.0, 0.0]), (8, [0.0, 2.0, 0.0]),
            (9, [-1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (7, [0.0, 2.0, 0.0]), (200, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)
    got = A.nearest(df, F.col("vec_id") % 100 == 0).collect()
    by = {q: [(r.vec_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
          for q in (0, 100, 200)}
    root = round(math.sqrt(5), 9)
    assert by[0] == [(200, 0.0), (7, root), (8, root), (9, 2.0)] or by[0] == [
        (200, 0.0), (9, 2.0), (7, root), (8, root)]
    assert by[0][1:] == sorted(by[0][1:], key=lambda r: (r[1], r[0]))
    assert by[200][0] == (0, 0.0) and by[100] == []
    assert A.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_very_common_vector(spark):
    rng = np.random.default_rng(1)
    data = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)]
    data += [(5000 + i, rng.normal(size=4).tolist()) for i in range(500)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(6)
    got = A.nearest(df, F.col("vec_id") % 500 == 0).collect()
    for q in range(0, 3000, 500):
        own = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert own == [i for i in range(12) if i != q][:10]


def test_parts_of_a_large_bucket_change_nothing(spark, monkeypatch):
    df = spark.read.parquet(f"{DIR}/embeddings.parquet").where("vec_id < 600")
    whole = sorted(A.nearest(df, F.col("vec_id") % 100 == 0).collect())
    monkeypatch.setattr(A, "PART_ROWS", 3)
    assert sorted(A.nearest(df, F.col("vec_id") % 100 == 0).collect()) == whole


def test_rotation_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(50, 37))
    y = A.rotate(x, 3)
    assert y.shape == (50, 64) and np.allclose((x ** 2).sum(1), (y ** 2).sum(1))
