import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import mixing as M
from ticketspark.llm.queries import queries


def targets(sizes, weights=(3, 1, 2), total=1.5, most=2):
    """Water-filling in turns: {source: size} -> {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), total * sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] > most * sizes[s]}
        if not full:
            return out | share
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def check(got, docs, slack):
    """``docs``: (doc_id, text, source) of each row, in any order."""
    n = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in docs]
    total = defaultdict(int)
    for _, k, s in n:
        total[s] += k
    want = targets(total)
    taken = defaultdict(int)
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((i or -1, k) for i, k, _ in n)
    source = {i: s for i, _, s in n}
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else r.source  # a null id says nothing
        assert r.source_size == total[s] and r.target == pytest.approx(want[s])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[s] += r.taken
    for s in total:
        longest = max(k for _, k, x in n if x == s)
        assert abs(taken[s] - want[s]) <= slack * longest + 1


@pytest.mark.parametrize("sf,slack", [(SF001, 0.5), (SF01, 0.1)])
def test_query_meets_targets(spark, sf, slack):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries()["op1_mixing"](spark, sf).collect(), docs, slack)


def test_edge_rows(spark):
    got = M.mix(edge_docs(spark)).collect()
    assert len(got) == len(rows()) and all(r.copies == 1 for r in got if r["size"] == 0)
    check(got, [(r[0], r[1], r[3]) for r in rows()], 0.5)
    assert M.mix(empty_docs(spark)).count() == 0


def test_reruns_agree_on_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    one = M.mix(docs, keep=["doc_id"]).collect()
    two = M.mix(docs.repartition(7), keep=["doc_id"]).collect()
    assert sorted(one) == sorted(two)


def test_hot_source_of_equal_sizes(spark):
    # one source holds most rows, all of one size; extra copies are spread over buckets
    data = [(i, "a b c", "hot") for i in range(4000)] + [(9000 + i, "x " * 40, f"s{i}") for i in range(300)]
    got = M.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    check(got, data, 0.5)


def test_tilts_solve_the_dual(spark):
    """Each source's lambda is the root that bisection finds; rates above the cap are cut."""
    rnd = random.Random(2)
    data = [(i, "w " * rnd.choice([0, 1, 2, 5, 20, 100, 700]), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    src = F.col("source")
    cells = docs.groupBy(F.coalesce(src, F.lit("")).alias("_s"), src.isNull().alias("_z"), M.words(F.col("text")).alias("_size")).agg(
        F.count(F.lit(1)).alias("n"))
    rows_ = cells.collect()
    got = M.tilts(cells, M.targets(cells, M.WEIGHTS, M.TOTAL, M.MOST), M.MOST).collect()
    assert len(got) == 5
    for r in got:
        own = [(c["_size"], c.n) for c in rows_ if (c["_s"], c["_z"]) == (r["_s"], r["_z"]) and c["_size"]]
        assert r.scale == pytest.approx(sum(z * n for z, n in own) / sum(n for _, n in own))
        if r["_full"]:
            assert r.target == pytest.approx(2 * r.source_size)
            continue
        def taken(lam):
            return sum(n * z * min(2.0, math.exp(lam * z / r.scale)) for z, n in own)
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if taken(mid) < r.target else (lo, mid)
        assert taken(r.lam) == pytest.approx(r.target, rel=1e-5, abs=1.1)
        assert r.lam == pytest.approx(lo, abs=2e-3)
    assert {r["_full"] for r in got} == {True, False}


def test_steps_that_don_t_converge_are_told(spark, monkeypatch):
    monkeypatch.setattr(M, "ROUNDS", 1)
    monkeypatch.setattr(M, "STEPS", 1)
    data = [(i, "w " * (1 + i % 90), "ab"[i % 2]) for i in range(300)]
    with pytest.raises(RuntimeError, match="after 1 steps"):
        M.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), weights=(5, 1))


def test_rates_are_tilted_by_size(spark):
    # a target below the size takes short documents more often than long ones; one above it
    # the long ones, until they reach the cap
    data = [(i, "w " * (1 + i % 50), "a") for i in range(1000)] + [(5000 + i, "w " * 250, "b") for i in range(100)]
    for weights, total, long_first in (((1, 3), 0.7, False), ((1, 1), 1.3, True)):
        got = M.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), weights=weights, total=total).collect()
        a = next(r for r in got if r.doc_id == 0)
        assert (a.target > a.source_size) == long_first

        def mean(of):
            return sum(r.copies for r in of) / len(of)
        long = mean([r for r in got if r.doc_id < 5000 and r["size"] > 40])
        short = mean([r for r in got if r.doc_id < 5000 and r["size"] < 10])
        assert (long - short > 0.05) if long_first else (short - long > 0.05)


@pytest.mark.parametrize("hot", [7, None])
def test_many_rows_of_one_id_are_dealt_in_parts(spark, monkeypatch, hot):
    """As many copies for each id as if the id's rows stood in one bucket."""
    data = [(hot, "a b c", "s")] * 900 + [(i, "a b c", "s") for i in range(300)] + [(5000 + i, "x " * 30, "t") for i in range(200)]
    src = spark.createDataFrame(data, "doc_id long, text string, source string")
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    monkeypatch.setattr(M, "LARGE", 1000)
    want = M.mix(src, keep=["doc_id"]).collect()
    monkeypatch.setattr(M, "LARGE", 4)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for parts in (1, 6):
        got = M.mix(src.repartition(parts), keep=["doc_id"]).collect()
        assert sorted(got, key=key) == sorted(want, key=key)
    if hot is not None:
        check(got, data, 0.5)
