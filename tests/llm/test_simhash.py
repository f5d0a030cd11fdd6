import random
import re

import numpy as np
import pytest
import xxhash

from conftest import SF001, SF01
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import simhash as S
from ticketspark.llm.components import components
from ticketspark.llm.queries import queries


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def classes(fp, bits=3):
    """A label for each fingerprint, equal within a component, by comparing all."""
    fp = np.array(fp, np.uint64)
    label = np.arange(len(fp))
    near = [np.flatnonzero(np.bitwise_count(fp ^ x) <= bits) for x in fp]
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            return label
        label = low


def check(got):
    label = classes([int(r.fingerprint, 16) for r in got])
    smallest = {}
    for k, r in zip(label, got):
        if r.doc_id is not None:
            smallest[k] = min(smallest.get(k, r.doc_id), r.doc_id)
    assert [r.component_id for r in got] == [smallest.get(k) for k in label]
    return label


def test_query_matches_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = queries()["op2_simhash"](spark, SF01).collect()
    assert len(got) == len(docs)
    for r in got[::7]:
        assert int(r.fingerprint, 16) == fingerprint(docs[r.doc_id])
    check(got)


def test_edge_rows(spark):
    src = edge_docs(spark)
    got = S.simhash(src).collect()
    assert len(got) == len(rows())
    assert all(int(r.fingerprint, 16) == fingerprint(r.text) for r in got if len(r.text or "") < 1000)
    label = check(got)
    for k in set(label):
        group = [r for r, x in zip(got, label) if x == k]
        assert sum(r.kept for r in group) == 1
        assert next(r.doc_id for r in group if r.kept) == group[0].component_id
    assert S.simhash(empty_docs(spark)).count() == 0


def planted(n, seed):
    """Random fingerprints, a dense ball, chains of near ones and sparse ones."""
    rnd = random.Random(seed)
    fp = [rnd.getrandbits(64) for _ in range(n)]
    centre = rnd.getrandbits(64)
    for _ in range(n):
        x = centre
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(64)
        fp.append(x)
    for _ in range(n // 10):
        x = rnd.choice(fp[:n])
        for _ in range(5):
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fp.append(x)
    fp += [0, 1, 3, 7, 15, 31, (1 << 64) - 1, (1 << 64) - 2]
    return sorted(set(fp))


def label_of(pairs, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in nodes]


@pytest.mark.parametrize("n,shard", [(300, 8), (300, 64), (600, 4096)])
def test_links_connect_what_is_near(spark, n, shard):
    fp = planted(n, n + shard)
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    got = [(r.a, r.b) for r in S.links(df, "fp", 3, shard).collect()]
    bits = {x: y for x, y in zip(signed, fp)}
    assert all((bits[a] ^ bits[b]).bit_count() <= 3 * 64 for a, b in got)
    want = classes(fp).tolist()
    have = label_of(got, signed)
    assert len(set(zip(want, have))) == len(set(want)) == len(set(have))


def test_shard_links_are_few_for_many_pairs():
    rnd = random.Random(5)
    fp = np.array(sorted({sum(1 << rnd.randrange(8) for _ in range(2)) for _ in range(500)} | {0}), np.uint64)
    a, _ = S.shard_links(fp, np.ones(len(fp), bool), 3)
    assert len(a) < len(fp)


def test_components_match_plain(spark):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)]
    pairs += [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    assert sorted(got) == nodes
    want = label_of(pairs, nodes)
    assert len(set(zip(want, [got[x] for x in nodes]))) == len(set(want)) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_a_dense_leaf_are_bounded(spark):
    # a cluster that no vantage point parts, some apart from it, and strangers
    rnd = np.random.default_rng(4)
    base = np.uint64(0x0123456789ABCDEF)
    low = rnd.choice(1 << 12, 2500, replace=False).astype(np.uint64)
    fp = np.unique(np.concatenate([base ^ low, rnd.integers(0, 1 << 63, 1500).astype(np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = S.dealt(df, shard_rows=64, guest_rows=400).toPandas()
    size = got.groupby(["leaf", "block"])["home"].agg(["sum", "size"])
    assert size["sum"].max() <= 4 * 64 and (size["size"] - size["sum"]).max() <= 400
    assert len(got["fp"].unique()) == len(fp)
    sets = S.Sets(len(fp))
    for r in S.links(df, shard_rows=64, guest_rows=400).collect():
        a, b = (np.searchsorted(fp, np.array([x], np.int64).view(np.uint64)) for x in (r.a, r.b))
        sets.join(a, b)
    assert (sets.find(np.arange(len(fp))) == classes(fp)).all()
