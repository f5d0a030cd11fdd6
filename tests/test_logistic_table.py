"""Logistic regression with coefficients as a table, against the one on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketspark.functions.text import tokens
from ticketspark.operators import logistic as L
from ticketspark.operators import predict as P

WORDS = ["pay", "card", "ship", "late", "lost", "refund", "open", "close", "help"]
LABELS = ["billing", "delivery", "other"]
SCHEMA = "ticket_id long, instruction string, intent string"


def noisy(spark, n=160, seed=3):
    """Texts whose label is a draw, so that no coefficients separate the classes."""
    rng = np.random.default_rng(seed)
    pull = rng.normal(size=(len(WORDS), len(LABELS)))
    rows = []
    for i in range(n):
        at = rng.integers(0, len(WORDS), rng.integers(1, 5))
        p = np.exp(pull[at].sum(axis=0))
        rows.append((i, " ".join(WORDS[a] for a in at), LABELS[rng.choice(len(LABELS), p=p / p.sum())]))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def exact(train, reg):
    """Newton's method on all coefficients at once: class probabilities by id."""
    rows = train.collect()
    x = np.array([[r.instruction.split().count(w) for w in WORDS] for r in rows], float)
    y = np.eye(3)[[LABELS.index(r.intent) for r in rows]]
    a, n, d = np.c_[x / x.std(axis=0, ddof=1), np.ones(len(x))], len(x), len(WORDS) + 1
    w, fine = np.zeros((d, 3)), reg * np.r_[np.ones(d - 1), 0.0]
    for _ in range(60):
        p = np.exp(a @ w)
        p /= p.sum(axis=1, keepdims=True)
        slope = a.T @ (p - y) / n + fine[:, None] * w
        bend = np.block([[(a * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a / n for j in range(3)]
                         for i in range(3)]) + np.diag(np.tile(fine, 3))
        w -= np.linalg.lstsq(bend, slope.T.ravel(), rcond=1e-12)[0].reshape(3, d).T
    assert np.abs(slope).max() < 1e-9
    return {r.ticket_id: q for r, q in zip(rows, p)}


def compare(got, want, within):
    """Probabilities agree within a tolerance, and labels where it cannot turn them."""
    assert set(got) == set(want)
    for i, p in want.items():
        assert got[i].confidence == pytest.approx(p.max(), abs=within)
        if np.sort(p)[-1] - np.sort(p)[-2] > 2 * within:
            assert got[i].predicted_intent == LABELS[p.argmax()]


def test_blocks_and_parts_equal_newton(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)  # several row and feature blocks
    monkeypatch.setattr(L, "PART_BLOCKS", 8)  # several parts of a feature block, added up in groups
    monkeypatch.setattr(L, "HELD_VALUES", 64)
    train = noisy(spark)
    model = L.fit_logistic_table(train, reg=0.2)
    assert model.size == 8 and model.coef.agg(F.max("parts")).first()[0] > 1
    got = {r.ticket_id: r for r in L.predict_logistic_table(model, train).collect()}
    compare(got, exact(train, 0.2), 1e-3)


def test_equals_the_fit_on_the_driver(spark):
    train = noisy(spark)
    got = {r.ticket_id: r for r in L.predict_logistic_table(
        L.fit_logistic_table(train, reg=0.0, tol=1e-3), train).collect()}
    want = exact(train, 0.0)
    compare(got, want, 0.02)
    own = {r.ticket_id: r.predicted_intent for r in P.predict_logistic(
        P.fit_logistic(train, num_features=1 << 10), train).collect()}
    for i, p in want.items():
        if np.sort(p)[-1] - np.sort(p)[-2] > 0.04:
            assert own[i] == got[i].predicted_intent


def test_edges_saving_and_many_classes(spark, tmp_dir):
    rows = [(1, "pay", "a"), (2, "pay card", "a"), (3, "ship", "b"), (4, None, "b"), (5, "", None), (1, "ship", "b")]
    train = spark.createDataFrame(rows, SCHEMA)
    L.save_logistic_table(L.fit_logistic_table(train, reg=0.1), f"{tmp_dir}/lr")
    model = L.load_logistic_table(spark, f"{tmp_dir}/lr")
    asked = spark.createDataFrame([(1, "pay", "x"), (1, "SHIP ship", "y"), (2, "unknown", "z"), (None, None, None)],
                                  SCHEMA)
    got = {(r.intent, r.predicted_intent) for r in L.predict_logistic_table(model, asked).collect()}
    assert {("x", "a"), ("y", "b")} <= got and len(got) == 4
    assert L.predict_logistic_table(model, asked.limit(0)).count() == 0
    nothing = L.fit_logistic_table(train.limit(0))
    assert [r.predicted_intent for r in L.predict_logistic_table(nothing, asked).collect()] == [None] * 4
    one = L.fit_logistic_table(train.where("intent = 'a'"))
    assert {r.predicted_intent for r in L.predict_logistic_table(one, asked).collect()} == {"a"}
    # a block of many classes has few rows, so that its values stay within the bound
    assert L._size(3) == L.BLOCK and L._size(1000) == 64 and L._size(10 ** 6) == 1


def test_not_converged_raises(spark):
    with pytest.raises(RuntimeError):
        L.fit_logistic_table(noisy(spark, 60), reg=0.0, max_iter=1)


def test_own_tokens_of_a_text_share_a_feature(spark, monkeypatch):
    """The fit equals Newton's on a column for each token, with a feature for the tokens of
    one text alone, which blocks hold as packed bytes."""
    train = noisy(spark, 40).withColumn("instruction", F.when(F.col("ticket_id") % 2 == 0, F.concat(
        "instruction", F.lit(" x"), "ticket_id", F.lit(" y"), "ticket_id", F.lit(" y"), "ticket_id")).otherwise(
        F.col("instruction")))
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setitem(globals(), "WORDS", WORDS + [f"{c}{i}" for c in "xy" for i in range(0, 40, 2)])
    model = L.fit_logistic_table(train, reg=0.2)
    assert model.vocab.count() == len(WORDS) == 9 + 40
    assert model.vocab.agg(F.max("feature")).first()[0] == 9 + 20 - 1
    got = {r.ticket_id: r for r in L.predict_logistic_table(model, train).collect()}
    compare(got, exact(train, 0.2), 1e-3)


def test_terms_hold_a_token_once_a_batch(spark, monkeypatch):
    """Frequencies are those of ``functions.text.tokens``; a batch has each of its tokens as a
    string once, however many rows hold it, and rows without tokens are kept."""
    texts = [" Pay pay\tCARD\u000bpay ", "", None, "  ", "card Été été\n x", "pay " * 50 + "card"]
    rows = spark.createDataFrame(list(enumerate(texts * 4)), "_row long, _text string").coalesce(1)
    want = {(r._row, t): r.t.count(t) for r in rows.select("_row", tokens("_text").alias("t")).collect() for t in r.t or ()}
    for held in (L.TERMS, 60):
        monkeypatch.setattr(L, "TERMS", held)
        got, seen, batches = {}, [], L._terms(rows).collect()
        for b in batches:
            ids, lengths, code, tf = (np.frombuffer(v, t) for v, t in zip((b.rows, b.lengths, b.code, b.tf), "qiii"))
            seen += ids.tolist()
            for i, c, n in zip(np.repeat(ids, lengths), code, tf):
                got[int(i), b.words[c].token] = int(n)
            for c, w in enumerate(b.words):
                own = [(int(i), int(n)) for i, x, n in zip(np.repeat(ids, lengths), code, tf) if x == c]
                assert (w.df, w.s, w.q, w.first) == (len(own), sum(n for _, n in own), sum(n * n for _, n in own), own[0][0])
            assert len({w.token for w in b.words}) == len(b.words)
        assert got == want and sorted(seen) == list(range(len(texts) * 4))
        assert len(batches) == 1 if held > 60 else len(batches) > 1
