import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import langid as L
from ticketspark.llm.queries import queries


def test_query_accuracy_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = queries()["op8_language"](spark, SF01).collect()
    assert len(got) == len(lang)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    out = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(out) > 100 and sum(out) / len(out) >= 0.97


def test_probabilities_of_a_context_add_up(spark):
    df = spark.createDataFrame([("abba abab baab abc", "x"), ("zz zy zx", "y")], "text string, lang string")
    m = L.fit(df)
    assert m.langs == ["x", "y"]
    for k, chars in enumerate([" abcq", " xyzq"]):  # each language's own, and an unknown one
        for context in ("   ", "  a", "bab", "zzz", "qqq", "  z"):
            rows_ = np.array([[*map(ord, context), ord(c)] for c in chars], np.uint32)
            assert np.isclose(np.exp(m.log_probs(rows_)[:, k]).sum(), 1)
    seen = np.array([[*map(ord, "  a"), ord("b")]], np.uint32)
    assert m.log_probs(seen)[0, 0] > m.log_probs(seen)[0, 1]


def test_edge_rows(spark):
    m = L.fit(edge_docs(spark))
    got = L.predict(edge_docs(spark), m).collect()
    assert len(got) == len(rows())
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1
    assert L.predict(empty_docs(spark), m).count() == 0
    none = L.fit(empty_docs(spark))
    assert {r.lang_pred for r in L.predict(edge_docs(spark), none).collect()} == {"und"}


def test_smallest_counts_go_first(spark):
    df = spark.createDataFrame([("aaa aaa aaa bcd", "x")], "text string, lang string")
    small = L.fit(df, max_grams=4)
    assert 0 < len(small.tables[0][-1].gram) <= 4


def test_far_text_is_rejected(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    m = L.fit(docs.where(~L.held_out(F.col("doc_id"))))
    odd = spark.createDataFrame([(1, "щжцч фыва " * 40), (2, "the that thing and the other " * 10)],
                                "doc_id long, text string")
    got = {r.doc_id: r for r in L.predict(odd, m).collect()}
    assert got[1].rejected and got[1].score < 0.5 and got[1].lang_pred in m.langs
    assert got[2].lang_pred == "en"


def test_every_gram_of_a_large_corpus_is_kept(spark):
    # over a million distinct n-grams of the large language, and some of a small one that
    # stand once each
    rnd = np.random.default_rng(5)
    words = ["".join(map(chr, w)) for w in rnd.integers(0x4E00, 0x9000, (250_000, 5)).tolist()]
    large = [(" ".join(words[i:i + 500]), "big") for i in range(0, len(words), 500)]
    df = spark.createDataFrame([*large, ("щука фыва жщцк", "rare")], "text string, lang string")
    m = L.fit(df)
    assert m.langs == ["big", "rare"]
    texts = spark.createDataFrame([(1, "фыва щука"), (2, words[7]), (3, None), (4, "12 34")], "id long, text string")
    got = {r.id: r for r in L.predict(texts, m).collect()}
    assert [got[i].lang_pred for i in (1, 3, 4)] == ["rare", "und", "und"]
    whole = {r.id: r for r in L.predict(texts, L.fit(df, broadcast_grams=10_000_000)).collect()}
    for i in (1, 2):
        assert got[i].lang_pred == whole[i].lang_pred and np.isclose(got[i].cross_entropy, whole[i].cross_entropy)


def test_saved_tables_predict_what_the_broadcast_model_does(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_TEXTS", 20)  # hot n-grams go in parts
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(150).unionByName(
        edge_docs(spark), allowMissingColumns=True).select("doc_id", "text", "lang", F.lit("x").alias("Score"))
    small, large = L.fit(docs), L.fit(docs, broadcast_grams=10)
    assert isinstance(small, L.Model) and isinstance(large, L.SavedModel) and small.langs == large.langs
    assert sum(len(t[-1].gram) for t in small.tables) == large.grams[-1].count()
    assert np.allclose(small.usual, large.usual) and np.allclose(small.floor, large.floor)
    a, b = L.predict(docs, small), L.predict(docs, large)
    assert a.columns == b.columns and a.dtypes == b.dtypes
    key = lambda r: (str(r.doc_id), str(r.text))
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(a) == len(b) == docs.count()
    for x, y in zip(a, b):
        assert key(x) == key(y) and (x.lang_pred, x.rejected) == (y.lang_pred, y.rejected)
        assert np.isclose(x.score, y.score, atol=1e-6)
        assert x.cross_entropy == y.cross_entropy or np.isclose(x.cross_entropy, y.cross_entropy, atol=1e-7)
    assert L.predict(empty_docs(spark), large).count() == 0


def plain_kneser_ney(texts):
    """-log p of each n-gram's last character, by dicts: (chars before, char) -> nats."""
    counts = [Counter() for _ in range(L.ORDER + 1)]
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = " " * (L.ORDER - 1) + w + " "
            counts[L.ORDER].update(padded[i:i + L.ORDER] for i in range(len(w) + 1))
    for n in range(L.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    chars = len(counts[1])

    def discount(n):
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        return min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))

    def p(gram):
        if not gram:
            return 1 / (chars + 1)
        n, d = len(gram), discount(len(gram))
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * p(gram[1:])

    def cross_entropy(text):
        grams = [(" " * (L.ORDER - 1) + w + " ")[i:i + L.ORDER]
                 for w in re.findall(r"[^\W\d_]+", text.lower()) for i in range(len(w) + 1)]
        return sum(-math.log(p(g)) for g in grams) / len(grams)
    return cross_entropy


def test_models_equal_a_plain_kneser_ney(spark):
    train = {"en": ["The cat sat on the mat", "a cat and a dog, the dogs", "that thing there"],
             "de": ["der Hund und die Katze", "das ist ein Haus und dort", "Straße über dem Fluß"]}
    df = spark.createDataFrame([(t, x) for x, ts in train.items() for t in ts], "text string, lang string")
    asked = ["the cat and the dog", "die Straße und das Haus", "qqq zzz", "cat", "x", "THE\u0130 \u00e9t\u00e9"]
    texts = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    models = {x: plain_kneser_ney(ts) for x, ts in train.items()}
    for grams in (L.BROADCAST_GRAMS, 5):
        for r in L.predict(texts, L.fit(df, broadcast_grams=grams)).collect():
            want = {x: m(asked[r.id]) for x, m in models.items()}
            assert r.lang_pred == min(want, key=lambda x: (want[x], x))
            assert math.isclose(r.cross_entropy, want[r.lang_pred], abs_tol=1e-6), asked[r.id]


def test_rejection_is_calibrated_on_texts_left_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    learned = docs.where(~L.held_out(F.col("doc_id")))
    m = L.fit(learned)
    assert all(0 < limit < 1000 for _, limit in m.usual)
    # of texts that neither the models nor the limits have seen, few are rejected
    unseen = L.predict(docs.where(L.held_out(F.col("doc_id")) & ~L.left_out(F.col("text"))), m, excess=True)
    rows_ = [r for r in unseen.collect() if r.lang_pred == r.lang]
    assert sum(r.rejected for r in rows_) / len(rows_) < 0.03
    limits = dict(zip(m.langs, (limit for _, limit in m.usual)))
    assert all(r.rejected == (r.excess > limits[r.lang_pred]) for r in rows_)
    # shuffled letters of the same texts are
    rnd = random.Random(1)
    odd = [(i, "".join(rnd.sample(t, len(t)))) for i, t in enumerate(r.text.replace(" ", "")[:300] for r in rows_[:60])]
    got = L.predict(spark.createDataFrame(odd, "id int, text string"), m).collect()
    assert sum(r.rejected for r in got) / len(got) > 0.9


def test_a_language_without_left_out_texts_has_a_limit(spark):
    rows_ = [(f"the cat and the dog number {'abcdefghij'[i % 10] * (i // 10 + 1)}", "en") for i in range(100)]
    m = L.fit(spark.createDataFrame([*rows_, ("qu\u00e9 pasa aqu\u00ed", "es")], "text string, lang string"))
    assert m.langs == ["en", "es"] and m.usual[0][1] == m.usual[1][1] < math.inf
    alone = L.fit(spark.createDataFrame([("ab", "x")], "text string, lang string"))
    assert len(alone.langs) == 1
