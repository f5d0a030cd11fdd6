import random

from conftest import SF001
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import tokens
from ticketspark.llm.queries import queries


def check(got, texts):
    ids = tokens.counter().model.encode([t or "" for t in texts], num_threads=1)
    for r, text, x in zip(got, texts, ids):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), len(x), len(x) > 4096)


def test_query_matches_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries()["op3_tokens"](spark, SF001).collect()
    assert len(got) == len(docs)
    check(got, [docs[r.doc_id] for r in got])


def test_edge_rows(spark):
    got = tokens.count_tokens(edge_docs(spark)).collect()
    assert len(got) == len(rows()) and any(r.over_limit for r in got)
    check(got, [r.text for r in got])
    assert tokens.count_tokens(empty_docs(spark)).count() == 0


def test_odd_texts():
    rnd = random.Random(1)
    pool = ["a", "B", "é", " ", "  ", "\n", "\r\n", " ", "　", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "the",
            "token", "!!!", "ﬁ", "🙂", "\x00", "﻿", "¸", "́", "‍", " "]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(5000)]
    texts += ["a" * 5_000, " " * 3_000, "x" + " " * 37 + "y", " ", "a ", " a"]
    c = tokens.counter()
    assert c.count(texts).tolist() == [len(x) for x in c.model.encode(texts, num_threads=1)]


def test_whole_tokens_are_proven():
    c = tokens.counter()
    assert len(c.whole) > 10_000
    some = sorted(c.whole)[::500]
    assert all(len(c.model.encode(w[1:])) == 1 for w in some)
