import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from conftest import SF001
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import bpe
from ticketspark.llm.queries import queries


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.TOKENIZER)))


def check(got, library, texts):
    for r, text in zip(got, texts):
        ids = library.encode_ordinary(text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_query_matches_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries()["op9_bpe"](spark, SF001).collect()
    assert len(got) == len(docs)
    check(got, library, [docs[r.doc_id] for r in got])


def test_edge_rows(spark, library):
    got = bpe.round_trip(edge_docs(spark)).collect()
    assert len(got) == len(rows())
    check(got, library, [r.text for r in got])
    assert bpe.round_trip(empty_docs(spark)).count() == 0


def test_encode_and_decode_are_inverse(spark, library):
    out = bpe.decode(bpe.encode(edge_docs(spark), keep=["text"])).collect()
    for r in out:
        assert list(r.ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_odd_texts(library):
    rnd = random.Random(1)
    pool = ["a", "B", "é", " ", "  ", "\n", "\t", "\r\n", " ", "'s", "1", "²", "三", "🙂", "́", "\x00a\x00b",
            "\x1c", "\x85", "<|endoftext|>", "the", "!!!", "​", "\U00010ee7", "\U0003fb27", "՘"]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["a" * 20_000, "=" * 5_000, " " * 5_000 + "x", "ab" * 3_000, "aab" * 30]
    ids, n = bpe.codec().encode(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    for t, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(t)


def test_rounds_and_heap_agree():
    rnd = random.Random(2)
    replay = bpe.codec().replay
    words = ["".join(rnd.choices("abcdeth ing", k=rnd.randint(1, 40))).encode() for _ in range(500)]
    assert replay.in_rounds(words) == replay.by_heap(words)


def test_unknown_id_fails():
    with pytest.raises(ValueError):
        bpe.codec().decode(np.array([50_256]))
