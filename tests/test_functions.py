"""Column functions against plain Python (hashing and text helpers)."""

import hashlib
import re

from pyspark.sql import functions as F

from ticketspark.functions.hashing import bucket, fingerprint_term, hex_prefix, order_key
from ticketspark.functions.text import strip_ws, tokens, truncate_words, word_count

TEXTS = ["  Hello  world \n", "", "   ", "a\tb\nc", "Ünïcode ÉTÉ  x", "one", None, " x\x0by "]


def test_hashing_matches_python(spark):
    df = spark.range(0, 200).select(
        "id", order_key("id").alias("k"), bucket("A", "id").alias("b"),
        hex_prefix(order_key("id"), 4).alias("p"))
    for r in df.collect():
        h = hashlib.md5(f"42|{r.id}".encode()).hexdigest()
        assert r.k == h
        assert r.p == int(h[:4], 16)
        assert r.b == int(hashlib.md5(f"A|{r.id}".encode()).hexdigest()[0], 16)


def test_fingerprint_term(spark):
    df = spark.createDataFrame([(1, "x", "abc"), (2, None, "ticket text")], "i long, a string, t string")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for r in df.select("*", fingerprint_term([F.col("i"), F.col("a"), F.col("t")]).alias("f")).collect():
        whole = f"{r.i}|{md5(r.a) if r.a else '-'}|{md5(r.t)}"
        assert r.f == int(md5(whole)[:15], 16)


def test_text_helpers_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    rows = df.select("id", strip_ws(F.col("t")).alias("s"), tokens(F.col("t")).alias("tk"),
                     word_count(F.col("t")).alias("n"), truncate_words(F.col("t"), 2).alias("cut")
                     ).orderBy("id").collect()
    ws = re.compile(r"\s+", re.ASCII)
    for r, t in zip(rows, TEXTS):
        if t is None:
            assert r.s is None and r.n == 0
            continue
        s = t.strip(" \t\n\r\f\x0b")
        toks = [x for x in ws.split(s) if x]
        assert r.s == s
        assert r.tk == [x.lower() for x in toks]
        assert r.n == len(toks)
        assert r.cut == " ".join(toks[:2])
