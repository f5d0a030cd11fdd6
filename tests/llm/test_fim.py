import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001, SF01
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import fim
from ticketspark.llm.queries import queries


def plain(doc_id, text, plain_from=90, spm_below=20):
    """(n, form, prefix_chars, middle_chars, output) by slicing strings."""
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_below:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), max_size=6))
def test_units_against_strings(texts):
    data = "".join(texts).encode()
    units = fim.Units(np.frombuffer(data, np.uint8))
    chars = "".join(texts)
    ends = [len(chars[:k].encode()) for k in range(len(chars) + 1)]
    assert units.select(np.arange(len(chars) + 1)).tolist() == ends
    assert units.rank(np.arange(len(data) + 1)).tolist() == [
        sum(0 < e <= at for e in ends) for at in range(len(data) + 1)]


def test_query_matches_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = queries()["op13_fim"](spark, SF01).collect()
    assert len(got) == len(docs) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        n, form, prefix, middle, output = plain(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_edge_rows(spark):
    src = edge_docs(spark)
    got = fim.fill_in_middle(src, plain_from=100, spm_below=50)
    assert {"N_Words", "spans", "Kept"} <= set(got.columns) and "_text" not in got.columns
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(r[0]), r[1] or "", *map(str, plain(r[0], r[1], 100, 50))) for r in rows())
    assert sorted((str(r.doc_id), r.back, *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)))
                  for r in got) == want
    assert fim.fill_in_middle(empty_docs(spark)).collect() == []


@pytest.mark.parametrize("text", ["<P>", "a<S>b", "x<M>", "<", "<P", "<S<M", "P><S", "🙂" * 9, "é\n漢", ">S<", "<<<>>>"])
def test_marks_and_parts_of_marks(spark, text):
    src = spark.createDataFrame([(i, text, "x", "y") for i in range(60)], "doc_id int, text string, N string, Output string")
    got = fim.fill_in_middle(src)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, text)
        assert r.back == text


def test_result_does_not_depend_on_partitions(spark):
    src = spark.read.parquet(f"{SF001}/documents.parquet")
    one, many = (sorted(fim.fill_in_middle(src.repartition(k), keep=["doc_id"]).collect()) for k in (1, 7))
    assert one == many
