"""Every stage of the pipeline against a plain version of it."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as C
from conftest import SF001
from edge import edge_docs
import test_mixing
import test_quality
import test_simhash
from ticketspark.llm import bpe


def stages(spark, docs, folder):
    out = []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF001).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def check(docs, kept, single, masked, mixed, ids):
    docs, kept, single, masked, mixed, ids = (
        sorted(d.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)) for d in (docs, kept, single, masked, mixed, ids))
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(
        (r.doc_id, r.text) for r in docs if test_quality.plain(r.text)[6])
    label = test_simhash.classes([test_simhash.fingerprint(r.text) for r in kept])
    first = {}
    for x, r in zip(label, kept):
        first.setdefault(x, r.doc_id)
    assert sorted(r.doc_id for r in single) == sorted(first.values())
    assert [r.doc_id for r in masked] == [r.doc_id for r in single]
    for a, b in zip(single, masked):
        assert a.text == b.text and a.n_chars == b.n_chars or "<" in b.text and b.n_chars == len(b.text)
    size, taken, n = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in mixed)
    for r in masked:
        size[r.source] += len(r.text.split())
        taken[r.source] += len(r.text.split()) * n[r.doc_id]
    for s, t in test_mixing.targets(size).items():
        assert abs(taken[s] - t) <= 0.5 * max(len(r.text.split()) for r in masked if r.source == s) + 1
    assert not n or max(n.values()) <= 2
    assert [r.doc_id for r in ids] == [r.doc_id for r in mixed]
    text = {r.doc_id: r.text for r in mixed}
    for r in ids:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(bpe.codec().encode([text[r.doc_id]])[0])


def test_stages_match_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = stages(spark, docs, tmp_path)
    assert all(d.columns == C.COLUMNS for d in out[:-1])
    check(docs, *out)


def test_planted_copies_and_secrets(spark, tmp_path):
    base = [" ".join(f"w{(i * 7919 + k * 104729) % 9973}" for k in range(200)) for i in range(6)]
    data = [(10 * i + j, t, "en", f"s{j % 3}", len(t)) for i, t in enumerate(base) for j in range(4)]
    secret = base[0] + " password = hunter2hunter2x9Q end " + " ".join(f"v{k}" for k in range(300))
    data += [(500, secret, "en", "s9", len(secret)), (501, None, "en", "s9", None), (502, "", None, None, 0)]
    docs = spark.createDataFrame(data, docs_schema := "doc_id long, text string, lang string, source string, n_chars long")
    out = stages(spark, docs, tmp_path)
    check(docs, *out)
    assert sorted(r.doc_id for r in out[1].collect()) == [0, 10, 20, 30, 40, 50, 500]
    assert "hunter2" not in next(r.text for r in out[2].collect() if r.doc_id == 500)


def test_edge_rows_and_empty_table(spark, tmp_path):
    # rows that stay, beside nulls, empty and long texts, repeated rows and null ids that go
    good = [(900 + i, " ".join(f"w{(i * 7919 + k * 104729) % 9973}" for k in range(120)), None, [None, "s1", ""][i], None)
            for i in range(3)]
    docs = edge_docs(spark).select(*C.COLUMNS).unionByName(spark.createDataFrame(
        good, "doc_id long, text string, lang string, source string, n_chars long"))
    out = stages(spark, docs, tmp_path)
    check(docs, *out)
    assert [r.doc_id for r in sorted(out[2].collect())] == [900, 901, 902]
    for name, stage in C.STAGES:
        assert stage(spark, out[0].limit(0), SF001).count() == 0


def test_run_leaves_its_last_tables_only(spark):
    from ticketspark.session import saved_paths
    had = len(saved_paths())
    got = C.run(spark, SF001)
    names = [p.rsplit("/", 1)[1] for p in saved_paths()[had:]]
    assert [n.rsplit("-", 1)[0] for n in names] == ["source_mix"]
    assert got.count() > 0
