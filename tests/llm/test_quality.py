import re
from collections import Counter

from conftest import SF001
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import quality as Q
from ticketspark.llm.queries import queries


def plain(text):
    """Measures by definition, with tuples instead of hashes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = sum(map(len, words))

    def inside(n):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        return {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]] if len(lines) < 5000 else []
    repeat = len(inside(3))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    shares = [sum(len(words[i]) for i in inside(n)) / max(chars, 1) for n, _ in Q.Limits().ngram_chars]
    size = [len(x.encode()) for x in lines]
    line_share = sum(len(x.encode()) for x in dup) / max(sum(size), 1)
    good = all(s <= m for s, (_, m) in zip(shares, Q.Limits().ngram_chars)) and line_share <= 0.3
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(dup), repeat, failed,
            good and not failed, max(shares), line_share)


NAMES = [f.name for f in Q.FIELDS]


def test_query_matches_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries()["op4_quality"](spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r[n] for n in NAMES) == plain(docs[r.doc_id])
    assert {r.kept for r in got} == {True, False}


def test_edge_rows(spark):
    got = Q.quality(edge_docs(spark))
    assert len(set(map(str.lower, got.columns))) == len(got.columns)
    out = got.collect()
    assert len(out) == len(rows())
    for r in out:
        assert tuple(r[n] for n in NAMES) == plain(r.text)
    assert Q.quality(empty_docs(spark)).count() == 0


def test_only_repetition_beyond_the_limits_rejects():
    fresh = " ".join(f"w{i}" for i in range(300))
    part = " ".join(f"p{i}" for i in range(60))
    verdict = Q._measure(Q.Limits())([x.encode() for x in (
        fresh, f"{fresh} {part} {part}", f"{part} {part} w1 w2 w3", "\n".join(["w1 w2"] * 3 + [fresh]))])[6]
    assert list(verdict) == [True, True, False, True]
