import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from edge import edge_docs, empty_docs, rows
from ticketspark.llm import divergence as D


def plain(docs, min_docs, top):
    """The result's rows from (text, lang, source), every term of every source compared."""
    df, n, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        df[lang].update(set(words))
        n[lang, source].update(words)
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        terms = [t for t, k in df[lang].items() if k >= min_docs]

        def shares(by):
            total = sum(by[t] for t in terms)
            return {t: 1 + 10**9 * (by[t] + 5) // (total + 5 * len(terms)) for t in terms}
        q = shares(sum((n[lang, s] for s in own), Counter()))
        p = {s: shares(n[lang, s]) for s in own}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o) for o in own if o != s]
            most = [(q[t] - p[s][t], t) for t in terms if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, k in (("pair", pairs, len(pairs)), ("term", most, top)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, r + 1) for r, (v, item) in enumerate(items[:k])]
    return sorted(out)


def random_docs(seed, n=400):
    r = random.Random(seed)
    words = ["Straße", "alpha", "Beta", "GAMMA", "delta", "é", "漢字", "x-y", "a1b"] + [f"w{chr(97 + k)}" for k in range(26)]
    out = []
    for _ in range(n):
        lang, source = r.choice(["en", "de", None, "zz"]), r.choice(["s0"] * 4 + ["s1", "s2", None, "", "S2"])
        text = " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=r.randint(0, 30)))
        out.append((text if r.random() > 0.05 else None, lang, source))
    return out + [("only here", "en", "lone"), (None, "one", "x"), ("", "two", "a"), (None, "two", "b")]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, source string, item string, rank int")


def test_equals_plain_version_however_often_tasks_spill(spark):
    docs = random_docs(1)
    want = plain(docs, 5, 4)
    assert {"pair", "term"} == {r[2] for r in want}
    for cells in (1, 40, D.CELLS):
        got = D.divergence(frame(spark, docs).repartition(5), min_docs=5, top=4, cells=cells)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == want


def test_a_language_without_kept_terms_has_its_pairs(spark):
    got = D.divergence(frame(spark, random_docs(2, 40)), min_docs=1000).collect()
    assert got and all(r.part == "pair" and r.value == 0 for r in got)
    assert {(r.source, r.item) for r in got if r.lang == "two"} == {("a", "b"), ("b", "a")}
    assert not [r for r in got if r.lang == "one"]


def test_edge_rows(spark):
    docs = [(r[1], r[2], r[3]) for r in rows()]
    got = D.divergence(edge_docs(spark), min_docs=2)
    assert sorted(map(tuple, got.collect())) == plain(docs, 2, 50)
    assert D.divergence(empty_docs(spark)).collect() == []


def test_large_counts_stay_exact(spark):

    n, total, terms = 9 * 10**15, 9 * 10**17, 10**9
    src = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    got = src.select(D._share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_chunks_of_pairs_add_up(spark):
    docs = frame(spark, random_docs(3))
    cells = D.merged(D.stripes(docs.na.fill(""))).select("lang", "term", F.inline("stripe"))
    cells = cells.selectExpr("lang", "term", "source", "n * 7 as p", "cast(length(source) as bigint) as none")
    want, got = (D._together(cells, k).groupBy("lang", "source", "item").sum("x").collect() for k in (1 << 21, 3))
    assert sorted(want) == sorted(got) and want
