import hashlib
import math
import random
import re

from conftest import SF001
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import pii as P
from ticketspark.llm.queries import queries

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def valid(kind, value):
    d = [int(c) for c in re.sub("[^0-9]", "", value)]
    luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0
    return [True, kind == 1 and all(int(p) <= 255 for p in value.split(".")),
            12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15][kind]


def plain(text):
    spans = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "")
                   if valid(k, m[0]))
    joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return [sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest()


def check(r, text):
    assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == plain(text)


def test_query_matches_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries()["op7_pii"](spark, SF001).collect()
    assert len(got) == len(docs) and any(r.spans for r in got)
    for r in got:
        check(r, docs[r.doc_id])


def test_edge_rows(spark):
    got = P.pii(edge_docs(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        check(r, r.text)
    assert P.pii(empty_docs(spark)).count() == 0


def test_odd_texts(spark):
    rnd = random.Random(3)
    pool = ["a", "b.c", "@", "@x.y", "1", "12", "4111 1111 1111 1111", "4111-1111", "+", "+49 30 1234567", "(", ")",
            " ", "-", ".", "1.2.3.4", "256.1.1.1", "001.02.3.255", "é", "🙂", "_", "\n", "a@b.co", "0" * 44 + "255"]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 25))) for _ in range(1500)]
    texts += ["1 " * 20_000, "a" * 50_000 + "@", "a@b" + ".c" * 20_000, "1." * 20_000, "1-" * 9 + "1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in P.pii(df).collect():
        check(r, r.text)


def test_terms_that_disclose_an_entity(spark):
    # five different texts show Zanzibarov beside one address, which elsewhere stand apart
    # from nothing else; "meeting" is common everywhere
    data = [f"note {i} meeting with zanzibarov <z@corp.example> about item {'abcdefg'[i]}" for i in range(5)]
    data += [f"meeting number {i} about nothing in particular, item {'abcdefghijklmnop'[i % 16]}" for i in range(200)]
    data += ["copied quuxfrob u@copy.example"] * 8  # copies prove nothing
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.pii(df).collect()}
    for i in range(5):
        a = data[i].index("zanzibarov")
        assert f"term:{a}:{a + 10}" in got[i].spans.split(",") and got[i].n_email == 1
        assert f"term:{data[i].index('meeting')}" not in got[i].spans
    assert all(got[i].spans == "" for i in range(5, 205))
    assert all(got[i].n_term == 0 for i in range(205, 213))
    clean = {r.doc_id: r.text for r in P.sanitise(P.pii(df)).collect()}
    assert "zanzibarov" not in clean[0] and "<email>" in clean[0] and "meeting" in clean[0]
    assert clean[100] == data[100]


def test_long_digit_parts_are_numbers(spark):
    df = spark.createDataFrame([(1, "1.2.3." + "0" * 60 + "9"), (2, "1.2.3." + "9" * 60)], "doc_id long, text string")
    assert [r.n_ip for r in sorted(P.pii(df).collect())] == [1, 0]


def test_terms_are_told_and_marked_in_the_whole_text(spark):
    far = "plain filler words without any meaning here, " * 5
    # the name stands far from the address and again later; the employer only beyond a
    # second address; a name that one of the texts lacks the address for stays there
    data = [f"zanzibarov wrote. {far}{'abcdefg'[i]} z@corp.example other{i}@corp.example, quuxfrob ltd. {far}"
            f"Yours, Zanzibarov" for i in range(5)]
    data += [f"{far}number {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.pii(df).collect()}
    for i in range(5):
        spans = got[i].spans.split(",")
        for m in re.finditer("zanzibarov|quuxfrob", data[i], re.I):
            assert f"term:{m.start()}:{m.end()}" in spans
        assert f"term:{data[i].index('filler')}:" not in got[i].spans
        assert len(set(spans)) == len(spans)
    assert all(got[i].spans == "" for i in range(5, 405))
    clean = {r.doc_id: r.text.lower() for r in P.sanitise(P.pii(df)).collect()}
    assert not any("zanzibarov" in clean[i] or "quuxfrob" in clean[i] for i in range(5))
    assert all("filler" in clean[i] for i in range(405)) and clean[9] == data[9]


def test_shares_are_those_of_documents(spark):
    rnd = random.Random(8)
    entity = [f"p{i}@corp.example" for i in range(4)]
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "klmno"]
    data = []
    for i in range(300):
        parts = rnd.choices(words, k=8) + (rnd.sample(entity, rnd.randint(1, 2)) if i % 10 == 0 else [])
        parts += [f"tell{'abcd'[int(e[1])]}tale" for e in entity if e in parts] * rnd.randint(0, 3)
        rnd.shuffle(parts)
        data.append(" ; ".join(parts))
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    held = [({e for e in entity if e in t}, set(re.findall(r"[^\W\d_]{3,}", t))) for t in data]
    told = set()
    for e in entity:
        n_e = sum(e in x for x, _ in held)
        for w in set().union(*(x for _, x in held)):
            pair = {t for t, (x, y) in zip(data, held) if e in x and w in y}
            n_t = sum(w in y for _, y in held)
            if len(pair) >= P.SUPPORT and math.log(len(pair) * 300 / (n_t * n_e)) / math.log(300 / n_e) >= P.DISCLOSURE:
                told.add((e, w))
    assert told
    for r in P.pii(df).collect():
        want = sorted({(m.start(), m.end()) for e, w in told if e in r.text
                       for m in re.finditer(rf"(?<![^\W\d_]){w}(?![^\W\d_])", r.text)
                       if not any(k.start() <= m.start() < k.end() for k in re.finditer(r"\S+@\S+", r.text))})
        assert [(x.start, x.end) for x in r.found if x.kind == 4] == want


def test_long_texts_with_many_shared_addresses(spark):
    """Linear in the text: three texts of 100,000 words each, which share 1,000 addresses."""
    import time
    data = []
    for k in range(3):
        parts = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}word" for i in range(100_000)]
        for i in range(1000):
            parts[97 * i + k] = f"someone{i}@corp.example"
        parts[50_000 + k] = "zanzibarov"
        data.append(" ".join(parts))
    data += [" ".join(f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst") + f" number {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    begun = time.time()
    got = {r.doc_id: r for r in P.pii(df).collect()}
    assert time.time() - begun < 120
    for i in range(3):
        check(got[i], data[i])
        assert got[i].n_email == 1000 and got[i].n_term == 1
        at = data[i].index("zanzibarov")
        assert f"term:{at}:{at + 10}" in got[i].spans.split(",")


def test_letters_that_touch_an_entity(spark):
    # a run of letters that an entity ends in, or begins in, is no term; one beside it is
    data = [f"q{'abc'[i]} 漢字漢字a@b.example漢字漢字 nextto 1.2.3.4beside more" for i in range(3)] + ["x"] * 60
    got = {r.doc_id: r for r in P.pii(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect()}
    for i in range(3):
        check(got[i], data[i])
        terms = [data[i][x.start:x.end] for x in got[i].found if x.kind == 4]
        assert terms == ["nextto", "beside", "more"]
