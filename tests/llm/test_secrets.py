import hashlib
import re

from conftest import SF001
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import secrets as S
from ticketspark.llm.queries import queries

ASSIGN = r"""(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    out.sort()
    joined = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in out)
    return [sum(x[1] == k for x in out) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest()


def check(got):
    for r in got:
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == plain(r.text)
        base = [f"{x.kind}:{x.start}:{x.end}" for x in r.found if x.kind != "generic"]
        assert len(base) == r.n_assign + r.n_access + r.n_hex
        assert r.spans == ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.found)


def test_query_matches_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries()["op10_secrets"](spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == plain(docs[r.doc_id])
    assert any(r.spans for r in got)


def test_edge_rows(spark):
    got = S.secrets(edge_docs(spark)).collect()
    assert len(got) == len(rows())
    check(got)
    assert S.secrets(empty_docs(spark)).count() == 0


def test_odd_texts(spark):
    texts = ["password=secret:abcdefghijkl", "PASSWORD : 'abcdefghijkl'", "api_key=\"abcdefghijklm\" apikey=a.b",
             "paſſword=abcdefghijklm toKen=abcdefghijklm", "AKIAAKIAAKIAAKIA AKIAAKIAAKIAAKIA12", "🙂 token: 0123456789abcdef0",
             "f" * 15, "f" * 16 + "g" + "0" * 16, "token token token = " + "a" * 12, "secret=" + "x" * 11]
    check(S.secrets(spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)],
                                          "doc_id long, text string, source string")).collect())


def test_ownership_separates_examples_from_live_values(spark):
    example, live = "Zx9Kq2Lm8Np4Rt6Vw1Yb3", "Qa7Ws3Ed5Rf9Tg1Yh8Uj2"
    data = [(i, f"token = {example} and {example}", f"owner{i}") for i in range(5)]
    data += [(10 + i, f"password: {live} {'Bc4Df6Gh8Jk1Lm3Np5Qr7'} end", "one") for i in range(4)]
    data += [(20, "secret = zzzzzzzzzzzzzzzz", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in S.secrets(df).collect()}
    assert [(x.kind, x.owners, x.repos, x.verdict) for x in got[0].found] == [("assign", 5, 5, "example")]
    assert [(x.kind, x.owners, x.repos, x.verdict) for x in got[10].found] == [
        ("assign", 1, 4, "live"), ("generic", 1, 4, "live")]
    assert [x.verdict for x in got[20].found] == ["weak"]
    assert (got[0].n_live, got[0].n_example, got[10].n_live) == (0, 1, 2)
    text = {r.doc_id: r.text for r in S.redact(S.secrets(df)).collect()}
    assert example in text[0] and text[10] == "<assign> <generic> end" and text[20] == "<assign>"


def test_verdicts_follow_repositories_and_the_number_of_owners(spark):
    placeholder, leaked, example = "Zx9Kq2Lm8Np4Rt6Vw1Yb3", "Qa7Ws3Ed5Rf9Tg1Yh8Uj2", "Bc4Df6Gh8Jk1Lm3Np5Qr7"
    # boilerplate of one owner; a key that three owners hold, of twenty; an example of eight
    data = [(i, f"password: {placeholder}", "one") for i in range(300)]
    data += [(1000 + i, f"token = {leaked}", f"owner{i}") for i in range(3)]
    data += [(2000 + i, f"secret: {example}", f"owner{i}") for i in range(8)]
    data += [(3000 + i, "nothing here", f"owner{i}") for i in range(19)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: r.found for r in S.secrets(df).collect()}
    assert {(x.owners, x.repos, x.verdict) for i in range(300) for x in got[i]} == {(1, 300, "example")}
    assert {(x.owners, x.repos, x.verdict) for i in range(3) for x in got[1000 + i]} == {(3, 3, "live")}
    assert {(x.owners, x.verdict) for i in range(8) for x in got[2000 + i]} == {(8, "example")}
    assert [S.example_owners(n) for n in (0, 1, 3, 4, 20, 1_000_000)] == [3, 3, 3, 3, 6, 21]
    text = {r.doc_id: r.text for r in S.redact(S.secrets(df)).collect()}
    assert text[1000] == "<assign>" and placeholder in text[0] and example in text[2000]
    # the same three owners are all there are: then the value is everywhere
    few = {r.doc_id: r.found for r in S.secrets(df.where("doc_id between 1000 and 1999")).collect()}
    assert {x.verdict for f in few.values() for x in f} == {"example"}
