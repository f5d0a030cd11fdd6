import random
import re

from conftest import SF001
from edge import edge_docs, empty_docs, rows
from ticketspark.llm import licenses as L
from ticketspark.llm.queries import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    start = [i for i, _ in places]
    return (len(words), len(places), min(start, default=None), max(start, default=None),
            ",".join(sorted({x for _, x in places})))


def check(r, text):
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text)
    assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_query_matches_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries()["op5_licenses"](spark, SF001).collect()
    assert len(got) == len(docs) and any(r.labels for r in got)
    for r in got:
        check(r, docs[r.doc_id])


def test_edge_rows(spark):
    got = L.licenses(edge_docs(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        check(r, r.text)
    assert L.licenses(empty_docs(spark)).count() == 0


def run(spark, texts):
    return sorted(L.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def test_templates(spark):
    texts = [notice for _, notice, _ in L.TEMPLATES] + [
        "x y " + notice.upper().replace(" ", ", ") + " z" for _, notice, _ in L.TEMPLATES] + [
        "the mit people have a license", "license mit " * 300, "cc by cc by", "by cc all rights all rights reserved",
        "general public general public license", "The GNU General Public License v3", "İ ALL RIGHTS RESERVED K",
        "permission granted to a person to copy software"]
    got = run(spark, texts)
    for r in got:
        check(r, r.text)
    n = len(L.TEMPLATES)
    for k in (0, n):
        for r, (label, notice, _) in zip(got[k:], L.TEMPLATES):
            assert label in r.labels.split(",") and r.score == 1.0, notice
            starts = [x.start for x in r.found if x.label == label and x.share == 1.0]
            assert starts and (2 if k else 0) <= starts[0] < (2 if k else 0) + len(notice.split())
    assert [r.labels for r in got[2 * n:2 * n + 5]] == ["", "", "cc-by", "reserved", "gpl"]
    assert got[2 * n + 5].labels == "gpl" and got[2 * n + 5].score == 0.5 and got[-1].labels == ""


def test_words_of_a_notice_without_the_notice(spark):
    """Holes in a key phrase, and key phrases alone, are no licence."""
    texts = ["please cc to nc office", "licensed under cc to nc 4.0", "software of great purpose", "cc0 7 7 universal",
             "dedicated to the public domain under cc0 7 7 universal", "a person obtaining one copy",
             "permission is hereby granted free of charge to any person obtaining one copy of this software",
             "permission to use copy modify and or distribute this software of great purpose with or without fee",
             "the mit license is not used here", "redistribution and use in source nor binary forms with or without modification",
             " y ".join(key for *_, key in L.TEMPLATES if not any(b in key for b in L.BASE))]
    got = run(spark, texts + ["something else"] * 30)
    assert [r.labels for r in got] == [""] * len(got)
    assert all(r.found == [] and r.score == 0.0 for r in got)


def test_all_notices_of_one_text_are_found(spark):
    notices = [notice for _, notice, _ in L.TEMPLATES]
    texts = ["\n\n".join(notices), " x ".join(reversed(notices)) + " fee charge hereby " * 40,
             # rare words of all templates stand together at the end
             " y ".join(notices) + " z " + " z ".join(sorted(set(" ".join(notices).split())))]
    texts += ["released under the mit license"] * 30  # makes the words of some notices common
    got = run(spark, texts)
    labels = sorted({label for label, *_ in L.TEMPLATES})
    for r in got[:3]:
        check(r, r.text)
        assert [x.label for x in r.found] == labels and set(labels) <= set(r.labels.split(","))
        assert r.score == 1.0 and all(x.share == 1.0 for x in r.found)
        words = re.findall(r"\w+", r.text)
        for x in r.found:
            at = [notice.split() for label, notice, _ in L.TEMPLATES if label == x.label]
            assert any(words[x.start:x.start + len(n)] == n for n in at)
    assert {r.labels for r in got[3:]} == {"mit"}


def test_changed_notices_equal_a_plain_search(spark):
    """Notices with words taken out or changed are found exactly where enough weight and
    the whole key phrase are left, however rare the words that are missing."""
    rnd = random.Random(4)
    texts = []
    for i in range(400):
        out = []
        for _, notice, _ in rnd.sample(L.TEMPLATES, 3):
            words = notice.split()
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 8])):
                words[rnd.randrange(len(words))] = rnd.choice(["thing", "license", "software", "of"])
            out += [*words, *rnd.choices(["filler", "the", "copy", "use"], k=rnd.randint(0, 4))]
        texts.append(" ".join(out[rnd.choice([0, 0, 3]):]))
    split_ = [t.split() for t in texts]
    vocab = L.vocabulary()
    weights = {w: L.weight(sum(w in t for t in map(set, split_)), len(texts)) for w in vocab}
    some = 0
    for r, words in zip(run(spark, texts), split_):
        want = {}
        for t, (label, notice, key) in enumerate(L.TEMPLATES):
            n, k, skip = notice.split(), key.split(), L._key_start(notice, key)
            for p in range(len(words)):
                if words[p:p + len(k)] == k:
                    at = p - skip
                    own = [(weights[w], 0 <= at + q < len(words) and words[at + q] == w) for q, w in enumerate(n) if w in weights]
                    share = sum(w for w, ok in own if ok) / sum(w for w, _ in own)
                    if share >= L.MIN_SHARE:
                        want[label] = max(want.get(label, (0, 0)), (share, -at))
        assert [(x.label, x.share, x.start) for x in r.found] == sorted((l, s, max(-a, 0)) for l, (s, a) in want.items())
        some += len(want)
    assert 200 < some < 1200
