"""Grouping by whole texts through digests (D2-D4, E6): exact, and without texts in shuffles."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ticketspark.operators import dedup, split, textkeys
from ticketspark.sources import fixtures as fx

ROWS = [(i, t, l, s) for i, (t, l, s) in enumerate(
    [("a", "x", "p"), ("a", "y", "p"), ("b", "x", "p"), ("", "x", "p"), ("", "x", "q"), (None, "x", "p"),
     (None, "z", "p"), ("A", "x", "p"), ("a ", "x", "q"), ("long " * 5000, "x", "p"), ("long " * 5000, None, "p")]
    + [(f"t{i % 40}", "xyz"[i % 3], "pq"[i % 2]) for i in range(200)] + [("a", "x", "p")] * 100)]


@pytest.fixture(params=["whole", "one digit", "constant"])
def digests(request, monkeypatch):
    """The digest as it is, and digests in which different texts meet."""
    narrow = {"one digit": lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2)),
              "constant": lambda c: F.when(c.isNotNull(), F.unhex(F.lit("00")))}
    if request.param in narrow:
        groups = textkeys.text_groups

        def forced(df, text_col, by=None):
            return groups(df, text_col, by, digest=narrow[request.param])
        monkeypatch.setattr(dedup, "text_groups", forced)
        monkeypatch.setattr(split, "text_groups", forced)
    return request.param


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "ticket_id long, instruction string, intent string, category string").repartition(5)


def test_audits_are_exact_even_if_digests_collide(spark, rows, digests):
    count = Counter(r[1] for r in ROWS)
    assert tuple(dedup.dedup_report(rows).first()) == (len(ROWS), len(count), len(ROWS) - len(count))
    sizes = Counter(n for n in count.values() if n > 1)
    assert sorted(map(tuple, dedup.duplicate_groups(rows).collect())) == sorted((n, k, (n - 1) * k) for n, k in sizes.items())
    want = []
    for key, at in (("intent", 2), ("category", 3)):
        by = defaultdict(Counter)
        for r in ROWS:
            by[r[1]][r[at]] += 1
        want += [(key, None if t is None else hashlib.md5(t.encode()).hexdigest(), sum(c.values()), len(c), ",".join(sorted(x for x in c if x is not None)))
                 for t, c in by.items() if len(c) > 1]
    got = dedup.label_conflicts(rows, label_cols=["intent", "category"]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_leakage_is_exact_even_if_digests_collide(spark, rows, digests):
    train, test = rows.where("ticket_id % 4 != 0"), rows.where("ticket_id % 4 = 0")
    texts = {r[1] for r in ROWS if r[0] % 4}
    held = [r for r in ROWS if r[0] % 4 == 0]
    n = sum(r[1] in texts for r in held)
    assert tuple(split.leakage(train, test).first()) == (len(held), n, round(n / len(held), 6))
    assert tuple(split.leakage(train, test.limit(0)).first()) == (0, 0, 0.0)


def test_empty_table(spark, rows, digests):
    none = rows.limit(0)
    assert dedup.duplicate_groups(none).collect() == [] == dedup.label_conflicts(none).collect()


def test_no_exchange_holds_a_text(spark, monkeypatch):
    t = fx.tickets(spark, SF01)
    plans = []
    real = textkeys.materialize

    def watched(df, name, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, *a)
    monkeypatch.setattr(textkeys, "materialize", watched)
    out = [dedup.dedup_report(t), dedup.duplicate_groups(t), dedup.label_conflicts(t, label_cols=["intent", "category"]),
           split.leakage(t.where("ticket_id % 7 != 0"), t.where("ticket_id % 7 = 0"))]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in out]
    seen = 0
    for p in plans:
        for line in p.splitlines():
            if "Exchange" in line or "keys=[" in line:
                seen += 1
                assert "instruction" not in line and "_t#" not in line and " text#" not in line, line
    assert seen >= 8
    # texts are hashed where they are scanned, once each for all audits
    assert all(p.count("Scan parquet") <= 2 for p in plans)
