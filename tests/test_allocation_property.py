"""Property: the split allocation is exact largest remainder on the test shares."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ticketspark.operators.split import allocation

SIZES = st.lists(st.integers(min_value=1, max_value=5000), min_size=1, max_size=30)


def brute(sizes, frac=0.15):
    n = sum(sizes.values())
    t = math.ceil(float(n) * frac)
    share = {g: float(c) * t / n for g, c in sizes.items()}
    floor = {g: math.floor(v) for g, v in share.items()}
    left = t - sum(floor.values())
    order = sorted(share, key=lambda g: (-(share[g] - floor[g]), g))
    return {g: floor[g] + (1 if i < left else 0) for i, g in enumerate(order)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(SIZES)
def test_allocation_matches_brute_force(spark, sizes):
    named = {f"c{i:02d}": s for i, s in enumerate(sizes)}
    df = spark.createDataFrame(list(named.items()), "g string, n_rows long")
    got = {r.g: (r.n_test, r.n_train) for r in allocation(df).collect()}
    exp = brute(named)
    assert {g: v[0] for g, v in got.items()} == exp
    assert all(v[0] + v[1] == named[g] for g, v in got.items())
    n = sum(sizes)
    assert sum(v[0] for v in got.values()) == math.ceil(n * 0.15)
    assert all(abs(v[0] - named[g] * math.ceil(n * 0.15) / n) < 1 for g, v in got.items())
