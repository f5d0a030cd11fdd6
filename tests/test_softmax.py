"""The solver of ``predict.fit_logistic`` against Spark ML's own, and what it brings to the driver."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from ticketspark.operators import predict as P
from ticketspark.operators import softmax as S
from ticketspark.session import saved_paths

from conftest import ROOT
from test_logistic_table import LABELS, SCHEMA, noisy

RESULTS = """
import sys
sys.path[:0] = sys.argv[1:3]
from pyspark.sql import SparkSession
from test_logistic_table import noisy
from ticketspark.operators import predict as P
out = sys.argv[3]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{out}/kept")
         .config("spark.sql.shuffle.partitions", "2").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.dir", f"file://{out}/events").config("spark.eventLog.rolling.enabled", "false")
         .config("spark.eventLog.compress", "false").getOrCreate())
P.fit_logistic(noisy(spark))
spark.stop()
"""


def spark_ml(train, num_features):
    """The same features under Spark ML's solver: (coefficients, intercepts, steps)."""
    fitted = P.fit_logistic(train, num_features=num_features)
    given = train
    for stage in fitted[0].stages[:-1]:
        given = stage.transform(given)
    m = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=500, tol=1e-6,
                           family="multinomial").fit(given)
    return fitted, m


def same_model(train, num_features=1 << 10):
    (fitted, to_label), m = spark_ml(train, num_features)
    own = fitted.stages[-1]
    assert own.coefficientMatrix.toArray() == pytest.approx(m.coefficientMatrix.toArray(), abs=1e-3)
    assert own.interceptVector.toArray() == pytest.approx(m.interceptVector.toArray(), abs=1e-3)
    assert own.numClasses == m.numClasses and own.numFeatures == m.numFeatures


def test_equals_spark_ml(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 40)  # several chunks of rows, and blocks of features
    monkeypatch.setattr(S, "BLOCK_VALUES", 1000)
    monkeypatch.setattr(S, "SAVE_STEPS", 3)
    odd = [(1000, "", "billing"), (1001, "pay " * 50, "other"), (1002, "card card", "delivery")]
    same_model(noisy(spark).union(spark.createDataFrame(odd, SCHEMA)))


def test_words_of_all_texts_and_two_classes(spark):
    rows = [(r.ticket_id, r.instruction + " all", r.intent) for r in noisy(spark).collect() if r.intent != LABELS[2]]
    same_model(spark.createDataFrame(rows, SCHEMA).repartition(2))


def test_texts_without_words_one_class_and_no_convergence(spark):
    blank = spark.createDataFrame([(i, "", LABELS[i % 3 and 1]) for i in range(9)], SCHEMA)
    assert {r.predicted_intent for r in P.predict_logistic(P.fit_logistic(blank, num_features=16), blank).collect()} == {
        LABELS[1]}
    one = spark.createDataFrame([(1, "pay", "a"), (2, "", "a")], SCHEMA)
    assert {r.predicted_intent for r in P.predict_logistic(P.fit_logistic(one, num_features=16), one).collect()} == {"a"}
    with pytest.raises(RuntimeError, match="not converged"):
        P.fit_logistic(noisy(spark), num_features=64, max_iter=2)


def test_texts_are_cut_into_tokens_once(spark, monkeypatch):
    """The fit reads saved frequencies, no tokenizer's or hashing's functions, and removes them."""
    plans, kept = [], saved_paths()

    def fit(rows, *given):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return S.fit_softmax(rows, *given)
    monkeypatch.setattr(P, "fit_softmax", fit)
    P.fit_logistic(noisy(spark), num_features=64)
    assert len(plans) == 1 and "UDF" not in plans[0] and saved_paths() == kept


def test_chunks_hold_only_frequencies_other_than_one(spark):
    rows = spark.createDataFrame([(1.0, Vectors.sparse(300, [2, 299], [1.0, 3.0])), (0.0, Vectors.sparse(300, [], [])),
                                  (1.0, Vectors.sparse(300, [2], [2.0 ** 30]))], ["label", "tf"]).coalesce(1)
    (part, (f, lengths, odd, more, row, y)), = rows.mapInArrow(S._chunks(1, 2), "part int, chunk binary").rdd.map(
        S._loaded).collect()
    assert part == 0 and f.dtype == np.uint16 and f.tolist() == [2, 299, 2] and lengths.tolist() == [2, 0, 1]
    assert odd.tolist() == [299, 2] and more.tolist() == [2.0, 2.0 ** 30 - 1] and row.tolist() == [0, 2]
    assert y.tolist() == [1, 0, 1]


def test_gradients_stay_off_the_driver(tmp_dir):
    """Task results are the size of the coefficients and the tokens' frequencies once, not
    once for each evaluation of the loss."""
    os.makedirs(f"{tmp_dir}/events")
    subprocess.run([sys.executable, "-c", RESULTS, ROOT, f"{ROOT}/tests", tmp_dir], check=True, timeout=300,
                   env=os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT}/tests"})
    sizes = []
    for name in os.listdir(f"{tmp_dir}/events"):
        with open(f"{tmp_dir}/events/{name}") as f:
            for e in map(json.loads, f):
                if e["Event"] == "SparkListenerTaskEnd":
                    sizes.append(e["Task Metrics"]["Result Size"])
    coefficients = 8 * (1 << 16) * len(LABELS)
    assert len(sizes) > 40 and sum(sizes) < 3 * coefficients


def test_search_holds_the_wolfe_conditions():
    for f, slope in ((lambda t: (t - 3) ** 2, lambda t: 2 * (t - 3)), (lambda t: np.cosh(t - 0.2), lambda t: np.sinh(t - 0.2)),
                     (lambda t: np.inf if t > 4 else -np.log(4 - t) * -1 + t * t, lambda t: -1 / (4 - t) + 2 * t)):
        for t in (0.01, 1.0, 100.0):
            got = S.search(lambda x: (float(f(x)), float(slope(x))), float(f(0.0)), float(slope(0.0)), t)
            assert f(got) <= f(0.0) + S.DECREASE * got * slope(0.0) and abs(slope(got)) <= S.CURVATURE * abs(slope(0.0))
    with pytest.raises(S.SearchFailed):
        S.search(lambda x: (x, 1.0), 0.0, 1.0, 1.0)
