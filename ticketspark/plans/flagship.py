"""Flagship query: how well is each class recognised on held-out, leak-free text?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketspark.operators import metrics as M
from ticketspark.operators import predict as P
from ticketspark.plans import shared as SH


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = SH.side(SH.split_dedup(spark, sf_dir), "test").select("ticket_id", "intent", "instruction")
    pred = P.predict_naive_bayes(SH.nb_model(spark, sf_dir), test, carry=["intent"])
    return M.classification_report(M.outcomes(pred, arm=None))
