"""Predictors (G1-G3): keyword rules, multinomial naive Bayes, logistic regression,
and a pluggable Python model path.

Native predictors (keyword, naive Bayes) are joins and aggregates planned by
Catalyst. Only user-supplied Python models go through ``mapInPandas``, which ships
Arrow batches to a model loaded once per Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark.functions.decode import UNPARSEABLE
from ticketspark.functions.text import tokens
from ticketspark.operators.softmax import fit_softmax
from ticketspark.operators.vocab import MAX_CLASSES, guard_size, measure
from ticketspark.session import materialize, release, saved_paths

# ---------------------------------------------------------------- keyword rules

# Fixed value: characters trimmed from both ends of a token before keyword lookup.
TOKEN_PUNCT = ".,;:!?\"'()[]{}"


def keyword_rules(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, keyword): the zero-shot rule set -- a label's own name parts.

    An untrained model knows only the label names it is prompted with; each label is
    matched by the words of its name (``track_order`` -> ``track``, ``order``).
    """
    return labels.select(F.col(label_col).alias("label")).distinct().select(
        "label", F.explode(F.split(F.lower("label"), "_")).alias("keyword")
    ).where(F.col("keyword") != "").distinct()


def _carry(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None) -> list[str]:
    if carry is not None:
        return list(carry)
    return [c for c in df.columns if c not in (id_col, text_col)]


# Rules up to which every row looks its tokens up in one inlined map.
INLINE_RULES = 2_000


def keyword_tokens(text: Column) -> Column:
    return F.filter(F.transform(tokens(text), lambda t: F.btrim(t, F.lit(TOKEN_PUNCT))), lambda t: t != "")


def predict_keyword(df: DataFrame, rules: DataFrame, id_col: str = "ticket_id",
                    text_col: str = "instruction", out_col: str = "predicted_intent",
                    carry: list[str] | None = None, inline_rules: int = INLINE_RULES) -> DataFrame:
    """(id, carry..., out_col): label with the most keyword hits among the text's
    tokens (ties: label order); ``UNPARSEABLE`` when nothing hits.

    Every input row gives one row, equal ids included. Rules within ``inline_rules``
    (counted) are one map that each row looks up: no join and no shuffle, also in a
    stream. More rules are joined by token, and rows are put together again by a number
    of their own; the input is read once either way.
    """
    keep = _carry(df, id_col, text_col, carry)
    by_word = rules.groupBy("keyword").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    if rules.limit(inline_rules + 1).count() <= inline_rules:
        table = by_word.select(F.map_from_entries(F.collect_list(F.struct("keyword", "labels"))).alias("m")).scalar()
        hits = F.flatten(F.filter(F.transform(keyword_tokens(F.col(text_col)), lambda t: F.try_element_at(
            F.col("_rules"), t)), lambda x: x.isNotNull()))
        best = F.array_min(F.transform(F.array_distinct("_hits"), lambda label: F.named_struct(
            F.lit("n"), -F.size(F.filter("_hits", lambda x: x == label)), F.lit("label"), label)))
        # a subquery may not stand inside a lambda: it is a column first
        found = df.withColumn("_rules", table).select(
            F.col(id_col), *keep, F.coalesce(hits, F.array().cast("array<string>")).alias("_hits"))
        return found.select(F.col(id_col), *keep, F.coalesce(
            best["label"], F.lit(UNPARSEABLE)).alias(out_col))
    occ = df.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", F.col(id_col).alias("_id"), *keep, F.explode_outer(keyword_tokens(F.col(text_col))).alias("keyword"))
    hit = occ.join(rules, "keyword", "left").groupBy("_row", "_id", *keep, "label").agg(
        F.count("label").alias("n"))
    best = hit.groupBy("_row", "_id", *keep).agg(F.min(F.when(F.col("label").isNotNull(), F.struct(
        (-F.col("n")).alias("n"), "label"))).alias("b"))
    return best.select(F.col("_id").alias(id_col), *keep, F.coalesce("b.label", F.lit(UNPARSEABLE)).alias(out_col))


# ------------------------------------------------------------ naive Bayes

@dataclass
class NaiveBayesModel:
    """Sparse multinomial naive Bayes as two tables.

    ``weights`` (token, class, w, first) -- the only part that grows with the data;
    ``first`` is 1 on exactly one row per token, so summing it over a document's
    matches counts its in-vocabulary tokens -- and ``classes`` (class, prior, dflt),
    one row per class, where

    log P(t|c) = log(cnt_ct + a) - log(T_c + a|V|) = w_ct + dflt_c,
    w_ct = log(cnt_ct + a) - log(a), non-zero only for tokens seen with class c.
    """
    weights: DataFrame
    classes: DataFrame
    alpha: float = 1.0
    # optional split of ``weights`` by token frequency (see ``fit_and_save_naive_bayes``)
    hot_tokens: DataFrame | None = None
    hot_weights: DataFrame | None = None
    cold_weights: DataFrame | None = None


# Broadcast budget for the weights of frequent tokens: rows of (token, class, w, first) and
# their bytes. In memory a broadcast table takes some 130 bytes a row.
HOT_ROWS_BUDGET, HOT_BYTES_BUDGET = 500_000, 32 << 20


def hot_from(weights: DataFrame, budget_rows: int = HOT_ROWS_BUDGET) -> Column:
    """The smallest frequency ``tf`` from which on all weight rows fit ``budget_rows`` (null
    if none does), a scalar subquery.

    Exact, and without sorting the vocabulary: a histogram of total token counts (at
    most sqrt(2 * total tokens) distinct values) is summed from the top.
    """
    hist = weights.groupBy("tf").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("cum", F.sum("rows").over(w)).where(
        F.col("cum") <= F.lit(budget_rows)).agg(F.min("tf")).scalar()


def token_counts(train: DataFrame, text_col: str = "instruction",
                 label_col: str = "intent") -> tuple[DataFrame, DataFrame]:
    """Sufficient statistics: (class, token, cnt), map-side combined, and (class, n_docs)."""
    docs = train.select(F.col(label_col).alias("class"), F.col(text_col).alias("_text")).where(
        F.col("class").isNotNull())
    counts = docs.select("class", F.explode(tokens(F.col("_text"))).alias("token")).groupBy(
        "class", "token").agg(F.count(F.lit(1)).alias("cnt"))
    n_docs = docs.groupBy("class").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts, n_docs


def _weights(counts: DataFrame, alpha: float) -> DataFrame:
    """(token, class, w, first, tf): ``tf`` is the token's frequency over all classes."""
    # a token has at most one row per class, so this window never holds a hot group
    token = Window.partitionBy("token")
    return counts.select(
        "token", "class", (F.log(F.col("cnt") + F.lit(alpha)) - F.log(F.lit(alpha))).alias("w"),
        (F.row_number().over(token.orderBy("class")) == 1).cast("long").alias("first"),
        F.sum("cnt").over(token).alias("tf"))


def _classes(counts: DataFrame, n_docs: DataFrame, v: Column, alpha: float) -> DataFrame:
    """(class, prior, dflt) for a vocabulary of ``v`` tokens."""
    n_tok = counts.groupBy("class").agg(F.sum("cnt").alias("n_tokens"))
    cls = n_docs.join(n_tok, "class", "left")
    tot = F.sum("n_docs").over(Window.partitionBy())
    return cls.select(
        "class",
        (F.log(F.col("n_docs")) - F.log(tot)).alias("prior"),
        (F.log(F.lit(alpha)) - F.log(F.coalesce(F.col("n_tokens"), F.lit(0)) + F.lit(alpha) * v)).alias("dflt"),
    )


def model_from_counts(counts: DataFrame, n_docs: DataFrame, alpha: float = 1.0) -> NaiveBayesModel:
    v = counts.select(F.count_distinct("token")).scalar()
    return NaiveBayesModel(_weights(counts, alpha).drop("tf"), _classes(counts, n_docs, v, alpha), alpha)


def fit_naive_bayes(train: DataFrame, text_col: str = "instruction", label_col: str = "intent",
                    alpha: float = 1.0) -> NaiveBayesModel:
    """Lazy model (every use re-tokenises the training text); see
    :func:`fit_and_save_naive_bayes` for the saved form."""
    return model_from_counts(*token_counts(train, text_col, label_col), alpha)


def fit_and_save_naive_bayes(train: DataFrame, name: str, text_col: str = "instruction",
                             label_col: str = "intent", alpha: float = 1.0,
                             budget_rows: int = HOT_ROWS_BUDGET) -> NaiveBayesModel:
    """Fit once and save the model as tables under the checkpoint folder.

    The text is tokenised once (saved counts); weights and class priors are derived
    from the saved counts and saved. The join layout is then chosen by the model's
    measured size: within ``budget_rows`` the whole weight table is broadcast at
    prediction; beyond it the weights are saved split into the frequent-token part
    (exactly ``budget_rows`` or fewer rows, broadcast) and the long tail (shuffled). The
    split is a filter on the tokens' frequencies, saved with the weights: nothing is
    shuffled or broadcast for it.
    """
    from ticketspark.session import materialize, release, saved_paths
    counts, n_docs = token_counts(train, text_col, label_col)
    counts = materialize(counts, f"{name}-counts")
    by_tf = materialize(_weights(counts, alpha), f"{name}-weights")
    weights = by_tf.drop("tf")
    # a token has one first row, so they count the vocabulary
    v = by_tf.agg(F.coalesce(F.sum("first"), F.lit(0)).alias("v")).scalar()
    classes = materialize(_classes(counts, n_docs, v, alpha), f"{name}-classes")
    rows, size = measure(weights)
    if rows <= budget_rows and size <= HOT_BYTES_BUDGET:
        return NaiveBayesModel(weights, classes, alpha, hot_weights=weights)
    # fewer rows where tokens are long, so that both budgets hold
    within = min(budget_rows, max(1, int(rows * HOT_BYTES_BUDGET / max(size, 1))))
    hot = F.coalesce(F.col("tf") >= hot_from(by_tf, within), F.lit(False))
    hot_weights = materialize(by_tf.where(hot).drop("tf"), f"{name}-hot-weights")
    cold_weights = materialize(by_tf.where(~hot).drop("tf"), f"{name}-cold-weights")
    hot_tokens = materialize(hot_weights.where("first = 1").select("token"), f"{name}-hot")
    return NaiveBayesModel(weights, classes, alpha, hot_tokens, hot_weights, cold_weights)


def predict_naive_bayes(model: NaiveBayesModel, df: DataFrame, id_col: str = "ticket_id",
                        text_col: str = "instruction", out_col: str = "predicted_intent",
                        carry: list[str] | None = None) -> DataFrame:
    """(id, carry..., out_col, confidence, margin): the winning class, its posterior
    probability and its log-score gap to the runner-up. Every input row gives one row.

    Token occurrences meet the sparse weights on ``token``: a model within the
    broadcast budget is broadcast whole; a larger one is split by token frequency
    so frequent tokens are joined map-side and only the long tail is shuffled, with
    nothing but the row's number; the numbered rows are saved first, and joined back by
    number. An unsplit lazy model is joined by Spark's size-based choice (AQE splits
    hot-token partitions). Per-(doc, class) sums are combined map-side; each document then
    holds at most one entry per class, and the K class scores are array expressions
    over the class table (a guarded scalar subquery) -- no doc x class join, and, unless
    the weights are split, no join back to the input (``carry`` columns ride along as
    group keys).
    """
    keep = _carry(df, id_col, text_col, carry)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), *keep,
                     F.col(text_col).alias("_text"))
    if model.cold_weights is not None:
        # two branches read the rows, which an input that isn't saved may number differently
        rows = materialize(rows, "nb-rows")
    split = model.hot_weights is not None and model.cold_weights is not None
    if split:
        # frequent tokens -- most occurrences, and the skewed keys -- meet a broadcast
        # of their bounded weights map-side; only long-tail occurrences are shuffled
        given, ride = rows.select("_row", "_id", *keep), []
        occ = rows.select("_row", F.explode(tokens(F.col("_text"))).alias("token"))
        hot = occ.join(F.broadcast(model.hot_weights), "token")
        cold = occ.join(F.broadcast(model.hot_tokens), "token", "left_anti").join(model.cold_weights, "token")
        hit = hot.unionByName(cold)
    else:
        ride = ["_id", *keep]
        occ = rows.select("_row", *ride, F.explode_outer(tokens(F.col("_text"))).alias("token"))
        # a whole model that fits the broadcast budget (checked when it was fitted), or a lazy one
        weights = model.weights if model.hot_weights is None else F.broadcast(model.hot_weights)
        hit = occ.join(weights, "token", "left")
    # unsplit, rows without any known token keep a row of no class
    sums = hit.groupBy("_row", *ride, "class").agg(
        F.sum(F.coalesce("w", F.lit(0.0))).alias("s"), F.sum(F.coalesce("first", F.lit(0))).alias("f"))
    per_doc = sums.groupBy("_row", *ride).agg(
        F.sum("f").cast("double").alias("_L"),
        F.map_from_entries(F.collect_list(F.when(F.col("class").isNotNull(),
                                                 F.struct("class", "s")))).alias("_sparse"),
    )
    if split:
        per_doc = given.join(per_doc, "_row", "left").withColumn("_L", F.coalesce("_L", F.lit(0.0)))
    params = model.classes.select(
        guard_size(F.array_sort(F.collect_list(F.struct("class", "prior", "dflt"))), MAX_CLASSES,
                   "class table").alias("p")).scalar()
    scores = F.transform(F.col("_p"), lambda p: p["prior"] + F.col("_L") * p["dflt"]
                         + F.coalesce(F.try_element_at(F.col("_sparse"), p["class"]), F.lit(0.0)))
    # the scalar subquery is projected first: Spark allows none inside lambdas
    s = per_doc.withColumn("_p", params).select("_id", *keep, "_p", scores.alias("_scores"))
    s = s.withColumn("_best", F.array_max("_scores")).withColumn(
        "_round", F.transform("_scores", lambda x: F.round(x, 6)))
    # rounded, so that the order in which terms were added cannot decide a near-tie
    idx = F.array_position(F.col("_round"), F.array_max("_round"))
    runner_up = F.when(F.size("_scores") > 1,
                       F.get(F.array_sort("_scores"), F.size("_scores") - 2))
    return s.select(
        F.col("_id").alias(id_col), *keep,
        F.element_at(F.col("_p"), idx.cast("int"))["class"].alias(out_col),
        (F.lit(1.0) / F.aggregate("_scores", F.lit(0.0),
                                  lambda acc, x: acc + F.exp(x - F.col("_best")))).alias("confidence"),
        (F.col("_best") - runner_up).alias("margin"),
    )


def save_naive_bayes(model: NaiveBayesModel, path: str) -> None:
    """The model's tables under ``path``, for :func:`load_naive_bayes` in any session."""
    for name, table in _nb_tables(model).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    model.weights.sparkSession.createDataFrame(
        [(model.alpha, sorted(_nb_tables(model)))], "alpha double, tables array<string>").coalesce(1).write.mode(
        "overwrite").json(f"{path}/meta")


def load_naive_bayes(spark, path: str) -> NaiveBayesModel:
    meta = spark.read.schema("alpha double, tables array<string>").json(f"{path}/meta").first()
    t = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
    weights = t["weights"]
    return NaiveBayesModel(weights, t["classes"], meta["alpha"], t.get("hot_tokens"),
                           t.get("hot_weights", weights), t.get("cold_weights"))


def _nb_tables(model: NaiveBayesModel) -> dict[str, DataFrame]:
    out = {"weights": model.weights, "classes": model.classes}
    if model.cold_weights is not None:
        out |= {"hot_tokens": model.hot_tokens, "hot_weights": model.hot_weights,
                "cold_weights": model.cold_weights}
    return out


# ------------------------------------------------------- logistic regression

def fit_logistic(train: DataFrame, text_col: str = "instruction", label_col: str = "intent",
                 num_features: int = 1 << 16, max_iter: int = 500, tol: float = 1e-6):
    """pyspark.ml pipeline: tokens -> hashed term frequencies -> IDF -> multinomial LR.

    The model's last stage is Spark ML's, its solver ``operators.softmax``, whose gradients
    and history stay on the executors. It stops at ``tol``; a run that reaches ``max_iter``
    first has not converged and fails. The model's classes x ``num_features`` coefficients are
    on the driver once, which bounds the classes (10,000 of 65,536 features take 5 GB); tokens
    that share one of the ``num_features`` hash buckets share a coefficient.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer

    indexer = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc")
    head = Pipeline(stages=[
        indexer,
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"\s+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
    ]).fit(train)
    # texts are cut into tokens once
    saved = materialize(head.transform(train).select("_label", "_tf"), "lr-tf")
    path = saved_paths()[-1]
    head = PipelineModel([*head.stages, IDF(inputCol="_tf", outputCol="_features").fit(saved)])
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter, tol=tol,
                            family="multinomial", predictionCol="_pred")
    labels = head.stages[0].labels
    if len(labels) < 2:
        # nothing to solve
        last = lr.fit(head.stages[3].transform(saved))
    else:
        n = dict(saved.groupBy("_label").agg(F.count(F.lit(1))).collect())
        weights, intercepts = fit_softmax(saved, [n[float(i)] for i in range(len(labels))],
                                          num_features, max_iter, tol)
        idf = head.stages[3].idf.toArray()[:, None]
        last = _logistic_model(lr, np.divide(weights, idf, out=np.zeros_like(weights), where=idf > 0), intercepts)
    release(train.sparkSession, [path])
    model = PipelineModel([*head.stages, last])
    return model, IndexToString(inputCol="_pred", outputCol="predicted_intent", labels=labels)


def _logistic_model(lr, weights: np.ndarray, intercepts: np.ndarray):
    """Spark ML's model of these features x classes weights, centered as its own are."""
    from pyspark import SparkContext
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import DenseMatrix, DenseVector
    sc = SparkContext._active_spark_context
    features, k = weights.shape
    # by columns, a feature's classes one after another
    matrix = DenseMatrix(k, features, (weights - weights.mean(axis=1, keepdims=True)).ravel())
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        lr.uid, _py2java(sc, matrix), _py2java(sc, DenseVector(intercepts - intercepts.mean())), k, True)
    return lr._copyValues(LogisticRegressionModel(java))


def predict_logistic(fitted, df: DataFrame, text_col: str = "instruction") -> DataFrame:
    """``df`` plus ``predicted_intent``; a null text is predicted like an empty one."""
    model, to_label = fitted
    src = model.stages[1].getInputCol()
    given = df if src == text_col else df.withColumn(src, F.col(text_col))
    given = given.fillna("", [src])
    # an indexer left over from the fit has no label column to read here
    for stage in model.stages[1:]:
        given = stage.transform(given)
    out = to_label.transform(given)
    out = out if src == text_col else out.drop(src)
    return out.drop("_label", "_tokens", "_tf", "_features", "rawPrediction", "probability", "_pred")


def save_logistic(fitted, path: str) -> None:
    fitted[0].write().overwrite().save(path)


def load_logistic(path: str):
    """What :func:`fit_logistic` returned, from :func:`save_logistic`'s folder."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import IndexToString
    model = PipelineModel.load(path)
    return model, IndexToString(inputCol="_pred", outputCol="predicted_intent", labels=model.stages[0].labels)


# --------------------------------------------------- pluggable Python model (G1)

class Predictor:
    """Protocol for Python-side models used by :func:`predict_batch`.

    ``load`` builds the model state (weights, sessions, lookup tables); it runs once
    per Python worker process for each ``cache_key``. The state lives in a
    process-wide registry (a module object in ``sys.modules``), which Spark's reused
    Python workers keep across tasks; class attributes would not do, since a class
    shipped by value has its attributes restored on every unpickle.
    ``predict`` maps a batch of texts to raw text outputs using that state.
    """

    def cache_key(self) -> tuple:
        return ()

    def load(self):  # pragma: no cover - default is stateless
        return None

    def state(self):
        import sys
        import types
        reg = sys.modules.get("_ticketspark_models")
        if reg is None:
            reg = types.ModuleType("_ticketspark_models")
            reg.models = {}
            sys.modules[reg.__name__] = reg
        key = (type(self).__qualname__, self.cache_key())
        if key not in reg.models:
            reg.models[key] = self.load()
        return reg.models[key]

    def predict(self, texts: pd.Series) -> pd.Series:
        raise NotImplementedError


class KeywordPredictor(Predictor):
    """Python twin of the keyword rules: emits the winning label name, or ``none``."""

    def __init__(self, labels: list[str]):
        self.labels = sorted(labels)

    def cache_key(self) -> tuple:
        return tuple(self.labels)

    def load(self):
        import re
        keywords: dict[str, list[str]] = {}
        for lab in self.labels:
            for part in lab.lower().split("_"):
                if part:
                    keywords.setdefault(part, []).append(lab)
        return re.compile(r"\s+", re.ASCII), keywords

    def predict(self, texts: pd.Series) -> pd.Series:
        splitter, keywords = self.state()
        out = []
        for t in texts:
            hits: dict[str, int] = {}
            if t is not None:
                for tok in splitter.split(t.lower()):
                    tok = tok.strip(TOKEN_PUNCT)
                    for lab in keywords.get(tok, ()):
                        hits[lab] = hits.get(lab, 0) + 1
            if hits:
                best = max(hits.values())
                out.append(min(l for l, h in hits.items() if h == best))
            else:
                out.append("none")
        return pd.Series(out, index=texts.index, dtype=object)


def predict_batch(df: DataFrame, predictor: Predictor, text_col: str, out_col: str = "raw_output",
                  batch_rows: int = 4096, keep: list[str] | None = None,
                  error_col: str | None = None) -> DataFrame:
    """``keep`` columns (default: all) plus the predictor's output for each row's text, run in
    Arrow batches (``mapInPandas``); the model is loaded once per Python worker process.

    Only ``keep`` and the text go to Python; name an id alone where rows are wide. With
    ``error_col``, a batch in which the predictor fails is halved until the rows it fails for
    are alone: each of them costs a logarithm of ``batch_rows`` calls, has a null output and
    the error's text there, and all others have their outputs. Without, the first failure
    fails the query. Null texts don't go to the predictor; their output is null.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in (out_col, error_col)]
    fields = [df.schema[c] for c in kept] + [T.StructField(out_col, T.StringType())]
    if error_col:
        fields.append(T.StructField(error_col, T.StringType()))
    _ship_by_value(predictor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor.state()  # load (or reuse) the model before the first batch
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start:start + batch_rows]
                texts = part["_text"]
                out, errors = answers(predictor, texts[texts.notna()], error_col is not None)
                part = part[kept].copy()
                part[out_col] = out.reindex(part.index).astype(object).where(lambda x: x.notna(), None)
                if error_col:
                    part[error_col] = errors.reindex(part.index).astype(object).where(lambda x: x.notna(), None)
                yield part

    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("_text"))
    return src.mapInPandas(run, T.StructType(fields))


def answers(predictor: Predictor, texts: pd.Series, isolate: bool) -> tuple[pd.Series, pd.Series]:
    """(outputs, errors) of a batch of texts by their index, the latter of the rows that the
    predictor fails for even alone."""
    none = pd.Series([], dtype=object, index=texts.index[:0])
    if not len(texts):
        return none, none
    try:
        out = predictor.predict(texts)
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} outputs for {len(texts)} texts")
        return pd.Series(list(out), index=texts.index, dtype=object), none
    except Exception as e:  # noqa: BLE001 - whatever a model raises is the row's result
        if not isolate:
            raise
        if len(texts) == 1:
            return none, pd.Series([f"{type(e).__name__}: {e}"], index=texts.index, dtype=object)
    half = len(texts) // 2
    parts = [answers(predictor, x, isolate) for x in (texts.iloc[:half], texts.iloc[half:])]
    return tuple(pd.concat(x) for x in zip(*parts))


def _ship_by_value(predictor: Predictor) -> None:
    """Serialise the predictor's classes with the task instead of by import path, so
    executors need have neither this package nor the caller's module installed (only what
    these import)."""
    import sys

    from pyspark import cloudpickle
    for cls in type(predictor).__mro__:
        if issubclass(cls, Predictor) and cls.__module__ != "__main__":
            cloudpickle.register_pickle_by_value(sys.modules[cls.__module__])
