"""Language identification by interpolated Kneser-Ney character language models.

One model per language predicts each character of a word from the three before it. All
n-grams that were counted are in it. Models of few n-grams are sorted arrays of hashes
with log probabilities and back-off weights, broadcast to the tasks; larger ones are saved
tables, which the distinct n-grams of the texts are joined to. A text gets the language
whose model needs the fewest bits per character, the same on both paths.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark.llm.common import CHUNK_BYTES, distinct, field, map_text, plain, slices
from ticketspark.llm.quality import mix

ORDER = 4
# n-grams of all languages together up to which a model is gathered and broadcast (some 40
# bytes each); with more it is a set of saved tables that texts are joined to.
BROADCAST_GRAMS = 1_000_000
# Texts that hold one n-gram, beyond which its join is dealt in parts of about so many.
PART_TEXTS = 100_000
# Log probabilities are added up as whole numbers of 2^-30, so that sums don't depend on
# the order in which tasks add.
SCALE = 1 << 30
UNKNOWN = "und"
# One text of so many is left out of the models that calibrate the rejection, and the share
# of a language's left-out texts that may lie beyond its limit, as read from counts of
# excesses in cells of 1/CELLS, CELL_LIMIT at most.
FOLDS, REJECT_SHARE, CELLS, CELL_LIMIT = 10, 0.001, 100, 1_000_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as rows of ORDER code points, the word each belongs to): for each
    character of each word, and for the space that ends it, with what stands before."""
    pad = " " * (ORDER - 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer("".join([f"{pad}{w} " for w in words]).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(int(size.sum())) + word * (ORDER - 1)
    return flat[at[:, None] + np.arange(ORDER)], word


def hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for k in range(rows.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k].astype(np.uint64) + np.uint64(1))
    return h


def _summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of ``n`` over equal ones."""
    _, first, back = np.unique(hashes(rows), return_index=True, return_inverse=True)
    return rows[first], np.bincount(back, n, len(first)).astype(np.int64)


def _strings(rows: np.ndarray) -> list[str]:
    flat = np.ascontiguousarray(rows).astype("<u4").tobytes().decode("utf-32-le")
    return [flat[i:i + ORDER] for i in range(0, len(flat), ORDER)]


def left_out(text: Column) -> Column:
    """The texts that only calibrate the rejection: one of FOLDS, equal texts alike."""
    return F.pmod(F.xxhash64(F.lit("fold"), text), F.lit(FOLDS)) == 0


def gram_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, out, gram, n): how often each n-gram stands in the texts of each language, and
    apart from them in those that are left out. Each task adds up what it has seen before
    anything is shuffled."""
    text = F.col(text_col)
    src = df.where(F.col(lang_col).isNotNull() & text.isNotNull()).select(
        text.alias("_text"), F.struct(F.col(lang_col).alias("lang"), left_out(text).alias("out")).alias("_of"))

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, out), parts in held.items():
            rows, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(n)), pa.repeat(out, len(n)),
                 pa.array(_strings(rows), pa.string()),
                 pa.array(n)], names=["lang", "out", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, 0, CHUNK_BYTES):
                langs = [(x["lang"], x["out"]) for x in part.column(1).to_pylist()]
                split = [words_of(t) for t in part.column(0).to_pylist()]
                for lang in set(langs):
                    code, words = distinct(list(chain.from_iterable(
                        s for s, x in zip(split, langs) if x == lang)))
                    if len(words):
                        rows, word = grams(words)
                        rows, n = _summed(rows, np.bincount(code, minlength=len(words))[word])
                        held.setdefault(lang, []).append((rows, n))
                        size += len(n)
            if size > 2_000_000:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    out = src.mapInArrow(run, "lang string, out boolean, gram string, n long")
    return out.groupBy("lang", "out", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """One order of one language: sorted hashes, log probabilities; sorted hashes of
    contexts and their back-off weights."""
    gram: np.ndarray
    logp: np.ndarray
    context: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    langs: list[str]
    tables: list[list[Table]]  # by language, then by order from 1
    floor: list[float]         # log probability of a character never seen
    usual: list[tuple[float, float]]  # mean of -log p of a character, and limit of the excess

    def log_probs(self, rows: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last character, a column per language."""
        keys = [hashes(rows[:, ORDER - n:]) for n in range(1, ORDER + 1)]
        contexts = [hashes(rows[:, ORDER - n:-1]) for n in range(1, ORDER + 1)]
        out = np.zeros((len(rows), len(self.langs)))
        for k, tables in enumerate(self.tables):
            left = np.arange(len(rows))
            for n in range(ORDER, 0, -1):
                t = tables[n - 1]
                at, hit = _find(t.gram, keys[n - 1][left])
                out[left[hit], k] += t.logp[at[hit]]
                left = left[~hit]
                at, hit = _find(t.context, contexts[n - 1][left])
                out[left[hit], k] += t.backoff[at[hit]]
            out[left, k] += self.floor[k]
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys if len(table) else np.zeros(len(keys), bool))


def _kneser_ney(rows: np.ndarray, n: np.ndarray) -> tuple[list[Table], float, float]:
    """The tables of one language from its n-grams of the highest order and their counts, the
    log probability of an unknown character, and the mean of -log p over the n-grams.

    Lower orders count the distinct characters seen before an n-gram. From each count a
    discount goes to the context's back-off weight, which scales the order below."""
    levels = [(rows, n)]
    for _ in range(ORDER - 1):
        shorter = levels[0][0][:, 1:]
        levels.insert(0, _summed(shorter, np.ones(len(shorter))))
    tables: list[Table] = []
    floor = 0.0
    for rows, n in levels:
        h = hashes(rows)
        order = np.argsort(h)
        rows, n, h = rows[order], n[order].astype(float), h[order]
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))
        context, first, back = np.unique(hashes(rows[:, :-1]), return_index=True, return_inverse=True)
        total = np.bincount(back, n)
        follow = np.bincount(back)
        backoff = discount * follow / total
        p = (n - discount) / total[back]
        if not tables:
            floor = float(np.log(backoff[0] / (len(n) + 1)))
            p += backoff[0] / (len(n) + 1)
            backoff = np.ones(1)  # the floor has it already
        else:
            below = tables[-1]
            at, hit = _find(below.gram, hashes(rows[:, 1:]))
            p += backoff[back] * np.exp(below.logp[at])  # each shorter n-gram is there
        tables.append(Table(h, np.log(p), context, np.log(backoff)))
    bits = -tables[-1].logp
    weight = levels[-1][1][np.argsort(hashes(levels[-1][0]))]
    return tables, floor, float(np.average(bits, weights=weight))


@dataclass
class SavedModel:
    """A model of any number of n-grams: a table (lang, gram, logp) and a table (lang,
    context, backoff) of each order from 1."""
    langs: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    floor: list[float]
    usual: list[tuple[float, float]]


def _saved_kneser_ney(counts: DataFrame) -> SavedModel:
    """What :func:`_kneser_ney` computes, for all languages, by groupings and joins of
    tables. Only a few numbers a language come to the driver."""
    from ticketspark.operators.vocab import sized
    from ticketspark.session import materialize
    levels = [counts]
    for n in range(ORDER - 1, 0, -1):
        levels.insert(0, materialize(levels[0].groupBy(
            "lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "langid-level"))
    grams: list[DataFrame] = []
    contexts: list[DataFrame] = []
    floor: dict[str, float] = {}
    for order, level in enumerate(levels, 1):
        ones, twos = (F.count(F.when(F.col("n") == k, 1)) for k in (1, 2))
        discount = F.least(F.lit(0.95), F.greatest(F.lit(0.1), ones / F.greatest(ones + 2 * twos, F.lit(1))))
        per_lang = level.groupBy("lang").agg(discount.alias("d"), F.count(F.lit(1)).alias("size"))
        rows = level.withColumn("context", F.substring("gram", 1, order - 1))
        context = rows.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("follow")).join(sized(per_lang, "langid-order"), "lang")
        context = materialize(context.withColumn(
            "backoff", F.col("d") * F.col("follow") / F.col("total")), "langid-contexts")
        rows = rows.join(context, ["lang", "context"])
        p = (F.col("n") - F.col("d")) / F.col("total")
        if order == 1:
            least = F.col("backoff") / (F.col("size") + 1)
            floor = {r["lang"]: r["f"] for r in context.select("lang", F.log(least).alias("f")).collect()}
            p = p + least
            context = context.withColumn("backoff", F.lit(1.0))  # the floor has it already
        else:
            below = grams[-1].select("lang", F.col("gram").alias("_below"), F.col("logp").alias("_logp"))
            rows = rows.withColumn("_below", F.substring("gram", 2, order - 1)).join(below, ["lang", "_below"])
            p = p + F.col("backoff") * F.exp("_logp")
        grams.append(materialize(rows.select("lang", "gram", "n", F.log(p).alias("logp")), "langid-grams"))
        contexts.append(context.select("lang", "context", F.log("backoff").alias("backoff")))
    mean = {r["lang"]: r["mean"] for r in grams[-1].groupBy("lang").agg(
        (F.sum(-F.col("logp") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    langs = sorted(mean)
    return SavedModel(langs, [g.drop("n") for g in grams], contexts,
                      [floor[x] for x in langs], [(mean[x], math.inf) for x in langs])


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_grams: int | None = None,
        broadcast_grams: int = BROADCAST_GRAMS) -> Model | SavedModel:
    """Models of all languages of ``lang_col`` from all rows with text and language.

    Counting is distributed over all rows and every n-gram is kept. Up to
    ``broadcast_grams`` of them come to the driver; more stay in saved tables, with the
    same predictions. A caller who wants a small model of the most frequent n-grams only
    names ``max_grams`` (a cut on the count, found from a histogram of counts, so that
    n-grams of equal count stay or go together).

    From what excess on a text is rejected is calibrated: models of nine tenths of the texts
    judge the tenth that they haven't seen, and a language's limit is that of the excesses
    of those of its left-out texts that it recognises which ``REJECT_SHARE`` of them exceed. A
    language with too few such texts to show so small a share has the widest limit of all."""
    from ticketspark.session import materialize
    parts = materialize(gram_counts(df, text_col, lang_col), "langid-parts")
    counts = materialize(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid")
    if max_grams is not None:
        hist = counts.groupBy(F.least("n", F.lit(max_grams)).alias("n")).agg(F.count(F.lit(1)).alias("k"))
        kept, cut = 0, 1
        for row in hist.orderBy(F.desc("n")).toLocalIterator():
            kept += row["k"]
            if kept > max_grams:
                cut = row["n"] + 1
                break
        counts = counts.where(F.col("n") >= cut)
    model = _model(counts, broadcast_grams)
    known = df.where(F.col(lang_col).isNotNull() & left_out(F.col(text_col))).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    limits = _limits(known, _model(parts.where(~F.col("out")).select("lang", "gram", "n"), broadcast_grams))
    widest = max((limit for limit, _ in limits.values()), default=math.inf)
    for k, (x, (mean, _)) in enumerate(zip(model.langs, model.usual)):
        limit, texts = limits.get(x, (widest, 0))
        model.usual[k] = (mean, limit if texts * REJECT_SHARE >= 1 else widest)
    return model


def _model(counts: DataFrame, broadcast_grams: int) -> Model | SavedModel:
    """The models of all languages from (lang, gram, n), without limits."""
    if counts.count() > broadcast_grams:
        return _saved_kneser_ney(counts)
    pdf = counts.toArrow()
    langs = np.array(pdf.column("lang").to_pylist(), object)
    n = pdf.column("n").to_numpy()
    text = "".join(pdf.column("gram").to_pylist())
    rows = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    model = Model(sorted(set(langs)), [], [], [])
    for lang in model.langs:
        tables, floor, mean = _kneser_ney(rows[langs == lang], n[langs == lang])
        model.tables.append(tables)
        model.floor.append(floor)
        model.usual.append((mean, math.inf))
    return model


def _limits(known: DataFrame, model: Model | SavedModel) -> dict[str, tuple[float, int]]:
    """The limit of each language's excess from (text, lang) rows that the model hasn't seen,
    and the number of texts behind it.
    What comes to the driver are counts of cells, ``CELL_LIMIT`` a language at most."""
    seen = predict(known, model, keep=["lang"], excess=True).where(F.col("lang_pred") == F.col("lang"))
    cell = F.least(F.floor(F.greatest("excess", F.lit(0.0)) * CELLS), F.lit(CELL_LIMIT))
    found: dict[str, list] = {}
    for lang, at, n in seen.groupBy("lang", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        found.setdefault(lang, []).append((at, n))
    out = {}
    for lang, cells in found.items():
        texts = sum(n for _, n in cells)
        over, may = 0, REJECT_SHARE * texts
        for at, n in sorted(cells, reverse=True):
            over += n
            if over > may:
                out[lang] = ((at + 1) / CELLS, texts)
                break
    return out


# Characters that count as independent evidence.
EVIDENCE = 50
FIELDS = [field("lang_pred", "string"), field("score", "double"),
          field("cross_entropy", "double"), field("rejected", "boolean")]
EXCESS = field("excess", "double")


def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows, exact for whole numbers."""
    upto = np.concatenate([np.zeros((1, x.shape[1]), x.dtype), np.cumsum(x, axis=0)])
    end = np.cumsum(size)
    return upto[end] - upto[end - size]


def _judge(model: Model | SavedModel, total: np.ndarray, chars: np.ndarray, letter: list[bool]) -> list:
    """The output fields from each text's summed log probabilities by language, and the
    excess: how far its cross-entropy is above the language's mean, in units that shrink
    with the root of its length, as the spread of a mean does."""
    out = [[], [], [], [], []]
    for i, some in enumerate(letter):
        if not model.langs or not some:
            row = (UNKNOWN, 0.0, None, True, None)
        else:
            ce = -(total[i] / SCALE) / max(chars[i], 1)
            best = int(np.argmin(ce))
            m = min(chars[i], EVIDENCE)
            mean, limit = model.usual[best]
            excess = float((ce[best] - mean) * np.sqrt(m))
            score = 1 / np.exp((ce[best] - ce) * m).sum() * min(1.0, math.exp(min(1 - excess / limit, 0)))
            row = (model.langs[best], float(score), float(ce[best]), excess > limit, excess)
        for x, y in zip(out, row):
            x.append(y)
    return out


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _predict(model: Model, texts: list) -> list:
    split = [words_of(t) for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    code, words = distinct(list(chain.from_iterable(split)))
    rows, word = grams(words)
    total = np.zeros((len(texts), len(model.langs)), np.int64)
    chars = np.zeros(len(texts), np.int64)
    if len(words) and model.langs:
        _, first, back = np.unique(hashes(rows), return_index=True, return_inverse=True)
        logp = np.rint(model.log_probs(rows[first]) * SCALE).astype(np.int64)[back]
        size = np.bincount(word, minlength=len(words))
        chars = _sums(size[code][:, None], n)[:, 0]
        total = _sums(_sums(logp, size)[code], n)
    return _judge(model, total, chars, [_has_letter(t) for t in texts])


def _text_grams(texts: list) -> list:
    """Whether each text has a letter, its number of characters in words (with their ends),
    its distinct n-grams and how often each stands in it."""
    out = [[], [], [], []]
    for t in texts:
        code, words = distinct(words_of(t))
        rows, word = grams(words)
        if len(words):
            rows, n = _summed(rows, np.bincount(code, minlength=len(words))[word])
        else:
            n = np.zeros(0, np.int64)
        for x, y in zip(out, (_has_letter(t), int(n.sum()), _strings(rows), n)):
            x.append(y)
    return out


def _gram_values(asked: DataFrame, model: SavedModel) -> DataFrame:
    """(gram, values): the scaled log probability of each asked n-gram's last character by
    language, in the order of ``model.langs``. Equal shorter n-grams are looked up once; what
    is joined shares a context or an ending with as many rows as there are characters."""
    from ticketspark.operators.vocab import sized
    from ticketspark.session import materialize
    spark = asked.sparkSession
    langs = sized(spark.createDataFrame(
        [(k, x, f) for k, (x, f) in enumerate(zip(model.langs, model.floor))], "k int, lang string, floor double"), "langid-langs")
    every = F.explode(F.sequence(F.lit(0), F.lit(len(model.langs) - 1))).alias("k")
    below = None
    for n in range(1, ORDER + 1):
        need = asked.select(F.substring("gram", ORDER - n + 1, n).alias("gram")).distinct().select(
            "gram", every).join(langs, "k")
        rows = need.join(model.grams[n - 1], ["lang", "gram"], "left")
        if n == 1:
            value = F.coalesce("logp", "floor")
        else:
            rows = rows.withColumn("context", F.substring("gram", 1, n - 1)).join(
                model.contexts[n - 1], ["lang", "context"], "left")
            rows = rows.withColumn("_end", F.substring("gram", 2, n - 1)).join(
                below.select("k", F.col("gram").alias("_end"), F.col("v").alias("_v")), ["k", "_end"])
            value = F.coalesce(F.col("logp"), F.coalesce("backoff", F.lit(0.0)) + F.col("_v"))
        below = materialize(rows.select("k", "gram", value.alias("v")), "langid-values")
    scaled = F.rint(F.col("v") * F.lit(float(SCALE))).cast("long")
    return below.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", scaled.alias("v"))))["v"].alias("values"))


def _predict_joined(df: DataFrame, model: SavedModel, text_col: str, keep: list[str] | None,
                    fields: list) -> DataFrame:
    """:func:`predict` by a join of each text's distinct n-grams to the saved tables. An
    n-gram of very many texts is joined in parts, and looked up in the model once."""
    from ticketspark.operators.vocab import sized
    from ticketspark.session import materialize
    names = [f.name for f in fields]
    kept = [c for c in (plain(df).columns if keep is None else keep) if c.lower() not in names]
    held = df.select(text_col, *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(kept)])
    texts = map_text(held, text_col, [
        field("_letter", "boolean"), field("_chars", "long"), field("_grams", T.ArrayType(T.StringType())),
        field("_n", T.ArrayType(T.LongType()))], _text_grams, keep=held.columns[1:])
    texts = materialize(texts.withColumn("_row", F.monotonically_increasing_id()), "langid-texts")

    asked = materialize(texts.select(F.explode("_grams").alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("texts")), "langid-asked")
    hot = sized(asked.where(F.col("texts") > PART_TEXTS).select(
        "gram", F.ceil(F.col("texts") / PART_TEXTS).cast("int").alias("parts")), "langid-hot")
    parts = F.coalesce("parts", F.lit(1))
    values = _gram_values(asked, model).join(hot, "gram", "left").select(
        "gram", "values", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pairs = texts.select("_row", F.explode(F.arrays_zip("_grams", "_n")).alias("x")).select(
        "_row", F.col("x._grams").alias("gram"), F.col("x._n").alias("n")).join(hot, "gram", "left").select(
        "_row", "gram", "n", F.pmod(F.hash("_row"), parts).alias("part"))
    each = pairs.join(values, ["gram", "part"]).select("_row", "n", F.posexplode("values").alias("k", "v"))
    total = each.groupBy("_row", "k").agg(F.sum(F.col("n") * F.col("v")).alias("v")).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("k", "v")))["v"].alias("_total"))
    rows = texts.drop("_grams", "_n").join(total, "_row", "left").select(
        "_letter", "_chars", "_total", *held.columns[1:])
    judge = SavedModel(model.langs, [], [], [], model.usual)
    schema = T.StructType([T.StructField(c, rows.schema[f"_k{i}"].dataType) for i, c in enumerate(kept)] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [0] * len(judge.langs)
        for batch in batches:
            sums = np.array([t or none for t in batch.column(2).to_pylist()], np.int64)
            out = _judge(judge, sums, batch.column(1).to_numpy(), batch.column(0).to_pylist())
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.float64())
            cols = [pa.array(x, t) for x, t in zip(out[:len(fields)], types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *cols], names=[*kept, *names])

    return rows.mapInArrow(run, schema)


def predict(df: DataFrame, model: Model | SavedModel, text_col: str = "text",
            keep: list[str] | None = None, excess: bool = False) -> DataFrame:
    """``keep`` columns (default: all) plus the language of each whole text.

    ``lang_pred`` is the language of the lowest cross-entropy per character (ties: the first
    by code point), ``und`` for a text that is null or has no letter, or if the model has
    no language. ``score`` is the posterior under equal priors, from 50 characters' evidence
    at most; ``rejected`` marks texts beyond the language's calibrated limit, and lowers their
    score; with ``excess``, what is compared with the limit is returned too. Rows are judged
    one by one; input columns named like an output give way; an empty table stays empty.
    """
    fields = [*FIELDS, EXCESS] if excess else FIELDS
    if isinstance(model, SavedModel):
        return _predict_joined(df, model, text_col, keep, fields)
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by BROADCAST_GRAMS
    return map_text(df, text_col, fields, lambda texts: _predict(sent.value, texts)[:len(fields)], keep)


def held_out(key: Column) -> Column:
    """The rows that a model may not learn from: a quarter, by a checksum of the key's text
    (a null key is not held out)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
