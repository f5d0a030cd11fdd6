"""How the sources of a language differ in their words.

In-mapper stripes: each task folds whole documents into a hash of stripes, from a term to its
document frequency and its occurrences by source, and spills them when they are many. The
spilled stripes merge by key. The merged stripe of a kept term holds all that its share in
every source's divergences needs, so divergences are sums over stripes.

All arithmetic is on integers: a probability is a whole number of billionths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketspark.llm.common import CHUNK_BYTES, slices
from ticketspark.operators.vocab import sized
from ticketspark.session import materialize

# Documents of a language that must hold a kept term; added occurrences of each; billionths;
# terms reported of each group.
MIN_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
# Cells (term, source) from which on a task spills, some 100 bytes each, and pairs of a
# term's sources it holds at once.
CELLS, PAIRS = 1_000_000, 1 << 21
# What parts terms (bytes 0 to 64, 91 to 96 and 123 to 127) becomes a space, A-Z lower case.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


class _Stripes:
    """A language's stripes: of each term a number, its document frequency, and in one hash
    its occurrences by source."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.sources: dict[str, int] = {}
        self.df: list[int] = []
        self.cells: dict[int, int] = {}  # term << 32 | source -> occurrences

    def fold(self, text: bytes, source: str) -> None:
        terms, df, cells = self.terms, self.df, self.cells
        s = self.sources.setdefault(source, len(self.sources))
        for term, n in Counter(text.translate(_FOLD).split()).items():
            t = terms.get(term)
            if t is None:
                t = terms[term] = len(df)
                df.append(0)
            df[t] += 1
            key = t << 32 | s
            cells[key] = cells.get(key, 0) + n


def stripes(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(lang, term, df, stripe): a task's document frequency and (source, n) occurrences of
    a term, as often as the task has spilled it. ``docs`` has text, lang and source."""

    def spill(lang: str, held: _Stripes) -> Iterator[pa.RecordBatch]:
        key = np.fromiter(held.cells, np.int64, len(held.cells))
        n = np.fromiter(held.cells.values(), np.int64, len(key))
        order = np.argsort(key)
        key, n = key[order], n[order]
        at = np.searchsorted(key, np.arange(len(held.df) + 1) << 32).astype(np.int32)
        entries = pa.StructArray.from_arrays(
            [pa.array(list(held.sources), pa.string()).take(pa.array(key & 0xFFFFFFFF)), pa.array(n)], ["source", "n"])
        whole = pa.RecordBatch.from_arrays(
            [pa.repeat(lang, len(held.df)), pa.array(list(held.terms), pa.binary()).view(pa.string()),
             pa.array(held.df, pa.int64()), pa.ListArray.from_arrays(pa.array(at), entries)], ["lang", "term", "df", "stripe"])
        for i in range(0, len(held.df), 1 << 16):
            yield whole.slice(i, 1 << 16)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Stripes] = {}
        for batch in batches:
            for part in slices(batch, 0, CHUNK_BYTES):
                for text, lang, source in zip(*(c.to_pylist() for c in part.columns)):
                    held.setdefault(lang, _Stripes()).fold(text, source)
                if sum(len(x.cells) for x in held.values()) >= cells:
                    for lang, x in held.items():
                        yield from spill(lang, x)
                    held = {}
        for lang, x in held.items():
            yield from spill(lang, x)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(text.alias("text"), "lang", "source").mapInArrow(
        fold, "lang string, term string, df long, stripe array<struct<source:string,n:long>>")


def merged(parts: DataFrame) -> DataFrame:
    """(lang, term, df, stripe): spilled stripes summed by key. Stripes move once, whole; what
    is gathered of a key is one entry for each source."""
    entry = F.posexplode("stripe")
    cells = parts.repartition("lang", "term").select("lang", "term", "df", entry.alias("i", "e")).groupBy(
        "lang", "term", F.col("e.source").alias("source")).agg(
        F.sum("e.n").alias("n"), F.sum(F.when(F.col("i") == 0, F.col("df")).otherwise(0)).alias("df"))
    return cells.groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("stripe"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), exact at any size."""
    over = (n.cast("decimal(18,0)") + F.lit(SMOOTH)).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    under = total.cast("decimal(18,0)") + F.lit(SMOOTH) * terms.cast("decimal(18,0)")
    rest = over % under
    # what is divided has no remainder, so that no rounding takes place
    wide = ((over - rest) / under).cast("long")
    short = F.call_function("div", (n + F.lit(SMOOTH)) * F.lit(UNIT), total + F.lit(SMOOTH) * terms)
    return F.when(n < (1 << 63) // UNIT - SMOOTH, short).otherwise(wide) + F.lit(1)


def _together(cells: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(lang, source, item, x): of two sources that both hold a term, what the term's share
    differs from the sum of what either would add with the other not holding it."""
    held = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_lang = batch.column(0).dictionary_encode()
            entries = batch.column(1).flatten()
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            source = entries.field(0).dictionary_encode()
            code = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            p, none = (entries.field(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            n, first = np.repeat(size, size), np.repeat(np.cumsum(size) - size, size)
            tongue = np.repeat(of_lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), size)
            k, done = len(source.dictionary), np.cumsum(n)
            for a in _cuts(done, pairs):
                # each entry of the chunk with every entry of its stripe; one entry's
                # partners are sources, which a stripe holds in memory anyway
                i = np.repeat(np.arange(*a), n[slice(*a)])
                j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n[slice(*a)]) - n[slice(*a)], n[slice(*a)])
                i, j = i[i != j], j[i != j]
                x = np.abs(p[i] - p[j]) - np.abs(p[i] - none[j]) - np.abs(p[j] - none[i]) + np.abs(none[i] - none[j])
                key, at = np.unique((tongue[i] * k + code[i]) * k + code[j], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, at, x)
                yield pa.RecordBatch.from_arrays(
                    [of_lang.dictionary.take(pa.array(key // k // k)), source.dictionary.take(pa.array(key // k % k)),
                     source.dictionary.take(pa.array(key % k)), pa.array(total)], ["lang", "source", "item", "x"])

    return held.select("lang", "s").mapInArrow(run, "lang string, source string, item string, x long")


def _cuts(done: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges over running sums ``done`` that take ``most`` each, about."""
    part = done // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(done)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) of ``df``.

    Of part ``pair``, an item is another source of the language and the value the sum, over
    the language's kept terms (those in ``min_docs`` of its rows or more), of the absolute
    differences of the two sources' smoothed shares of the term. Of part ``term``, items are
    the ``top`` terms whose share in the group exceeds that in the whole language most. Ranks
    go by value, then by the item's code points.

    Null texts, languages and sources count as empty ones; repeated rows count each; a group
    without terms has rows of part ``pair`` still (0 if its language keeps no term), a
    language of one source none; an empty table has no result. Other columns play no part.
    A sum over pairs of sources is as large as the result, one row for each ordered pair.
    """
    def some(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    docs = df.select(F.col(f"`{text_col}`").alias("text"), some(lang_col).alias("lang"), some(source_col).alias("source"))
    kept = materialize(merged(stripes(docs, cells)).where(F.col("df") >= min_docs), "stripes")
    counts = kept.select("lang", F.inline("stripe")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").join(
        terms, "lang", "left").select("lang", "source", F.coalesce("total", zero).alias("total"),
                                      F.coalesce("terms", zero).alias("terms"))
    some_terms = F.col("terms") > 0
    groups = groups.withColumn("none", F.when(some_terms, _share(zero, F.col("total"), F.when(some_terms, F.col("terms")))))
    groups = sized(groups, "groups")
    whole = sized(groups.groupBy("lang").agg(F.sum("total").alias("all_total")), "languages")

    # a row for each kept term and source that holds it
    cells_ = kept.select("lang", "term", F.aggregate("stripe", zero, lambda a, e: a + e["n"]).alias("all_n"),
                         F.inline("stripe")).join(groups, ["lang", "source"]).join(whole, "lang")
    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    q = _share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    cells_ = materialize(cells_.select("lang", "term", "source", "none", p.alias("p"), q.alias("q")), "shares")
    most = cells_.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # sum |p - q| over kept terms = what no term in either source would give, plus what
    # each source's terms add to that alone, plus what terms in both differ from this
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    apart = F.abs(F.col("none") - F.col("other"))
    base = groups.join(other, "lang").where(F.col("source") != F.col("item")).select(
        "lang", "source", "item", F.coalesce(F.col("terms") * apart, zero).alias("x"))
    shares = cells_.groupBy("lang", "source", "none", "p").agg(F.count(F.lit(1)).alias("m"))
    alone = shares.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(F.col("m") * (F.abs(F.col("p") - F.col("other")) - apart)).alias("x"))
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "x")
    pair = base.unionByName(alone).unionByName(turned).unionByName(_together(cells_)).groupBy(
        "lang", "source", "item").agg(F.sum("x").alias("value")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return pair.select("*", rank).unionByName(most.select("*", rank).where(F.col("rank") <= top))
