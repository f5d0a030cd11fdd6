"""License scans by a positional index of rare tokens.

Templates are licence notices and references to licences. All their words, but for function
words, have postings (template, position) and a weight, the inverse document frequency in the
corpus. Each template is looked up by its rarest words, as many as a notice with enough of
its weight cannot lack; words of a file that agree on where the template would begin are
intersected, and a template is found where they and its other words make up
``MIN_SHARE`` of its weight and its mandatory key phrase stands in place, word by word.
Whatever else a file holds, no such notice is passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.llm.common import ascii_lower, plain
from ticketspark.session import materialize

# Words, and the base phrases with their labels.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# (label, notice, key phrase in it): the notices of public licences, as words.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software", "person obtaining a copy"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license you may obtain a copy of the license at", "apache license version 2 0"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation", "gnu general public license"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
             "license as published by the free software foundation", "lesser general public license"),
    ("agpl", "free software you can redistribute it and or modify it under the terms of the gnu affero general public "
             "license as published by the free software foundation", "affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
                "mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public "
            "license", "eclipse public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
     "software for any purpose"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
              "software and accompanying documentation covered by this license", "person or organization obtaining a copy"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work", "related or neighboring rights"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
]
# Names by which texts refer to licences, and the references made of them.
NAMES = [("mit", "mit license"), ("apache-2.0", "apache license"), ("gpl", "gnu general public license"),
         ("lgpl", "gnu lesser general public license"), ("agpl", "gnu affero general public license"),
         ("mpl-2.0", "mozilla public license"), ("epl", "eclipse public license"), ("bsd", "bsd license"),
         ("isc", "isc license"), ("boost", "boost software license")]
ARTICLE_FREE = [("cc-by-nc", "cc by nc"), ("cc-by-sa", "cc by sa"), ("cc-by-nd", "cc by nd"), ("cc0", "cc0 1 0"),
                ("cc-by", "creative commons attribution"), ("cc-by", "a creative commons attribution")]
VERBS = ("licensed", "released", "distributed")
TEMPLATES = NOTICES + [(label, f"{verb} under the {name}", name) for label, name in NAMES for verb in VERBS] + [
    (label, f"under the terms of the {name}", name) for label, name in NAMES] + [
    (label, f"{verb} under {name}", name.removeprefix("a ")) for label, name in ARTICLE_FREE for verb in VERBS]
# Words that have no postings and no weight.
FUNCTION_WORDS = frozenset(
    "a all and any are as at by can for has if in into is it may not of on one or that the this to under was with "
    "you v 0 1 2 4".split())
# Share of a template's weight that has to stand in place, rare words of it that have to
# agree on a place before the others are looked at, and units of weight.
MIN_SHARE, VOTES, UNIT = 0.8, 2, 1_000_000
BASE_SCORE = 0.5


def _postings() -> list[tuple[str, int, int]]:
    """(word, template, position)."""
    return [(w, t, q) for t, (_, notice, _) in enumerate(TEMPLATES) for q, w in enumerate(notice.split())
            if w not in FUNCTION_WORDS]


def _keys() -> list[str]:
    return sorted({key for *_, key in TEMPLATES})


def _key_start(notice: str, key: str) -> int:
    words, want = notice.split(), key.split()
    return next(i for i in range(len(words)) if words[i:i + len(want)] == want)


def vocabulary() -> list[str]:
    base = {w for p in BASE for w in p.split()}
    return sorted(({w for w, *_ in _postings()} | base) - FUNCTION_WORDS)


def weight(holding: int, total: int) -> int:
    """Inverse document frequency, in whole units."""
    return round(UNIT * (math.log((1 + total) / (1 + holding)) + 1))


def lookups(weights: dict[str, int], min_share: float = MIN_SHARE) -> list[tuple[str, int, int]]:
    """Of each template the postings it is looked up by: its heaviest, until what is not in
    place can't be all of them but ``VOTES - 1`` where ``min_share`` of the weight is."""
    posts: dict[int, list] = {}
    for w, t, q in _postings():
        posts.setdefault(t, []).append((-weights[w], q, w))
    out = []
    for t, own in posts.items():
        own.sort()
        most = (1 - min_share) * -sum(x[0] for x in own)
        taken = VOTES
        while taken < len(own) and -sum(x[0] for x in own[VOTES - 1:taken]) <= most:
            taken += 1
        out += [(w, t, q) for _, q, w in own[:taken]]
    return out


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table, as a literal in the plan."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


def _key_places(words: Column, hits: Column) -> Column:
    """(key, start) wherever a whole key phrase stands: from its first word with postings,
    all of its words are compared."""
    first: dict[str, list] = {}
    for k, key in enumerate(_keys()):
        want = key.split()
        j = next(j for j, w in enumerate(want) if w not in FUNCTION_WORDS)
        first.setdefault(want[j], []).append((k, j, want))

    def here(h: Column, k: int, j: int, want: list[str]) -> Column:
        at = h["p"] - j
        fits = F.when(at >= 0, F.slice(words, F.greatest(at + 1, F.lit(1)), len(want)) == F.array(*map(F.lit, want)))
        return F.when(fits, F.struct(F.lit(k).alias("key"), at.alias("start")))

    def found(h: Column) -> Column:
        out = F.array().cast("array<struct<key:int,start:int>>")
        for w, keys in first.items():
            out = F.when(h["w"] == w, F.array(*[here(h, *x) for x in keys])).otherwise(out)
        return out
    anchors = F.filter(hits, lambda h: h["w"].isin(*first))
    return F.filter(F.flatten(F.transform(anchors, found)), lambda x: x.isNotNull())


def _base_places(words: Column, hits: Column) -> Column:
    """(start, label) of every place of a base phrase, from the one of its words that has
    postings and is the rarest."""
    def at(p: Column) -> Column:  # before the first word there is none
        return F.when(p >= 0, F.get(words, p))

    def place(h: Column) -> Column:
        p = h["p"]
        return (F.when((h["w"] == "cc") & (at(p + 1) == "by"), F.struct(p.alias("start"), F.lit("cc-by").alias("label")))
                .when((h["w"] == "general") & (at(p + 1) == "public") & (at(p + 2) == "license"),
                      F.struct(p.alias("start"), F.lit("gpl").alias("label")))
                .when((h["w"] == "rights") & (at(p - 1) == "all") & (at(p + 1) == "reserved"),
                      F.struct((p - 1).alias("start"), F.lit("reserved").alias("label"))))
    return F.filter(F.transform(hits, place), lambda x: x.isNotNull())


def licenses(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) plus ``n_words``; ``n_base``, ``first_word`` and
    ``last_word`` (places of the base phrases; null without); ``base_labels`` and
    ``labels`` (comma-joined, sorted; the latter with those of the templates found);
    ``score`` (share of the best found template's weight that stands in place, at least
    0.5 with a base phrase, else 0); ``found``, an array of (label, start, share).

    A null or empty text has no words and no label. Every input row gives one row; of a
    label's places the one of the largest share counts, then the first; repeated rows and
    null keys need no care, and repeated rows count each in the words' weights; input columns
    named like an output give way to it; an empty table stays empty.
    """
    df = plain(df)
    spark = df.sparkSession
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    vocab = vocabulary()
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.regexp_extract_all(
        ascii_lower(F.col(f"`{text_col}`")), F.lit(LICENSE_WORD), F.lit(0)),
        F.array().cast("array<string>")).alias("_words"))
    hits = F.filter(F.transform("_words", lambda w, i: F.when(
        w.isin(*vocab), F.struct(i.alias("p"), w.alias("w")))), lambda x: x.isNotNull())
    rows = rows.select("*", hits.alias("_hits"))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.size("_words").cast("long").alias("n_words"), "_hits",
                       F.when(F.size("_hits") > 0, _base_places(F.col("_words"), F.col("_hits"))).alias("_base"),
                       F.when(F.size("_hits") > 0, _key_places(F.col("_words"), F.col("_hits"))).alias("_keys"),
                       F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "license-words")

    # document frequency of the licence words; the table has a row a word at most
    asked = rows.where(F.size("_hits") > 0).select("_row", "_hits", "_keys", F.array_distinct("_hits.w").alias("_w"))
    df_of = {r["w"]: r["n"] for r in asked.select(F.explode("_w").alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    total = rows.count()
    weights = {w: weight(df_of.get(w, 0), total) for w in vocab}
    posts = _postings()
    whole = [sum(weights[w] for w, u, _ in posts if u == t) for t in range(len(TEMPLATES))]
    keys = _keys()
    postings = F.broadcast(_table(spark, [(w, t, q, weights[w]) for w, t, q in posts], ["w", "t", "q", "weight"]))
    rare = F.broadcast(_table(spark, lookups(weights), ["w", "t", "q"]))
    notices = F.broadcast(_table(spark, [
        (t, label, whole[t], keys.index(key), _key_start(notice, key)) for t, (label, notice, key) in enumerate(TEMPLATES)],
        ["t", "label", "whole", "key", "offset"]))

    def placed(table: DataFrame) -> DataFrame:
        words = asked.where(F.size("_w") >= VOTES).select("_row", F.explode("_hits").alias("h"))
        return words.select("_row", F.col("h.p").alias("p"), F.col("h.w").alias("w")).join(table, "w").withColumn(
            "at", F.col("p") - F.col("q"))

    # where rare words agree, and where the key phrase that has to stand there does
    agreed = placed(rare).groupBy("_row", "t", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= VOTES)
    there = asked.select("_row", F.inline("_keys"))
    agreed = agreed.join(notices, "t").withColumn("start", F.col("at") + F.col("offset")).join(
        there, ["_row", "key", "start"], "left_semi")
    agreed = materialize(agreed.select("_row", "t", "at", "label", "whole"), "license-places")
    share = (F.sum("weight") / F.first("whole")).alias("share")
    places = placed(postings).join(agreed, ["_row", "t", "at"]).groupBy("_row", "t", "at", "label").agg(share).where(
        F.col("share") >= MIN_SHARE)
    by_label = places.groupBy("_row", "label").agg(F.max(F.struct("share", (-F.col("at")).alias("at"))).alias("b"))
    found = materialize(by_label.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "label", F.greatest(-F.col("b.at"), F.lit(0)).alias("start"), F.col("b.share").alias("share")))).alias("found")), "licenses")

    out = rows.join(found, "_row", "left")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.col("_base.label"), F.array().cast("array<string>"))))
    more = F.coalesce(F.col("found.label"), F.array().cast("array<string>"))
    some = F.size("_base") > 0
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "n_words",
        F.when(some, F.size("_base")).otherwise(0).cast("long").alias("n_base"),
        F.when(some, F.array_min("_base.start")).cast("long").alias("first_word"),
        F.when(some, F.array_max("_base.start")).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.greatest(F.when(some, BASE_SCORE).otherwise(0.0),
                   F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"),
        F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
