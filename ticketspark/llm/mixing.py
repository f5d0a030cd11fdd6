"""Mixing sources to target weights by entropy balancing.

Every document has a rate, the number of times that the mix takes it. Of all rates that
meet each source's token target, the mix wants those closest to one in relative entropy:
exponentially tilted rates min(cap, exp(lambda * size)), with one lambda per source
that solves a convex dual problem. Newton's method finds all lambdas at once, each step a
distributed aggregate; the rates are then rounded into whole copies.

Rates depend on a document's source and size only, so everything up to the rounding runs
on the table of (source, size, number of documents).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketspark.llm.common import WORD, plain
from ticketspark.operators.vocab import sized
from ticketspark.session import materialize

WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
# Newton steps that make one job, and jobs at most (a bracket halves wherever a step fails).
STEPS, ROUNDS = 4, 20
# Relative error of a source's tokens at which its lambda stays.
TOLERANCE = 1e-6
# Sums are of integers, in this fraction of a word: they don't depend on the rows' order.
UNIT = 1024
REPAIRS = 4
# Rows of equal source and size that one window task orders, about.
BUCKET_ROWS = 1024
# A bucket of over so many times as many rows holds many rows of one id.
LARGE = 8

_KEY = ["_s", "_z"]  # a source: its name or an empty string, and whether it is null


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(cells: DataFrame, weights: tuple, total: float, most: float) -> DataFrame:
    """(source key, source_size, docs, target) from (source key, _size, n) rows.

    Sources are ranked by a range-partitioned sort (no task sees all of them). The level
    at which the capped shares add up is found by resharing the excess until no source is
    above its cap, which takes one small aggregate a time."""
    spark = cells.sparkSession
    by_source = cells.groupBy(*_KEY).agg(
        F.sum(F.col("n") * F.col("_size")).alias("source_size"),
        F.sum(F.when(F.col("_size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(by_source.repartitionByRange(parts, "_z", "_s").sortWithinPartitions(
        "_z", "_s").withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("k")).select(
        "_part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_before"))  # a row a partition
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(
            F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1), F.lit(len(weights))) + 1).cast("int")))
    ranked = materialize(ranked.select(*_KEY, "source_size", "docs", "w"), "mix-weights")
    cap = F.col("source_size") * F.lit(float(most))
    whole, shares = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    left, level, seen = total * (whole or 0), 0.0, None
    while shares:
        level = left / shares
        above = cap <= F.lit(level) * F.col("w")
        capped, free, k = ranked.agg(
            F.sum(F.when(above, F.col("source_size")).otherwise(0)),
            F.sum(F.when(~above, F.col("w")).otherwise(0.0)), F.sum(above.cast("int"))).first()
        left, shares = total * whole - most * capped, free
        if k == seen:
            break
        seen = k
    return ranked.select(*_KEY, "source_size", "docs", F.least(cap, F.when(
        F.lit(bool(shares)), F.lit(float(level)) * F.col("w")).otherwise(cap)).alias("target"))


def _rate(most: float) -> Column:
    """The rate of a row's size. Where the target is the cap, everything is taken as often
    as can be; a document without words keeps its rate of one."""
    return F.when(F.col("_size") == 0, 1.0).when(F.col("_full"), float(most)).otherwise(
        F.least(F.exp(F.col("lam") * F.col("_size") / F.col("scale")), F.lit(float(most))))


def _step(cells: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """A safeguarded Newton step of every source's dual."""
    x = F.col("_size") / F.col("scale")
    e = F.exp(F.col("lam") * x)
    tokens = F.col("n") * F.col("_size")
    at = cells.where(F.col("_size") > 0).join(state, _KEY).groupBy(*_KEY).agg(
        F.sum(F.round(tokens * F.least(e, F.lit(float(most))) * UNIT).cast("long")).alias("f"),
        F.sum(F.when(e < most, F.round(tokens * x * e * UNIT).cast("long")).otherwise(0)).alias("df"))
    s = state.join(at, _KEY, "left").withColumn("g", F.col("f") / UNIT - F.col("target"))
    s = s.withColumn("lo", F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(F.col("g") >= 0, F.col("lam")).otherwise(F.col("hi")))
    newton = F.when(F.col("df") > 0, F.col("lam") - F.col("g") * UNIT / F.col("df"))
    inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
    jump = F.greatest(F.lit(1.0), F.abs("lam"))
    other = F.when(F.col("hi").isNull(), F.col("lam") + jump).when(
        F.col("lo").isNull(), F.col("lam") - jump).otherwise((F.col("lo") + F.col("hi")) / 2)
    gap = F.when(F.col("_full") | F.col("g").isNull(), 0.0).otherwise(
        F.greatest(F.abs("g") - 1, F.lit(0.0)) / F.greatest("target", F.lit(1.0)))
    return s.withColumn("gap", gap).withColumn(
        "lam", F.when(F.col("gap") <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise(other)
    ).drop("f", "df", "g")


def tilts(cells: DataFrame, goal: DataFrame, most: float) -> DataFrame:
    """``goal`` plus ``lam``, ``scale`` and ``_full``: the solved duals, one row a source."""
    none = F.lit(None).cast("double")
    state = goal.withColumn("scale", F.greatest(F.col("source_size") / F.greatest("docs", F.lit(1)), F.lit(1.0)))
    state = state.withColumn("_full", F.col("target") >= F.col("source_size") * F.lit(float(most)))
    state = state.withColumn("lam", F.when(F.col("_full") | (F.col("target") <= 0), 0.0).otherwise(
        F.log(F.col("target") / F.greatest("source_size", F.lit(1))))).withColumn(
        "lo", none).withColumn("hi", none).withColumn("gap", F.lit(1.0))
    done = []
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            state = _step(cells, state, most)
        state = materialize(state, "mix-tilts")
        # solved sources take no further step
        done.append(state.where(F.col("gap") <= TOLERANCE))
        state = state.where(F.col("gap") > TOLERANCE)
        left = state.agg(F.count(F.lit(1)), F.max("gap")).first()
        if not left[0]:
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"{left[0]} sources are up to {left[1]:.2g} of their targets away after {ROUNDS * STEPS} steps")


def copies(cells: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """Cells with ``k``, the copies that all their documents have together.

    From the largest size down, cumulative rates are rounded, so that a source's error
    stays below half its largest document; repairs then add or take copies of documents no
    larger than the error that is left, the largest first. A window holds one source's
    distinct sizes, which the longest text bounds."""
    every = Window.partitionBy(*_KEY)
    down = every.orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, 0)
    c = cells.join(state, _KEY).withColumn("_sum", F.sum(F.col("n") * _rate(most)).over(down))
    c = c.withColumn("_to", F.floor(F.col("_sum") + 0.5)).withColumn(
        "k", F.col("_to") - F.coalesce(F.lag("_to").over(every.orderBy(F.desc("_size"))), F.lit(0)))
    c = c.withColumn("k", F.least(F.greatest("k", F.lit(0)), F.col("n") * most))
    for _ in range(REPAIRS):
        c = c.withColumn("_off", F.sum(F.col("k") * F.col("_size")).over(every) - F.col("target"))
        want = F.abs("_off")
        c = c.withColumn("_can", F.when((F.col("_size") > 0) & (F.col("_size") <= want), F.when(
            F.col("_off") < 0, F.col("n") * most - F.col("k")).otherwise(F.col("k"))).otherwise(0))
        c = c.withColumn("_sum", F.sum(F.col("_can") * F.col("_size")).over(down))
        room = F.floor((want - (F.col("_sum") - F.col("_can") * F.col("_size"))) / F.col("_size"))
        give = F.when(F.col("_can") > 0, F.least(F.greatest(room, F.lit(0)), F.col("_can"))).otherwise(0)
        c = c.withColumn("k", F.col("k") - F.signum("_off").cast("long") * give)
    return c.select(*_KEY, "_size", "n", "k", "source_size", "target")


def _many_of_one_id(rows: DataFrame, cell: list[str]) -> DataFrame:
    """``rows`` of buckets with ``_more`` extra copies, plus ``_one``: does a row get one? As
    in the order of ids, but the rows of one id, which are exchangeable, are dealt over parts
    that have their shares of the id's copies. A window holds a bucket's distinct ids, which
    are as many as in any bucket, or the rows of a part."""
    rows = rows.withColumn("_none", F.col("_id").isNull())
    one = [*cell, "_b", "_h", "_none", "_id"]
    ids = rows.groupBy(*one).agg(F.count(F.lit(1)).alias("_m"), F.first("_more").alias("_more"))
    upto = Window.partitionBy(*cell, "_b").orderBy("_h", "_none", "_id").rowsBetween(Window.unboundedPreceding, 0)
    ids = ids.withColumn("_left", F.col("_more") - F.sum("_m").over(upto) + F.col("_m"))
    ids = ids.withColumn("_extra", F.least(F.greatest("_left", F.lit(0)), F.col("_m")))
    ids = materialize(ids.select(*[F.col(c).alias(f"{c}_") for c in one], "_m", "_extra"), "mix-ids")
    same = [rows[c].eqNullSafe(ids[f"{c}_"]) if c == "_id" else rows[c] == ids[f"{c}_"] for c in one]
    parts = F.ceil(F.col("_m") / BUCKET_ROWS)
    dealt = rows.join(ids, same).withColumn("_p", F.pmod(F.xxhash64(F.lit("part"), "_row"), parts))
    dealt = materialize(dealt.drop(*[f"{c}_" for c in one]), "mix-parts")
    so_far = Window.partitionBy(*cell, "_b", "_h", "_none").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    sizes = dealt.groupBy(*cell, "_b", "_h", "_none", "_p").agg(
        F.count(F.lit(1)).alias("_k"), F.first("_m").alias("_all"), F.first("_extra").alias("_e"))

    def before(n: Column) -> Column:
        return F.when(n == F.col("_all"), F.col("_e")).otherwise(F.floor(F.col("_e").cast("double") * n / F.col("_all")))

    sizes = sizes.withColumn("_so", F.sum("_k").over(so_far))
    sizes = sizes.withColumn("_give", before(F.col("_so")) - before(F.col("_so") - F.col("_k")))
    key = [*cell, "_b", "_h", "_none", "_p"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("_row"))
    return dealt.join(sizes.select(*key, "_give"), key).withColumn("_one", nth <= F.col("_give"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        keep: list[str] | None = None, weights: tuple = WEIGHTS, total: float = TOTAL,
        most: int = MOST) -> DataFrame:
    """``keep`` columns (default: all) plus ``size`` (words of the text), ``source_size``,
    ``target`` (of the row's source), ``copies`` (0 to ``most``) and ``taken`` (copies times
    size).

    Sources in order of their code points, a null source last, have the ``weights`` in
    turn and share ``total`` times all sizes; no target is above ``most`` times its source's
    size. A null text has size 0; a row without words keeps one copy and takes nothing.
    Of documents of one source and size, a hash of the id decides which have one copy more
    than others; rows that agree in id, source and size are exchangeable, and a null id is an
    id like any other. Reruns agree. Input columns named like an output give way; an
    empty table stays empty.
    """
    df = plain(df)
    names = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = F.col(f"`{source_col}`").cast("string")
    rows = materialize(df.select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(source, F.lit("")).alias("_s"), source.isNull().alias("_z"),
        words(F.col(f"`{text_col}`")).alias("_size"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    cells = materialize(rows.groupBy(*_KEY, "_size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    state = tilts(cells, targets(cells, weights, total, most), most)
    got = materialize(copies(cells, state, most), "mix-copies")

    # which documents of a cell have a copy more: cells are cut into buckets by hash, each
    # with its share of the extra copies, and ordered by hash inside
    cell = [*_KEY, "_size"]
    dealt = rows.select("_row", "_id", *cell).join(got, cell)
    dealt = materialize(dealt.withColumn("_h", F.xxhash64(F.lit("mix"), "_id")).withColumn(
        "_b", F.pmod("_h", F.ceil(F.col("n") / BUCKET_ROWS))), "mix-dealt")
    extra = F.col("k") % F.col("n")
    upto = Window.partitionBy(*cell).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    share = dealt.groupBy(*cell, "_b").agg(
        F.count(F.lit(1)).alias("c"), F.first("k").alias("k"), F.first("n").alias("n")).withColumn(
        "_upto", F.sum("c").over(upto)).withColumn("_c", F.col("c"))

    def before(rows: Column) -> Column:  # extra copies of a cell's first rows; in doubles, as squares overflow
        return F.when(rows == F.col("n"), extra).otherwise(F.floor(extra.cast("double") * rows / F.col("n")))

    share = share.select(*cell, "_b", "_c", (before(F.col("_upto")) - before(F.col("_upto") - F.col("_c"))).alias("_more"))
    share = materialize(share, "mix-shares")
    # a bucket that is still large holds an id very many times
    large = sized(share.where(F.col("_c") > LARGE * BUCKET_ROWS), "mix-large")
    nth = F.row_number().over(Window.partitionBy(*cell, "_b").orderBy("_h", "_id", "_row"))
    one_more = dealt.join(share, [*cell, "_b"])
    if not large.isEmpty():
        one_more = dealt.join(share.where(F.col("_c") <= LARGE * BUCKET_ROWS), [*cell, "_b"])
    out = one_more.withColumn("_one", nth <= F.col("_more")).select(*dealt.columns, "_one")
    if not large.isEmpty():
        out = out.unionByName(_many_of_one_id(dealt.join(large, [*cell, "_b"]), cell).select(*dealt.columns, "_one"))
    out = out.withColumn("copies", (F.floor(F.col("k") / F.col("n")) + F.col("_one").cast("long")).cast("long"))
    out = out.select("_row", "_id", F.col("_size").alias("size"), "source_size", "target", "copies",
                     (F.col("copies") * F.col("_size")).alias("taken"))
    if all(c.lower() == id_col.lower() for c in kept):
        return out.select(*[F.col("_id").alias(c) for c in kept], *names)
    return rows.drop("_id", "_s", "_z", "_size").join(out.drop("_id"), "_row").select(
        *[F.col(f"`{c}`") for c in kept], *names)
