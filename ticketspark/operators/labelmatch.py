"""Free-text outputs to labels by an index over the labels (G4), for label sets of any size.

The rule is that of ``functions.decode.decode_lenient``: a cleaned output that equals a
label (lower-cased) is that label; else the first label, in ascending order, that it
contains; else ``UNPARSEABLE``. Here the labels are a table. Each has one posting under its
rarest q-gram, which an output that contains the label contains too; an output looks its own
q-grams up and verifies the labels found. Only distinct outputs are matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark.functions.decode import UNPARSEABLE, lenient_clean
from ticketspark.operators.vocab import fits, sized
from ticketspark.session import materialize

# Characters of a gram; shorter labels are grams themselves.
GRAM = 4


def _grams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters, in one linear scan."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def label_index(labels: DataFrame, label_col: str = "label", gram: int = GRAM) -> DataFrame:
    """(low, label, gram): a row for each lower-cased label that isn't empty, with the first
    label so spelt and, of its grams, the one that the fewest labels have."""
    low = F.lower(F.col(f"`{label_col}`"))
    one = labels.where(low != "").groupBy(low.alias("low")).agg(F.min(f"`{label_col}`").alias("label"))
    one = materialize(one, "labels")
    short = F.length("low") <= gram
    grams = one.select("low", "label", F.explode(F.array_distinct(F.when(
        short, F.array("low")).otherwise(_grams(F.col("low"), gram)))).alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return grams.join(held, "gram").groupBy("low", "label").agg(
        F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def decode_outputs(df: DataFrame, raw_col: str, labels: DataFrame, label_col: str = "label",
                   out_col: str = "predicted_intent", gram: int = GRAM) -> DataFrame:
    """``df`` plus ``out_col``: the label that each raw output decodes to.

    ``labels`` may hold a label many times, and nulls, which are none. A null output is
    ``UNPARSEABLE``. No row carries the labels and no task holds them all: an index within
    the broadcast budget is looked up where the outputs are, a larger one is joined by gram.
    Every row gives one row.
    """
    index = materialize(label_index(labels, label_col, gram), "label-index")
    lengths = [r[0] for r in index.select(F.length("gram")).distinct().collect()]  # 1 to ``gram`` only
    # the empty label comes first of all and is contained in every output
    blank = labels.where(F.col(f"`{label_col}`") == "").limit(1).count() > 0
    out = df.withColumn("_clean", lenient_clean(F.col(f"`{raw_col}`")))
    outputs = out.where(F.col("_clean").isNotNull()).select("_clean").distinct()
    small = fits(index)
    exact = index.select(F.col("low").alias("_clean"), "label")
    outputs = materialize(outputs.join(F.broadcast(exact) if small else exact, "_clean", "left").select(
        F.monotonically_increasing_id().alias("_output"), "_clean", "label"), "outputs")
    open_ = outputs.where(F.col("label").isNull() & (F.col("_clean") != "")).select("_output", "_clean")
    every = F.array_distinct(F.flatten(F.array(*[_grams(F.col("_clean"), n) for n in lengths])) if lengths
                             else F.array().cast("array<string>"))
    if small:
        hits = open_.select("_output", "_clean", F.explode(every).alias("gram")).join(F.broadcast(index), "gram")
    else:
        # grams travel without their outputs, which only candidates are joined to
        hits = open_.select("_output", F.explode(every).alias("gram")).join(index, "gram").drop("gram").join(open_, "_output")
    found = hits.where(F.contains("_clean", F.col("low"))).groupBy("_output").agg(F.min("label").alias("held"))
    named = outputs.join(found, "_output", "left").select("_clean", F.coalesce("label", F.lit("") if blank else F.col(
        "held"), F.lit(UNPARSEABLE)).alias(out_col))
    return out.join(sized(named, "decoded-outputs"), "_clean", "left").select(
        *[F.col(f"`{c}`") for c in df.columns if c != out_col], F.coalesce(out_col, F.lit(UNPARSEABLE)).alias(out_col))


def flag_labels(df: DataFrame, value: Column, labels: DataFrame, label_col: str = "label",
                out_col: str = "is_label") -> DataFrame:
    """``df`` plus ``out_col``: is ``value`` exactly a label? (False for a null value.) Membership
    is a join with the distinct labels, broadcast within the budget; no row carries them."""
    known = labels.where(F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{label_col}`").alias("_value")).distinct()
    known = sized(known.withColumn(out_col, F.lit(True)), "known-labels")
    return df.withColumn("_value", value).join(known, "_value", "left").select(
        *[F.col(f"`{c}`") for c in df.columns], F.coalesce(out_col, F.lit(False)).alias(out_col))
