"""Connected components of a graph that is given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): nodes have one label if a path
    of links joins them.

    Each round, every node moves to the neighbour (or itself) with the smallest hash, whose
    order is another one each round, and links follow their ends. Links inside a node
    vanish; the links that remain shrink by a constant factor on average, whatever the
    graph's shape. Degrees are combined within tasks, and both sides of each join are
    tables, so that Spark can split the rows of a node with very many links.
    """
    links = links.select("a", "b").where(F.col("a") != F.col("b"))
    labels = None
    step = 0
    links = materialize(links.distinct(), "links")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(
            F.xxhash64(F.lit(step), "b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64(F.lit(step), "a").alias("h"), F.col("a").alias("n"))
        moves = materialize(best.select("a", F.least("m", own)["n"].alias("to")), "moves")
        labels = moves.select(F.col("a").alias("node"), F.col("to").alias("label")) if labels is None \
            else labels.join(moves.withColumnRenamed("a", "label"), "label", "left").select(
                "node", F.coalesce("to", "label").alias("label"))
        labels = materialize(labels, "labels")
        links = links.join(moves, "a").select(F.col("to").alias("a"), "b").join(
            moves.select(F.col("a").alias("b"), "to"), "b").select("a", F.col("to").alias("b"))
        links = materialize(links.where(F.col("a") != F.col("b")).distinct(), "links")
        step += 1
    if labels is None:
        kind = links.schema["a"].dataType
        labels = links.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("label"))
    return labels
