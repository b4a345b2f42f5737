"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from zonecast.llm.batches import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): every node of the edges with the smallest node that it is connected to.

    Each step replaces a node's edges by edges to the smallest neighbour, so the edges shrink
    to stars in a logarithmic number of rounds. A hub's edges are never gathered: its minimum
    is aggregated and joined back. Every round is a checkpoint. Null ends and loops are left out.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above a node go to the least of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below it go to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        below = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(below.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    centres = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres.select("node", F.col("node").alias("label")))


def component_table(said: DataFrame, copies: DataFrame) -> DataFrame:
    """(set_id, component_id, n_links) of every class of ``copies`` (set_id, copies, first_id).

    ``said`` (set_id, to, n_links) has spanning edges of the links between classes, and partial
    counts of what a class links to, in copies.
    """
    labels = connected_components(said.select(F.col("set_id").alias("a"), F.col("to").alias("b")))
    degrees = said.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))
    named = labels.join(copies, labels.node == copies.set_id)
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked_sets = named.join(smallest, "label").select("set_id", "component_id")
    return copies.join(linked_sets, "set_id", "left").join(degrees, "set_id", "left").select(
        "set_id", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
