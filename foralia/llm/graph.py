"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foralia.runtime import drop_scratch, free_driver, materialize, shuffled


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """`edges` written out, with the number and a hash of its rows, which are taken while it is written."""
    state = Observation()
    out = materialize(edges.observe(state, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "edges")
    return out, state.get


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the component's smallest node.

    Each round shuffles the remaining edges twice and halves long chains; minima are combined before the shuffle, and
    a hub's rows meet its minimum in a join that Spark may split and that broadcasts nothing. Every round is one job that is
    written out, so a lost executor never costs more than one round. Loops and repeated edges are allowed; no edges give no rows.
    """
    tidy = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current, state = _written(tidy)
    while state["n"]:
        # every edge has a > b, so its other direction leads to the larger neighbour
        both = current.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each node's larger neighbours move to its smallest one
        large = current.select(F.col("b").alias("a"), F.col("a").alias("b")).join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours move to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(shuffled(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(least.withColumnRenamed("m", "b")).distinct()
        following, after = _written(small)
        drop_scratch(current)
        current = following
        if after == state:
            break
        state = after
    free_driver(edges.sparkSession)
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
