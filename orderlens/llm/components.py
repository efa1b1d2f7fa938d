"""Connected components of an edge table by alternating star contractions.

Large-star hooks every larger neighbour of a node to the smallest node around it, small-star
the smaller ones (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).  The
table never has more edges than it began with.  Each round is cut off as a table in the
shared checkpoint folder, which replaces the table of the round before, and the loop ends when a round changes nothing.  Minima are
partial aggregates; the joins that spread them are plain equi-joins, which adaptive
execution splits at hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.session import StepTables


def _star(directed: DataFrame) -> DataFrame:
    """(v, m) for each (u, v), m the smallest of u and its v."""
    low = directed.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
    return directed.join(low, "u").select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    large = large.distinct()
    # small star: every node looks at its smaller neighbours only
    starred = _star(large)
    hooked = starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = starred.select("u", F.col("m").alias("v"))
    return hooked.unionByName(own).filter("u <> v").distinct()


def _mark(edges: DataFrame):
    """Number of edges and two sums of their hashes, to tell whether a round changed them."""
    return edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.hash("u", "v"))
    ).first()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of an edge; root is its component's smallest node.

    ``edges``: two columns of one orderable type.  Loops and repeated edges are allowed.
    """
    a, b = edges.columns
    # larger node first, so that small-star sees smaller neighbours
    rounds = StepTables()
    now = rounds.store(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    state = _mark(now)
    for _ in range(max_rounds):
        before, now = now, rounds.store(_round(now), "edges")
        rounds.drop(before)
        mark = _mark(now)
        if mark == state:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        state = mark
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
