"""Connected components by alternating star contraction; hubs are aggregated on the map side, never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import stage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's least node.

    Each round links every node to the least neighbour known, first for larger neighbours, then for smaller ones; it
    ends when a round changes nothing; after ``rounds`` without that it fails.  Self edges and repeated edges are ignored.
    """
    now = stage(edges.filter(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    state = _fingerprint(now)
    for _ in range(rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.join(least.withColumnRenamed("u", "lo"), "lo").select("hi", F.col("m").alias("lo")).distinct()  # m <= lo < hi
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(down, "hi")
        after = stage(pairs.select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))
                      .unionByName(down.select("hi", F.col("m").alias("lo"))).filter("hi != lo").distinct(), "edges")
        was, state = state, _fingerprint(after)
        now = after
        if was == state:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return roots.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
                             .join(roots.select("node"), "node", "left_anti"))
