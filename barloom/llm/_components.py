"""Connected components of a distributed edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that isn't the least of its component, which is its root.

    Rounds grow with the logarithm of the longest path. Each round is two aggregates with partial sums and two
    joins back, whose large partitions Spark splits, so that a node with very many edges doesn't fill a task.
    """
    current = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    # joins are by the node and its hash, so that they are another step than the sums and Spark may split a node with very many edges
    keyed = lambda df: df.withColumn("h", F.xxhash64("u"))
    while True:
        state = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == mark or state[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = keyed(both.where("v > u")).join(keyed(least), ["u", "h"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = keyed(large).join(keyed(low), ["u", "h"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        # edges never become more: files of a quarter million of them at most, and few where they are few
        after = work.write(small.coalesce(max(8, state[0] // 250_000 + 1)), "edges")
        work.drop(current)
        current = after
