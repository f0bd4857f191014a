"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b); the root is the component's smallest node.

    Each round hangs a node's larger neighbours on its smallest neighbour, then its smaller ones. The
    minima combine before the shuffle, and the join back splits hot nodes. Rounds grow with the
    logarithm of the longest path.
    """

    def key(table: DataFrame) -> tuple:
        row = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    def both_ways(table: DataFrame) -> DataFrame:
        return table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))

    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = key(now)
    while state[0]:
        near = both_ways(now)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "small-star")
        state, before = key(now), state
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
