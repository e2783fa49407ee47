"""Connected components of a large edge table, by alternating star contractions.

Each round rewires every node to the smallest node it can see (large star, then small star), so the
number of rounds grows with the logarithm of a component's diameter. Minima are pre-aggregated
before each shuffle, and each round is written to the shared folder, so that a lost executor costs
one task and not the rounds before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for each node of an edge: ``root`` is the smallest node reachable, itself included.

    Self loops only name a node; nulls on either end are dropped; repeated edges count once; no edges
    give no rows.
    """
    # written first: what made the edges runs once
    first = written(edges.dropna(subset=[a, b]).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    nodes = first.select(F.col("hi").alias("node")).union(first.select("lo")).distinct()
    e = first.filter("hi <> lo")
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("s"))
        e = written(small.select(F.col("s.hi").alias("hi"), F.col("s.m").alias("lo")).filter("hi <> lo").distinct())
    roots = e.groupBy("hi").agg(F.min("lo").alias("lo"))
    return nodes.join(roots, nodes["node"] == roots["hi"], "left").select("node", F.coalesce("lo", "node").alias("root"))
