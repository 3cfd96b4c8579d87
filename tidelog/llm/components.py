"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Edges stay in Spark; each step is one aggregate and one join, written to the shared folder. A node of many
edges is a hot key of a plain join, which adaptive execution splits. Nothing reaches the driver but two numbers a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidelog.plans.scratch import drop, keep


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (equal types, an order) to node, component: the smallest node reachable, for nodes with an edge
    that are not the smallest themselves. Loops and repeated edges do no harm. Whether a step changed anything is observed
    while its edges are written."""
    now = keep(edges.where("u != v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        mid = keep(_large(now), "large")
        seen = Observation()
        new = keep(_small(mid).observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")), "small")
        found = (seen.get["n"], seen.get["h"])
        drop(mid)
        drop(now)
        now = new
        if found == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = found
