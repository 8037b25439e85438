"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of ``edges`` that has an edge; root is the smallest node.

    Each round makes every node point at its smallest neighbour (large star over
    larger neighbours, then small star over smaller ones) and is written to the
    shared folder.  Minima combine map-side, so a hub with a third of all edges
    is pre-reduced.  Rounds grow with the logarithm of the longest chain.  Edges
    with a null end and self-loops link nothing; an empty list gives no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = written(now, "edges")
    last = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(small.filter("u > v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = state
