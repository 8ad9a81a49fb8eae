"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node that has an edge (a, b).

    Each round sends neighbours to the least neighbour; the edges end as stars around roots.
    Rounds grow with the logarithm of a component's diameter; every round's edges are written
    to the shared folder, and only a count and a checksum come to the driver.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark = written(e, "edges"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every neighbour below u, and u itself, moves to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, written(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
