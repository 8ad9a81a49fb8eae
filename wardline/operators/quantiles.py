"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.segmented import salted_join


def grouped_median(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Exact median of non-negative BIGINT values given as (keys, value, n) counts.

    Three rounds of counting fix the high, middle and low bits of the two middle
    ranks.  Each round is a map-side combined aggregate with at most 65 536
    distinct digits per key (the first one for values under 2**48), so no group
    is sorted or collected.
    """
    hist = counts.groupBy(*keys, F.shiftright(value, 32).alias("_digit")).agg(F.sum(n).alias("_k"))
    running = Window.partitionBy(*keys).orderBy("_digit")
    hist = hist.select(*keys, F.col("_digit").alias("_prefix"), (F.sum("_k").over(running) - F.col("_k")).alias("_lo"),
                       F.sum("_k").over(running).alias("_hi"), F.sum("_k").over(Window.partitionBy(*keys)).alias("_n"))
    middle = F.array(F.struct(F.lit(0).alias("_w"), F.floor((F.col("_n") - 1) / 2).cast("bigint").alias("_rank")),
                     F.struct(F.lit(1).alias("_w"), F.floor(F.col("_n") / 2).cast("bigint").alias("_rank")))
    within = (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    targets = hist.select("*", F.inline(middle)).where(within).select(
        *keys, "_prefix", "_w", (F.col("_rank") - F.col("_lo")).alias("_rank"))
    for bits in (16, 0):
        rows = counts.select(*keys, F.shiftright(value, bits).alias("_digit"), F.shiftright(value, bits + 16).alias("_prefix"),
                             F.col(n).alias("_k"))
        hist = salted_join(rows, targets, [*keys, "_prefix"], "inner").groupBy(*keys, "_w", "_rank", "_digit").agg(F.sum("_k").alias("_k"))
        upto = Window.partitionBy(*keys, "_w").orderBy("_digit")
        hist = hist.withColumn("_hi", F.sum("_k").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_k"))
        targets = hist.where(within).select(*keys, F.col("_digit").alias("_prefix"), "_w", (F.col("_rank") - F.col("_lo")).alias("_rank"))
    return targets.groupBy(*keys).agg((F.sum("_prefix") / 2.0).alias("median"))
