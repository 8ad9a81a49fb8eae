"""Substring joins through an inverted index of short character runs (q-grams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3


def grams(text: Column, q: int) -> Column:
    """The distinct runs of ``q`` characters of a text."""
    starts = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, q)))


def contained_in(short: DataFrame, long: DataFrame, keys: list[str], q: int = Q) -> DataFrame:
    """Pairs (keys, ``short``, ``long``) where the text ``short`` is part of the text ``long``.

    ``short`` and ``long`` hold the keys and a column of that name, each row once.  All runs of the long texts are posted;
    a short text looks up one of its runs only, the one with the fewest postings, and what it meets there is
    compared in full.  Texts shorter than ``q`` are runs themselves.  NULL and empty texts match nothing.
    """
    posted = long.where("length(long) > 0").select(*keys, "long", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col("long"), n) for n in range(1, q + 1)])))).alias("_gram"))
    sizes = posted.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length("short") < q, F.array("short")).otherwise(grams(F.col("short"), q))
    runs = short.where("length(short) > 0").select(*keys, "short", F.explode(own).alias("_gram"))
    # a run without postings rules the text out: it keeps no probe that meets anything
    probe = runs.join(sizes, [*keys, "_gram"], "left").groupBy(*keys, "short").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return probe.join(posted, [*keys, "_gram"]).where(F.col("long").contains(F.col("short"))).select(*keys, "short", "long")


def containing_pairs(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str, q: int = Q) -> DataFrame:
    """Distinct pairs (keys, ``left``, ``right``) where either text is part of the other; NULL keys meet nothing."""
    a, b = a.select(*keys, left).distinct(), b.select(*keys, right).distinct()
    one = contained_in(a.withColumnRenamed(left, "short"), b.withColumnRenamed(right, "long"), keys, q)
    two = contained_in(b.withColumnRenamed(right, "short"), a.withColumnRenamed(left, "long"), keys, q)
    both = one.select(*keys, F.col("short").alias(left), F.col("long").alias(right))
    # equal texts are in both directions
    return both.unionByName(two.where("short <> long").select(*keys, F.col("long").alias(left), F.col("short").alias(right)))
