"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record falls into one of ``SLOTS`` slots by a hash of its id; the map names the
shard of each slot.  Version 1 is the map of one shard; adding a shard edits the map so that
slots move only into the new shard, one at a time from the shard that holds most.  The map
follows from the number of shards alone, so doc_id and shard count decide (law ``key``).
``slot_bytes`` aggregates rows and bytes per slot; ``rebalanced`` edits a map by those bytes
for users who prefer even sizes.  Maps are stored as rows (version, slot_no, shard, n_rows, n_bytes).

Null ids share the slot of the empty text.  Null texts have no bytes.  Repeated rows stay
and get a place each.  Empty tables give empty shards.  Other columns are left alone.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.registry import query
from wardline.llm.tables import table, written

SLOTS = 4096
STRIPES = 16


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def key_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot after growing from one shard to ``shards`` edit by edit."""
    if not 1 <= shards <= slots:
        raise ValueError(f"shards must be from 1 to {slots}")
    held = [list(range(slots))]
    for n in range(1, shards):
        heap = [(-len(s), i) for i, s in enumerate(held)]
        heapq.heapify(heap)
        new: list[int] = []
        while len(new) < slots // (n + 1):
            _, i = heapq.heappop(heap)
            new.append(held[i].pop())
            heapq.heappush(heap, (-len(held[i]), i))
        held.append(new)
    out = [0] * slots
    for shard, owned in enumerate(held):
        for s in owned:
            out[s] = shard
    return out


def rebalanced(shard_of: list[int], n_bytes: list[int], shards: int) -> list[int]:
    """Edit a map by bytes: slots move from the fullest shard to the emptiest while that narrows the gap."""
    load, held = [0] * shards, [[] for _ in range(shards)]
    for s, shard in enumerate(shard_of):
        load[shard] += n_bytes[s]
        held[shard].append(s)
    while True:
        top, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[top] - load[low]
        best = max((s for s in held[top] if 0 < n_bytes[s] < gap), key=lambda s: (-abs(gap - 2 * n_bytes[s]), -s), default=None)
        if best is None:
            break
        held[top].remove(best)
        held[low].append(best)
        load[top] -= n_bytes[best]
        load[low] += n_bytes[best]
    out = list(shard_of)
    for shard, owned in enumerate(held):
        for s in owned:
            out[s] = shard
    return out


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot_no, n_rows, n_bytes of the slots in use."""
    return (docs.groupBy(slot_of(F.col("doc_id"), slots).alias("slot_no"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(record_size()).alias("n_bytes")))


def record_size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")


def store_maps(spark: SparkSession, maps: dict[int, list[int]], sizes: DataFrame) -> DataFrame:
    """Write the versions (number of shards) of the map beside the measured slot sizes."""
    rows = [(v, s, shard) for v, m in maps.items() for s, shard in enumerate(m)]
    known = spark.createDataFrame(rows, "version int, slot_no int, shard int")
    return written(known.join(sizes, "slot_no", "left").fillna(0, ["n_rows", "n_bytes"]), "slot-map")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", record_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), slots).alias("slot_no"))
    # a stripe splits the numbering of a slot whose id repeats; equal rows may take each other's place
    rows = rows.withColumn("stripe", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(STRIPES)).cast("int"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("slot_no", "stripe").orderBy("doc_id", "text_crc32", "size")) - 1)
    counts = docs.groupBy(
        slot_of(F.col("doc_id"), slots).alias("slot_no"),
        F.pmod(F.xxhash64(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), record_size()), F.lit(STRIPES)).cast("int").alias("stripe"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(record_size()).alias("b"))
    counts = written(counts, "slot-stripes")
    sizes = counts.groupBy("slot_no").agg(F.sum("n").alias("n_rows"), F.sum("b").alias("n_bytes"))
    maps = store_maps(spark, {shards: key_map(shards, slots), shards + 1: key_map(shards + 1, slots)}, sizes)
    here = maps.where(F.col("version") == shards).select("slot_no", "shard")
    grown = maps.where(F.col("version") == shards + 1).select("slot_no", F.col("shard").alias("grown_shard"))
    # at most slots x STRIPES small rows: bounded by the two parameters
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slot_no", "stripe").rowsBetween(Window.unboundedPreceding, -1))
    base = (counts.join(F.broadcast(here), "slot_no").join(F.broadcast(grown), "slot_no")
            .select("slot_no", "stripe", "shard", "grown_shard", F.coalesce(before, F.lit(0)).alias("base")))
    return rows.join(F.broadcast(base), ["slot_no", "stripe"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), "grown_shard")


@query("op9_virtual_slots")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40)
