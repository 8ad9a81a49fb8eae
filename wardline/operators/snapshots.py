"""Differences between consecutive snapshots (SET-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.functions.scoring import critical_path, severity_of_file_change
from wardline.functions.text import jaccard_distance
from wardline.operators.segmented import dimension_join, salted_join


def diff_snapshots(snap: DataFrame, key: list[str], value: str | None = None, scope: list[str] | None = None,
                   cycle: str = "cycle", carry: list[str] | None = None) -> DataFrame:
    """Created, modified and deleted keys between each snapshot and the one before it.

    The first snapshot of a scope emits nothing.  Snapshots are compared by a full
    join on scope, cycle and key; only the list of cycles per scope is windowed.
    """
    scope = scope or ["host"]
    carry = carry or []
    cycles = snap.select(*scope, cycle).distinct()
    order = Window.partitionBy(*scope).orderBy(cycle)
    cycles = cycles.select(*scope, cycle, F.lead(cycle).over(order).alias("_next"), F.lag(cycle).over(order).alias("_prev"))
    listed = salted_join(snap, cycles, [*scope, cycle], "inner")
    hashed = F.col(value) if value else F.lit(1)
    now = listed.where("_prev IS NOT NULL").select(*scope, cycle, *key, hashed.alias("_now"), *[F.col(c).alias(f"_n_{c}") for c in carry])
    before = listed.where("_next IS NOT NULL").select(*scope, F.col("_next").alias(cycle), *key, hashed.alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in carry])
    both = now.join(before, [*scope, cycle, *key], "full")
    change = (F.when(F.col("_old").isNull(), "created").when(F.col("_now").isNull(), "deleted")
              .when(F.col("_now") != F.col("_old"), "modified"))
    return both.withColumn("change", change).where("change IS NOT NULL").select(
        *scope, cycle, *key, "change", *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in carry])


def diff_connections(snap: DataFrame, key: list[str]) -> DataFrame:
    d = diff_snapshots(snap, key)
    return d.withColumn("event_type", F.when(F.col("change") == "created", "connection_new").otherwise("connection_closed")) \
        .withColumn("severity", F.when(F.col("change") == "created", "low").otherwise("info")).drop("change")


def diff_processes(snap: DataFrame) -> DataFrame:
    """New processes with name and path, gone processes without."""
    d = diff_snapshots(snap, ["pid"], carry=["name", "exe"])
    new = F.col("change") == "created"
    return d.select("host", "cycle", "pid", F.when(new, "process_new").otherwise("process_gone").alias("event_type"),
                    F.when(new, "low").otherwise("info").alias("severity"), F.when(new, F.col("name")).alias("name"), F.when(new, F.col("exe")).alias("exe"))


def diff_registry(snap: DataFrame, key: list[str], value: str) -> DataFrame:
    """Registry changes with severity and the entropy of the value."""
    from wardline.functions.text import byte_entropy, value_hash

    d = diff_snapshots(snap.withColumn("_hash", value_hash(F.col(value))), key, "_hash", carry=[value])
    return d.withColumn("severity", F.when(F.col("change") == "created", "high").otherwise("medium")) \
        .withColumn("entropy", byte_entropy(F.encode(F.col(value).cast("string"), "UTF-8")))


def diff_devices(snap: DataFrame, key: list[str], serial: str, whitelist: DataFrame) -> DataFrame:
    """Inserted and removed devices; a whitelisted serial is only informational."""
    known = whitelist.select(F.col("value").alias(serial)).distinct().withColumn("_known", F.lit(True))
    d = dimension_join(diff_snapshots(snap, key, carry=[serial]), known, [serial], "left")
    listed = F.coalesce(F.col("_known") & (F.col(serial) != ""), F.lit(False))
    new = F.col("change") == "created"
    return d.select("host", "cycle", *key, F.when(new, "usb_inserted").otherwise("usb_removed").alias("event_type"),
                    F.when(new & ~listed, "medium").otherwise("info").alias("severity"), listed.alias("whitelisted"))


def diff_adapters(snap: DataFrame, key: list[str]) -> DataFrame:
    d = diff_snapshots(snap, key).where("change = 'created'")
    return d.drop("change").withColumn("event_type", F.lit("rogue_adapter")).withColumn("severity", F.lit("high"))


def diff_files(snap: DataFrame, path: str, value: str, entropy: str) -> DataFrame:
    d = diff_snapshots(snap, [path], value, carry=[entropy])
    return d.withColumn("severity", severity_of_file_change(F.col("change"), F.col(entropy))).withColumn("critical", critical_path(F.col(path)))


def diff_canaries(canaries: DataFrame, files: DataFrame) -> DataFrame:
    """State of canaries not already triggered: missing, triggered (changed) or deployed."""
    live = canaries.where(~F.col("status").isin("triggered", "error"))
    now = files.select("path", F.col("hash").alias("_now"))
    state = (F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("content_hash"), "triggered").otherwise("deployed"))
    return live.join(now, "path", "left").select("canary_id", "path", state.alias("status"), F.when(F.col("_now").isNull(), "File deleted")
                                                 .when(F.col("_now") != F.col("content_hash"), "Content modified").alias("reason"))


def dna_anomaly(current: DataFrame, profiles: DataFrame, min_observations: int = 5) -> DataFrame:
    """Weighted set distance of current behaviour (five ARRAY columns) to its profile; 1.0 without one."""
    old = profiles.select("process_hash", "observations", *[F.col(s).alias(f"_p_{s}") for s in fv.DNA_WEIGHTS])
    empty = F.array().cast("array<string>")
    joined = current.join(old, "process_hash", "left")
    parts = [F.lit(w) * jaccard_distance(F.coalesce(f"_p_{s}", empty), F.coalesce(s, empty)) for s, w in fv.DNA_WEIGHTS.items()]
    score = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    return joined.withColumn("anomaly", F.when(F.col("observations").isNull() | (F.col("observations") < min_observations), 1.0).otherwise(score)) \
        .select("process_hash", "anomaly")


def union_alerts(*parts: DataFrame) -> DataFrame:
    """All detectors' alerts in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
