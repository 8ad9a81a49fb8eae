"""Questions over exported process-memory tables (J-16…J-18, C-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.functions.scoring import lookup
from wardline.functions.text import byte_entropy
from wardline.operators.segmented import salted_join, segmented_scan

_COLUMNS = ["pid", "finding", "address", "size", "confidence", "mitre_id"]


def _finding(df: DataFrame, kind: str, address: Column, size: Column, confidence: Column, mitre: str) -> DataFrame:
    return df.select("pid", F.lit(kind).alias("finding"), address.cast("bigint").alias("address"), size.cast("bigint").alias("size"),
                     confidence.cast("double").alias("confidence"), F.lit(mitre).alias("mitre_id"))


def thread_outside_modules(modules: DataFrame, threads: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Threads whose start address lies in no module of their process.

    Modules and threads are merged in address order; the running greatest module
    end tells whether a module covers the address.  No module-thread pairs arise.
    """
    ends = modules.select("pid", F.col("base").alias("_pos"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("thread_id"), (F.col("base") + F.col("size")).alias("_end"))
    starts = threads.where("start_address <> 0").select("pid", F.col("start_address").alias("_pos"), F.lit(1).alias("_kind"), F.col("thread_id").cast("bigint").alias("thread_id"), F.lit(None).cast("bigint").alias("_end"))
    merged = segmented_scan(ends.unionByName(starts), ["pid"], F.floor(F.col("_pos") / block).cast("bigint"), ["_pos", "_kind", "thread_id"], {"_cover": ("max", F.col("_end"))})
    outside = merged.where("_kind = 1").where(F.col("_cover").isNull() | (F.col("_cover") <= F.col("_pos")))
    return outside.select("pid", "thread_id", F.col("_pos").alias("start_address"))


def has_image_header(content: Column) -> Column:
    """MZ header whose pointer leads to a PE signature inside the content."""
    size = F.length(content)
    raw = F.hex(F.substring(content, 61, 4))
    offset = F.conv(F.concat(F.substring(raw, 7, 2), F.substring(raw, 5, 2), F.substring(raw, 3, 2), F.substring(raw, 1, 2)), 16, 10).cast("bigint")
    signature = F.hex(F.substring(content, (offset + 1).cast("int"), F.lit(4)))
    return F.coalesce((size >= 64) & (F.hex(F.substring(content, 1, 2)) == "4D5A") & (offset + 4 <= size) & (signature == "50450000"), F.lit(False))


def unbacked_images(regions: DataFrame, modules: DataFrame, managed: bool = False) -> DataFrame:
    """Regions with an image header at a base that is no loaded module; ``managed`` also asks for the metadata marker."""
    found = regions.where(has_image_header(F.col("content")))
    if managed:
        found = found.where(F.contains(F.col("content"), F.lit(bytearray(b"BSJB"))))
    return salted_join(found, modules.select("pid", "base").distinct(), ["pid", "base"], "left_anti")


def hooked_prologues(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Code that differs from disk and newly starts with a jump (module, offset, bytes, module_size)."""
    both = salted_join(
        memory.where(F.lower("module").isin(*fv.HOOK_MODULES) & F.col("offset").isin(*fv.HOOK_OFFSETS) & (F.col("offset") < F.col("module_size"))),
        disk.select("module", "offset", F.col("bytes").alias("disk_bytes")), ["module", "offset"], "inner")
    m, d = F.hex("bytes"), F.hex("disk_bytes")
    starts = lambda c, h: c.startswith(h)
    jump = (starts(m, "E9") & ~starts(d, "E9")) | (starts(m, "FF25") & ~starts(d, "FF25"))
    return both.where((F.length("bytes") >= 2) & (F.length("disk_bytes") >= 2) & (m != d) & jump)


def memory_findings(regions: DataFrame, modules: DataFrame, threads: DataFrame, memory: DataFrame | None = None, disk: DataFrame | None = None) -> DataFrame:
    """All findings over committed, executable, private regions, threads and code bytes, with severity."""
    live = regions.where("is_committed AND is_executable AND is_private")
    base, size = F.col("base"), F.col("size")
    entropy = live.withColumn("_e", byte_entropy(F.col("content"), rounded=False)).where("_e > 6.0")
    parts = [
        _finding(unbacked_images(live, modules), "reflective_dll", base, size, F.lit(0.85), "T1620"),
        _finding(unbacked_images(live, modules, managed=True), "dotnet_injection", base, size, F.lit(0.80), "T1055"),
        _finding(entropy, "shellcode", base, size, F.least(F.lit(1.0), (F.col("_e") - 6.0) / 2.0), "T1055"),
        _finding(live.where("is_rwx"), "rwx_region", base, size, F.lit(0.6), "T1055.012"),
        _finding(thread_outside_modules(modules, threads), "suspicious_thread", F.col("start_address"), F.lit(0), F.lit(0.75), "T1055.003"),
    ]
    if memory is not None and disk is not None:
        parts.append(_finding(hooked_prologues(memory, disk), "inline_hook", F.col("module_base") + F.col("offset"), F.lit(16), F.lit(0.85), "T1055"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("severity", lookup(F.col("finding"), fv.MEMORY_SEVERITY, "medium"))
