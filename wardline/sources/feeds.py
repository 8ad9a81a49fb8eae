"""Threat-intelligence feed parsers (SC-05…SC-15) and technique tables.

Each ``parse_*`` works on a DataFrame so that files, streams and tables share it;
each ``read_*`` adds the file reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import fixed_values as fv

_IP_SCHEMA = "data ARRAY<STRUCT<ipAddress STRING, abuseConfidenceScore INT, countryCode STRING>>"
_HASH_SCHEMA = ("data ARRAY<STRUCT<id STRING, attributes STRUCT<type_description STRING, "
                "last_analysis_stats STRUCT<malicious INT>>>>")
_STIX_SCHEMA = ("objects ARRAY<STRUCT<type STRING, id STRING, pattern STRING, name STRING, description STRING, "
                "labels ARRAY<STRING>, object_marking_refs ARRAY<STRING>>>")


def _ioc(kind: str, value: Column, source: str, severity: Column, **metadata: Column) -> list[Column]:
    return [F.lit(kind).alias("ioc_type"), value.alias("value"), F.lit(source).alias("source"),
            severity.alias("severity"), F.to_json(F.struct(*[c.alias(n) for n, c in metadata.items()])).alias("metadata")]


def parse_ja3_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``date,hash,family,…``; comments, blanks and short lines are skipped."""
    line = F.trim(column)
    parts = F.split(line, ",", 4)
    rows = lines.where((F.length(line) > 0) & ~line.startswith("#")).withColumn("_p", parts).where(F.size("_p") >= 3)
    return rows.select(*_ioc("ja3", F.trim(F.col("_p")[1]), "sslbl", F.lit("medium"),
                             date=F.trim(F.col("_p")[0]), family=F.trim(F.col("_p")[2])))


def read_ioc_csv_ja3(spark: SparkSession, path: str) -> DataFrame:
    return parse_ja3_lines(spark.read.text(path))


def parse_ip_entries(entries: DataFrame) -> DataFrame:
    score = F.coalesce(F.col("abuseConfidenceScore"), F.lit(0))
    return entries.where(F.length("ipAddress") > 0).select(*_ioc(
        "ip", F.col("ipAddress"), "abuseipdb", F.when(score >= 95, "critical").otherwise("high"),
        abuse_confidence=score, country=F.coalesce("countryCode", F.lit(""))))


def read_ioc_json_ip(spark: SparkSession, path: str) -> DataFrame:
    return parse_ip_entries(spark.read.schema(_IP_SCHEMA).option("multiLine", True).json(path)
                            .select(F.inline("data")))


def parse_url_entries(entries: DataFrame) -> DataFrame:
    return entries.where(F.length("url") > 0).select(*_ioc(
        "url", F.col("url"), "phishtank", F.lit("high"), phish_id=F.col("phish_id"),
        target=F.coalesce("target", F.lit(""))))


def read_ioc_json_url(spark: SparkSession, path: str) -> DataFrame:
    return parse_url_entries(spark.read.schema("url STRING, phish_id STRING, target STRING")
                             .option("multiLine", True).json(path))


def parse_hash_entries(entries: DataFrame) -> DataFrame:
    bad = F.coalesce(F.col("attributes.last_analysis_stats.malicious"), F.lit(0))
    return entries.where(F.length("id") > 0).select(*_ioc(
        "hash", F.col("id"), "virustotal", F.when(bad >= 20, "critical").otherwise("high"),
        malicious_count=bad, file_type=F.coalesce("attributes.type_description", F.lit(""))))


def read_ioc_json_hash(spark: SparkSession, path: str) -> DataFrame:
    return parse_hash_entries(spark.read.schema(_HASH_SCHEMA).option("multiLine", True).json(path)
                              .select(F.inline("data")))


def parse_blocklist_ips(entries: DataFrame) -> DataFrame:
    """``ip_address`` or else ``ip``; entries with neither are skipped."""
    ip = F.coalesce(F.nullif(F.col("ip_address"), F.lit("")), F.nullif(F.col("ip"), F.lit("")))
    return entries.where(ip.isNotNull()).select(*_ioc(
        "ip", ip, "feodotracker", F.lit("high"), status=F.coalesce("status", F.lit(""))))


def parse_blocklist_urls(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("url") > 0).select(*_ioc(
        "url", F.col("url"), "phishtank", F.lit("high"), target=F.coalesce("target", F.lit(""))))


def read_ioc_blocklists(spark: SparkSession, ip_json: str, url_csv: str) -> DataFrame:
    """The two offline lists; every line of the URL list is read."""
    ips = spark.read.schema("ip_address STRING, ip STRING, status STRING").option("multiLine", True).json(ip_json)
    urls = spark.read.option("header", True).csv(url_csv)
    return parse_blocklist_ips(ips).unionByName(parse_blocklist_urls(urls))


def stix_severity(labels: Column, markings: Column) -> Column:
    """Severity word of the first telling label, else of a TLP marking, else by label."""
    low = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(x))
    word = lambda x: (F.when(x.contains("critical"), "critical").when(x.contains("high"), "high")
                      .when(x.contains("low"), "low"))
    by_label = F.try_element_at(F.filter(F.transform(low, word), lambda x: x.isNotNull()), F.lit(1))
    marks = F.transform(F.coalesce(markings, F.array().cast("array<string>")), lambda x: F.lower(x))
    tlp = lambda x: F.coalesce(*[F.when(x.contains(t), F.lit(s)) for t, s in fv.TLP_SEVERITY])
    by_mark = F.try_element_at(F.filter(F.transform(marks, tlp), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(by_label, by_mark, F.when(F.array_contains(low, "malicious-activity"), "high"), F.lit("medium"))


def parse_stix_objects(objects: DataFrame, source: str = "stix") -> DataFrame:
    """Indicators with the first of the known patterns; others are skipped."""
    hits = [F.when(F.col("pattern").rlike(rx), F.struct(
        F.lit(kind).alias("ioc_type"), F.regexp_extract("pattern", rx, 1).alias("value")))
        for kind, rx in fv.STIX_PATTERNS]
    found = objects.where("type = 'indicator'").withColumn("_hit", F.coalesce(*hits)).where("_hit IS NOT NULL")
    return found.select(
        "_hit.ioc_type", "_hit.value", F.lit(source).alias("source"),
        stix_severity(F.col("labels"), F.col("object_marking_refs")).alias("severity"),
        F.to_json(F.struct(F.col("id").alias("stix_id"), F.col("name").alias("stix_name"),
                           F.col("description").alias("stix_description"),
                           F.col("pattern").alias("stix_pattern"), "labels")).alias("metadata"))


def read_stix_bundle(spark: SparkSession, path: str, source: str = "stix") -> DataFrame:
    return parse_stix_objects(spark.read.schema(_STIX_SCHEMA).option("multiLine", True).json(path)
                              .select(F.inline("objects")), source)


def read_mitre_techniques(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Technique table (technique_id, name, tactic); a short built-in list without a file."""
    if path is None:
        return spark.createDataFrame(fv.FALLBACK_TECHNIQUES, "technique_id STRING, name STRING, tactic STRING")
    schema = "techniques ARRAY<STRUCT<technique_id STRING, name STRING, tactic STRING, description STRING>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("techniques"))


def read_attack_chains(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Chain steps (chain_id, pos, technique_id) from a JSON file or the built-in list."""
    if path is None:
        rows = [(i, chain) for i, chain in enumerate(fv.ATTACK_CHAINS)]
        chains = spark.createDataFrame(rows, "chain_id INT, techniques ARRAY<STRING>")
    else:
        schema = "chains ARRAY<STRUCT<name STRING, techniques ARRAY<STRING>>>"
        chains = spark.read.schema(schema).option("multiLine", True).json(path).select(
            F.posexplode("chains").alias("chain_id", "_c")).select("chain_id", "_c.techniques")
    return chains.select("chain_id", F.posexplode("techniques").alias("pos", "technique_id"))
