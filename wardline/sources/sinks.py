"""Writers and exports (SK-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as fv


def write_partitioned(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to Parquet partitioned by day (events, alerts)."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def upsert_ioc(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Current indicators: first source and first_seen stay, severity and update time follow the newest row."""
    columns = ["ioc_type", "value", "source", "severity", "first_us", "updated_us"]
    rows = new if old is None else old.select(*columns).unionByName(new.select(*columns))
    oldest, newest = F.struct("first_us", "source"), F.struct("updated_us", "severity")
    return rows.groupBy("ioc_type", "value").agg(
        F.min(oldest)["source"].alias("source"), F.max(newest)["severity"].alias("severity"),
        F.min("first_us").alias("first_us"), F.max("updated_us").alias("updated_us"))


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keyed replace: all new rows and the old rows without a new one."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_timeline_json(timeline: DataFrame, path: str) -> None:
    """Chronological JSON records; a range sort keeps the files in order."""
    timeline.orderBy("ts_us", "seq").write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def stix_pattern(ioc_type: Column, value: Column) -> Column:
    arms = [F.when(ioc_type == kind, F.format_string(text, value)) for kind, text in fv.STIX_EXPORT.items()]
    return F.coalesce(*arms)


def export_stix(iocs: DataFrame, created: str) -> DataFrame:
    """One STIX indicator object (JSON text) per exportable indicator."""
    pattern = stix_pattern(F.col("ioc_type"), F.col("value"))
    return iocs.withColumn("pattern", pattern).where("pattern IS NOT NULL").select(
        "ioc_type", "value", F.to_json(F.struct(
            F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"),
            F.concat(F.lit("indicator--"), F.sha2(F.concat_ws("|", "ioc_type", "value"), 256)).alias("id"),
            F.lit(created).alias("created"), F.lit(created).alias("modified"),
            F.concat(F.lit("IOC: "), F.col("value")).alias("name"), F.col("pattern"),
            F.lit("stix").alias("pattern_type"), F.lit(created).alias("valid_from"),
            F.array(F.lit("malicious-activity")).alias("labels"))).alias("object"))


def export_report_json(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").text(path)


def audit_alerts(alerts: DataFrame) -> DataFrame:
    """Audit rows for raised alerts."""
    detail = F.to_json(F.struct(
        F.lit("alert").alias("log_type"), "alert_id", "alert_type", "severity", "title", "confidence", "sensor", "mitre_ids"))
    return alerts.select("ts_us", F.lit("detection").alias("component"), F.lit("alert_raised").alias("action"), detail.alias("detail"))


def audit_user_actions(actions: DataFrame) -> DataFrame:
    detail = F.to_json(F.struct(F.lit("user_action").alias("log_type"), "alert_id", "action", "user", "reason"))
    return actions.select("ts_us", F.lit("response").alias("component"), F.concat(F.lit("user_"), "action").alias("action"), detail.alias("detail"))


def audit_action_results(results: DataFrame) -> DataFrame:
    detail = F.to_json(F.struct(F.lit("action_result").alias("log_type"), "action_id", "action_type", "success",
                                "message", "target", "approved_by"))
    return results.select("ts_us", F.lit("response").alias("component"), F.lit("action_executed").alias("action"), detail.alias("detail"))


def export_whitelist(entries: DataFrame, path: str, entry_type: str | None = None) -> None:
    rows = entries if entry_type is None else entries.where(F.col("entry_type") == entry_type)
    rows.write.mode("overwrite").json(path)


def import_whitelist(entries: DataFrame) -> DataFrame:
    """Rows of a known type with a value; defaults for the rest."""
    return entries.where(F.col("entry_type").isin(*fv.WHITELIST_TYPES) & F.col("value").isNotNull()).select(
        "entry_type", "value", F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("added_by", F.lit("import")).alias("added_by"),
        F.coalesce("expires_us", F.lit(0)).alias("expires_us"), F.lit(True).alias("enabled"))
