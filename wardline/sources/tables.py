"""Readers of stored events and alerts (SC-01…SC-04, T-01…T-03, T-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import schemas


def latest(df: DataFrame, n: int, ts: str = "ts_us", tie: str = "seq") -> DataFrame:
    """Newest ``n`` rows; ties broken by id.  Plans as TakeOrderedAndProject."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def read_events(events: DataFrame, sensor: str | None = None, since_us: int | None = None, limit: int = 1000) -> DataFrame:
    """Newest events, optionally of one sensor and not before ``since_us``."""
    if sensor is not None:
        events = events.where(F.col("sensor") == sensor)
    if since_us is not None:
        events = events.where(F.col("ts_us") >= since_us)
    return latest(events, limit)


def read_alerts(alerts: DataFrame, status: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    if status is not None:
        alerts = alerts.where(F.col("status") == status)
    if severity is not None:
        alerts = alerts.where(F.col("severity") == severity)
    return latest(alerts, limit)


def row_by_id(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup; the equality reaches the Parquet scan."""
    return df.where(F.col(column) == value)


def recent_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    return latest(alerts, n).select("alert_id", "ts_us", "severity", "title", "sensor", "confidence", "status")


def recent_of_sensor(events: DataFrame, sensor: str, fields: dict[str, tuple[str, str]], n: int = 50) -> DataFrame:
    """Newest rows of a sensor with payload fields pulled out; ``fields`` maps name → (key, default)."""
    return read_events(events, sensor, limit=n).select(
        "event_id", "ts_us", *[F.coalesce(F.col(k).cast("string"), F.lit(d)).alias(name) if k in events.columns
                               else F.coalesce(F.get_json_object("data", f"$.{k}"), F.lit(d)).alias(name)
                               for name, (k, d) in fields.items()])


def top_counts(df: DataFrame, column: str, n: int = 20, name: str = "n") -> DataFrame:
    """Most frequent values; counting is map-side combined, the sort keeps ``n`` rows."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), column).limit(n)


def parse_events(df: DataFrame, column: str = "value") -> DataFrame:
    """Parse wire-format JSON lines; malformed rows keep their text in ``_corrupt``."""
    schema = "event_id STRING, timestamp DOUBLE, host STRING, sensor STRING, event_type STRING, severity STRING, data VARIANT, _corrupt STRING"
    parsed = df.withColumn("_e", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select(
        "_e.event_id", F.timestamp_micros((F.col("_e.timestamp") * 1e6).cast("bigint")).alias("ts"), "_e.host",
        F.lower("_e.sensor").alias("sensor"), "_e.event_type", F.lower("_e.severity").alias("severity"),
        F.to_json("_e.data").alias("data"),
        F.when(F.col("_e._corrupt").isNotNull() | F.col("_e.event_id").isNull() | F.col("_e.timestamp").isNull(),
               F.col(column)).alias("_corrupt"))


def valid_events(parsed: DataFrame) -> DataFrame:
    return parsed.where("_corrupt IS NULL").drop("_corrupt")


def corrupt_events(parsed: DataFrame) -> DataFrame:
    return parsed.where("_corrupt IS NOT NULL").select("_corrupt")


def read_event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Streaming JSON lines from a folder, parsed; route bad rows with ``corrupt_events``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_events(lines)


def normalize_events(events: DataFrame, data: str = "data") -> DataFrame:
    """Flatten the JSON payload and resolve alternative keys to one column each."""
    raw = sorted({k for keys in schemas.PAYLOAD_KEYS.values() for k in keys})
    parsed = events.withColumn("_p", F.from_json(data, ", ".join(f"{k} STRING" for k in raw)))
    out = []
    for name, keys in schemas.PAYLOAD_KEYS.items():
        value = F.coalesce(*[F.nullif(F.col(f"_p.{k}"), F.lit("")) for k in keys])
        out.append((value.try_cast(schemas.NUMERIC_KEYS[name]) if name in schemas.NUMERIC_KEYS else value).alias(name))
    return parsed.select(*events.columns, *out)
