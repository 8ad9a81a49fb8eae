"""Table schemas as DDL strings."""

EVENTS = ("event_id STRING, ts TIMESTAMP, host STRING, sensor STRING, event_type STRING, "
          "severity STRING, data STRING")
ALERTS = ("alert_id STRING, event_id STRING, ts TIMESTAMP, host STRING, sensor STRING, alert_type STRING, "
          "severity STRING, title STRING, description STRING, confidence DOUBLE, status STRING, data STRING, "
          "mitre_ids ARRAY<STRING>, recommended_actions ARRAY<STRING>, priority_score DOUBLE, dismiss_count INT")
IOC = ("ioc_type STRING, value STRING, source STRING, severity STRING, first_us BIGINT, updated_us BIGINT, "
       "metadata STRING")
WHITELIST = ("entry_id STRING, entry_type STRING, value STRING, reason STRING, added_by STRING, "
             "added_us BIGINT, expires_us BIGINT, enabled BOOLEAN")
AUDIT = "ts TIMESTAMP, component STRING, action STRING, detail STRING"

# keys a sensor payload may use for the same thing
PAYLOAD_KEYS = {
    "pid": ["pid", "process_id"],
    "ppid": ["ppid", "parent_pid"],
    "name": ["name", "process_name"],
    "exe": ["exe", "process_path"],
    "cmdline": ["cmdline", "command_line"],
    "path": ["path", "file_path"],
    "remote_ip": ["dst_ip", "remote_ip", "remote_addr"],
    "remote_port": ["dst_port", "remote_port"],
    "domain": ["domain", "query_name", "hostname"],
    "user": ["user", "username"],
    "status": ["status"],
    "direction": ["direction"],
    "bytes_sent": ["bytes_sent"],
    "parent_name": ["parent_name"],
    "is_signed": ["is_signed"],
}
NUMERIC_KEYS = {"pid": "BIGINT", "ppid": "BIGINT", "remote_port": "INT", "bytes_sent": "BIGINT", "is_signed": "INT"}
