"""Canned hunts (H-01…H-24) as SQL over the wide event, alert, indicator, reputation and feedback views."""

from __future__ import annotations

from pyspark.sql import DataFrame

_NEWEST = "ORDER BY ts_us DESC, seq DESC LIMIT"


def _events(where: str, n: int = 50, order: str = "ts_us DESC, seq DESC") -> str:
    return f"SELECT event_id, ts_us, host, sensor, event_type, severity FROM {{events}} WHERE {where} ORDER BY {order} LIMIT {n}"


def _alerts(where: str, n: int) -> str:
    return f"SELECT alert_id, ts_us, sensor, alert_type, severity, status FROM {{alerts}} WHERE {where} {_NEWEST} {n}"


HUNTS: dict[str, str] = {
    "h01_high_severity_alerts": _alerts("severity IN ('high', 'critical')", 50),
    "h02_events_by_sensor": "SELECT sensor, count(*) AS n FROM {events} GROUP BY sensor",
    "h03_reputation_scores": "SELECT address, score FROM {reputation} WHERE score > 70 ORDER BY score DESC, address LIMIT 50",
    "h04_recent_iocs": "SELECT ioc_type, value, source, severity FROM {ioc} ORDER BY updated_us DESC, value LIMIT 50",
    "h05_feedback_summary": "SELECT alert_type, sensor, action, count(*) AS n FROM {feedback} GROUP BY alert_type, sensor, action",
    "h06_outbound_connections": _events("event_type = 'connection' AND direction = 'outbound'"),
    "h07_powershell_executions": _events("lower(cmdline) LIKE '%powershell%'"),
    "h08_failed_logins": _events("event_type = 'auth' AND status = 'failed'", 100),
    "h09_lateral_movement": _events("event_type IN ('smb', 'rdp', 'wmi')"),
    "h11_suspicious_parents": _events(
        "event_type = 'process_create' AND parent_name IN ('cmd.exe', 'powershell.exe', 'wscript.exe', 'cscript.exe', 'mshta.exe')"),
    "h12_large_transfers": _events("event_type = 'connection' AND bytes_sent > 10485760", 50, "bytes_sent DESC, seq DESC"),
    "h13_registry_changes": _events("event_type = 'registry'"),
    "h14_resolved_alerts": "SELECT alert_id, ts_us, severity FROM {alerts} WHERE status = 'resolved' AND ts_us > {as_of} - 86400000000",
    "h15_top_talkers": "SELECT remote_ip, count(*) AS conn_count FROM {events} WHERE event_type = 'connection' "
                       "GROUP BY remote_ip ORDER BY conn_count DESC, remote_ip LIMIT 20",
    "h16_temp_files": _events("event_type = 'file_create' AND contains(path, chr(92) || 'Temp' || chr(92))"),
    "h17_scheduled_tasks": _events("event_type = 'scheduled_task'"),
    "h18_service_installs": _events("event_type = 'service_install'"),
    "h19_alerts_by_severity": "SELECT severity, count(*) AS n FROM {alerts} GROUP BY severity",
    "h20_unsigned_executions": _events("event_type = 'process_create' AND is_signed = 0"),
    "h21_recent_alerts": _alerts("true", 20),
    "h22_critical_alerts": _alerts("severity = 'critical'", 20),
    "h23_high_alerts": _alerts("severity = 'high'", 20),
    "h24_network_alerts": _alerts("sensor = 'network'", 20),
    # the per-domain frequency is an aggregate joined back, not a window over the domain
    "h10_rare_dns": "SELECT e.event_id, e.ts_us, e.host, e.sensor, e.event_type, e.severity FROM {events} e JOIN "
                    "(SELECT domain FROM {events} WHERE event_type = 'dns' GROUP BY domain HAVING count(*) < 10) r "
                    "ON e.domain = r.domain WHERE e.event_type = 'dns' ORDER BY e.ts_us DESC, e.seq DESC LIMIT 50",
}


def hunt(name: str, as_of_us: int = 0, **views: DataFrame) -> DataFrame:
    """Run a canned hunt; pass the views its text names (events, alerts, ioc, reputation, feedback)."""
    text = HUNTS[name].replace("{as_of}", str(as_of_us))
    spark = next(iter(views.values())).sparkSession
    used = {k: v for k, v in views.items() if f"{{{k}}}" in text}
    return spark.sql(text, **used)
