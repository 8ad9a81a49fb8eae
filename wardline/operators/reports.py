"""Text, report and state views (P-04, P-06…P-09, P-15…P-19, A-22, T-06, U-*, W-17, W-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.functions.scoring import lookup, payload_get
from wardline.functions.text import decode_powershell
from wardline.operators.segmented import salted_join, segmented_scan, time_segment


# --- projections -----------------------------------------------------------------------
def parse_eventlog(log: DataFrame, code: str = "code", message: str = "message") -> DataFrame:
    """Describe OS log codes; a script block with an encoded command becomes high."""
    c = F.col(code)
    column = lambda i: {k: v[i] for k, v in fv.LOG_CODES.items() if v[i] is not None}
    decoded = F.when(c == 4104, decode_powershell(F.col(message)))
    severity = F.when(F.length(decoded) > 0, "high").otherwise(lookup(c, column(1), "info"))
    return log.select("*", lookup(c, column(0), "Unknown event").alias("log_description"), severity.alias("log_severity"),
                      lookup(c, column(2)).alias("technique_id"), lookup(c, column(3)).alias("technique_name"),
                      decoded.alias("decoded_powershell"))


def parse_trace_events(records: DataFrame, properties: str = "properties") -> DataFrame:
    """Typed events from provider records (provider_name, event_id, process_id, JSON properties)."""
    rows = []
    for provider, (event_id, kind, fields) in fv.TRACE_EVENTS.items():
        data = F.to_json(F.struct(*[payload_get(F.col(properties), src, "").alias(dst) for src, dst in fields.items()],
                                  F.col("process_id").alias("pid")))
        rows.append(F.when((F.col("provider_name") == provider) & (F.col("event_id") == event_id),
                           F.struct(F.lit(kind).alias("event_type"), data.alias("data"))))
    return records.withColumn("_t", F.coalesce(*rows)).where("_t IS NOT NULL").select(
        *records.columns, F.lit("etw").alias("sensor"), F.lit("info").alias("severity"), "_t.event_type", "_t.data")


def timeline_context(events: DataFrame) -> DataFrame:
    """Process fields only on process rows, network fields only on network rows."""
    proc = F.struct("pid", "name", F.col("ppid").alias("parent_pid"), "cmdline")
    net = F.struct("remote_ip", "remote_port", "protocol", "domain")
    return events.withColumn("process_context", F.when(F.col("sensor") == "process", proc)) \
        .withColumn("network_context", F.when(F.col("sensor") == "network", net))


def timeline_summary(sensor: Column, event_type: Column, name: Column, pid: Column, ppid: Column,
                     ip: Column, port: Column, domain: Column, path: Column) -> Column:
    """One line about an event."""
    or_ = lambda c, d: F.coalesce(c.cast("string"), F.lit(d))
    who = F.format_string("%s (pid=%s)", or_(name, "unknown"), or_(pid, "?"))
    return (F.when((sensor == "process") & (event_type == "process_new"),
                   F.when(ppid.isNotNull(), F.concat(who, F.lit(" spawned by parent_pid="), ppid.cast("string")))
                   .otherwise(F.concat(who, F.lit(" started"))))
            .when((sensor == "network") & (event_type == "connection"),
                  F.format_string("Connection to %s:%s", or_(ip, "?"), or_(port, "?")))
            .when((sensor == "network") & (event_type == "dns_query"), F.concat(F.lit("DNS query for "), or_(domain, "?")))
            .when(sensor == "file", F.format_string("File %s: %s", event_type, or_(path, "?")))
            .otherwise(F.concat_ws("/", sensor, event_type)))


def build_timeline(events: DataFrame) -> DataFrame:
    """Events in time order with technique, context, summary and causal parent."""
    from wardline.functions.scoring import infer_technique
    from wardline.operators.joins import timeline_causality

    c = F.col
    parents = timeline_causality(events).select("event_id", "parent_event_id")
    rows = timeline_context(events).withColumn("technique", infer_technique(c("name"), c("event_type"))).withColumn(
        "summary", timeline_summary(c("sensor"), c("event_type"), c("name"), c("pid"), c("ppid"), c("remote_ip"),
                                    c("remote_port"), c("domain"), c("path")))
    return rows.join(parents, "event_id", "left").select(
        "event_id", "ts_us", "seq", "sensor", "event_type", "severity", "technique", "summary", "process_context",
        "network_context", "parent_event_id").orderBy("ts_us", "seq")


def usb_ids(device_id: Column) -> Column:
    """STRUCT vendor, product (upper case) and serial of a device path."""
    rx = r"(?i)VID_([0-9A-F]{4})&PID_([0-9A-F]{4})"
    parts = F.split(F.replace(device_id, F.lit("/"), F.lit("\\")), r"\\")
    last = F.element_at(parts, -1)
    return F.struct(F.upper(F.regexp_extract(device_id, rx, 1)).alias("vendor_id"),
                    F.upper(F.regexp_extract(device_id, rx, 2)).alias("product_id"),
                    F.when((F.size(parts) >= 3) & ~last.startswith("&"), last).otherwise("").alias("serial"))


EXPLANATIONS = [  # alert_type, sensor, severity, text; blank = any.  Sites add their own rows.
    ("dns_tunneling", "", "", "{title}: {description}. Data may be leaving inside DNS names. {severity}, {pct}%.\n{actions}"),
    ("brute_force", "", "", "{title}: {description}. Someone may be guessing passwords. {severity}, {pct}%.\n{actions}"),
    ("", "network", "critical", "{title}: {description}. Traffic that needs an answer now. {severity}, {pct}%.\n{actions}"),
    ("", "network", "high", "{title}: {description}. Traffic worth a close look. {severity}, {pct}%.\n{actions}"),
    ("", "process", "critical", "{title}: {description}. A program acts like malware. {severity}, {pct}%.\n{actions}"),
    ("", "process", "high", "{title}: {description}. A program acts oddly. {severity}, {pct}%.\n{actions}"),
    ("", "", "", "{title}: {description}. Sensor {sensor}, {severity}, {pct}%.\n{actions}"),
]
DEFAULT_ACTION = "  - Review the alert details and investigate further."


def _fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def explain_alerts(alerts: DataFrame, templates: list[tuple] | None = None) -> DataFrame:
    """Fill the most specific text: by alert type, else by sensor and severity, else the fallback."""
    rows = EXPLANATIONS if templates is None else templates
    tier = lambda test: [t for t in rows if test(t)]
    arms = [F.when(F.col("alert_type") == t[0], F.lit(t[3])) for t in tier(lambda t: t[0])]
    arms += [F.when((F.col("sensor") == t[1]) & (F.col("severity") == t[2]), F.lit(t[3]))
             for t in tier(lambda t: not t[0] and t[1])]
    arms += [F.lit(t[3]) for t in tier(lambda t: not t[0] and not t[1])]
    actions = F.array_join(F.transform("recommended_actions", lambda a: F.concat(F.lit("  - "), a)), "\n")
    text = _fill(F.coalesce(*arms), {
        "title": F.col("title"), "description": F.col("description"), "sensor": F.col("sensor"),
        "severity": F.upper("severity"), "pct": F.round(F.col("confidence") * 100, 1),
        "actions": F.when(F.size("recommended_actions") > 0, actions).otherwise(DEFAULT_ACTION)})
    return alerts.withColumn("explanation", text)


CHAIN_TEXT = {  # chain → what happened, actions
    "drive_by_download": ("A browser fetched a program that was then run.", ["Isolate the host.", "Remove the file."]),
    "credential_theft": ("A program read stored credentials and went online.", ["Stop the process.", "Rotate credentials."]),
    "ransomware": ("A program changed many files at once.", ["Disconnect the host.", "Restore from backup."]),
    "persistence_installation": ("A program made itself start with the system.", ["Remove the entry.", "Quarantine the file."]),
    "fileless_attack": ("An encoded script went online without a file.", ["Stop the process tree.", "Block the address."]),
    "lateral_movement": ("Failed logons, a success and a new service.", ["Lock the account.", "Audit new services."]),
    "data_exfiltration": ("Many files were read and data left the host.", ["Block the address.", "Assess the data."]),
    "dll_injection": ("Code was placed in another process.", ["Stop both processes.", "Scan the injector."]),
}
OTHER_CHAIN = ("A pattern of events matched.", ["Investigate.", "Isolate if confirmed.", "Escalate."])


def narrate_chains(matches: DataFrame, texts: dict | None = None) -> DataFrame:
    """Narrative of chain matches (chain_name, severity, confidence, mitre_ids, matched_nodes, description)."""
    table = CHAIN_TEXT if texts is None else texts
    lead = lookup(F.col("chain_name"), {k: v[0] for k, v in table.items()}, OTHER_CHAIN[0])
    steps = lookup(F.col("chain_name"), {k: "\n".join(f"  - {a}" for a in v[1]) for k, v in table.items()},
                   "\n".join(f"  - {a}" for a in OTHER_CHAIN[1]))
    mitre = F.when(F.size("mitre_ids") > 0, F.array_join("mitre_ids", ", ")).otherwise("N/A")
    return matches.withColumn("narrative", F.concat_ws("\n", F.concat(F.lit("ATTACK DETECTED: "), "chain_name"), F.concat(
        F.lit("Severity: "), "severity", F.lit(" | Confidence: "), F.round(F.col("confidence") * 100, 1).cast("string"), F.lit("%")),
        lead, "description", F.concat(F.lit("MITRE ATT&CK: "), mitre),
        F.concat(F.lit("Matched entities: "), F.size("matched_nodes").cast("string")), steps))


def triage_alerts(alerts: DataFrame) -> DataFrame:
    """Assessment, steps and false-positive prior by severity, with a one-line narrative."""
    s = F.col("severity")
    mitre = F.when(F.size("mitre_ids") > 0, F.array_join("mitre_ids", ", ")).otherwise("none")
    pct = F.bround(F.col("confidence") * 100, 0).cast("int")
    steps = lookup(s, {k: "\n".join(v[1]) for k, v in fv.TRIAGE.items()}, "Review alert details")
    return alerts.withColumn("severity_assessment", lookup(s, {k: v[0] for k, v in fv.TRIAGE.items()}, "Unknown severity")) \
        .withColumn("investigation_steps", F.split(steps, "\n")) \
        .withColumn("fp_likelihood", lookup(s, {k: v[2] for k, v in fv.TRIAGE.items()}, 0.5)) \
        .withColumn("narrative", F.format_string("%s: %s (confidence %d%%, MITRE: %s)", "title", "description", pct, mitre))


def summarize_incident(incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """Summary of each incident as numbered text lines, one row per line.

    Lines stay rows, so an incident with very many alerts is never one string.
    """
    counts = alerts.groupBy("incident_id").agg(F.count(F.lit(1)).alias("_n"))
    head = incidents.join(counts, "incident_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    lines = F.array(
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.concat(F.lit("Incident Summary: "), "title").alias("line")),
        F.struct(F.lit(2).cast("bigint").alias("line_no"), F.concat(F.lit("Severity: "), "severity").alias("line")),
        F.struct(F.lit(3).cast("bigint").alias("line_no"), F.concat(F.lit("Related alerts: "), F.col("_n").cast("string")).alias("line")),
        F.struct((F.col("_n") + 4).alias("line_no"), F.lit("Recommendation: review related alerts and determine scope.").alias("line")))
    frame = head.select("incident_id", F.inline(lines))
    numbered = segmented_scan(alerts, ["incident_id"], time_segment(F.col("ts_us")), ["ts_us", "seq"], {"_i": ("count", F.lit(1))})
    body = numbered.select("incident_id", (F.col("_i") + 3).alias("line_no"),
                           F.format_string("  %d. [%s] %s", "_i", "severity", "title").alias("line"))
    return frame.unionByName(body)


# --- audit and reports -------------------------------------------------------------------
def audit_query(audit: DataFrame, log_type: str | None = None, since_us: int | None = None, limit: int = 100) -> DataFrame:
    """Newest audit entries of a type; unreadable detail is kept as raw text.  Filters precede the limit."""
    rows = audit_entries(audit)
    if log_type is not None:
        rows = rows.where(F.col("log_type") == log_type)
    if since_us is not None:
        rows = rows.where(F.col("ts_us") >= since_us)
    return rows.orderBy(F.desc("ts_us"), F.desc("log_id")).limit(limit)


def audit_entries(audit: DataFrame) -> DataFrame:
    parsed = F.try_parse_json("detail")
    readable = parsed.isNotNull()
    return audit.select(
        "log_id", "ts_us", F.col("component").alias("source"), F.coalesce(F.get_json_object("detail", "$.log_type"), F.col("action")).alias("log_type"),
        F.coalesce(F.get_json_object("detail", "$.severity"), F.lit("info")).alias("severity"),
        F.when(readable, F.col("detail")).alias("details"), F.when(~readable, F.col("detail")).alias("raw"))


def incident_report(audit: DataFrame, techniques: DataFrame | None = None) -> DataFrame:
    """One row of report totals; lists are in ``report_techniques`` and ``report_iocs``."""
    e = audit_entries(audit)
    kind = F.col("log_type")
    known = report_techniques(audit).agg(F.count(F.lit(1)).alias("n"))
    totals = e.agg(F.count(F.lit(1)).alias("total_events"), F.count_if(kind == "alert").alias("total_alerts"),
                   F.count_if(kind == "action_result").alias("total_actions"), F.min("ts_us").alias("start_us"),
                   F.max("ts_us").alias("end_us"), F.lit(0).cast("bigint").alias("n_techniques"))
    rows = totals.unionByName(known.select(
        F.lit(0).cast("bigint").alias("total_events"), F.lit(0).cast("bigint").alias("total_alerts"), F.lit(0).cast("bigint").alias("total_actions"),
        F.lit(None).cast("bigint").alias("start_us"), F.lit(None).cast("bigint").alias("end_us"), F.col("n").alias("n_techniques")))
    one = rows.agg(*[F.sum(c).alias(c) for c in ("total_events", "total_alerts", "total_actions", "n_techniques")],
                   F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    part = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    parts = F.concat_ws(". ", part("total_alerts", " alert(s) generated"), part("total_actions", " response action(s) taken"),
                        part("n_techniques", " MITRE ATT&CK technique(s) observed"))
    return one.withColumn("summary", F.when(F.length(parts) > 0, F.concat(parts, F.lit(".")))
                          .otherwise("No security events recorded in this period."))


def report_techniques(audit: DataFrame) -> DataFrame:
    ids = F.from_json(F.get_json_object("details", "$.mitre_ids"), "ARRAY<STRING>")
    return audit_entries(audit).where("log_type = 'alert'").select(F.explode(ids).alias("technique_id")).distinct()


def report_iocs(audit: DataFrame) -> DataFrame:
    """Indicators named by alerts: targets of ip/network alerts, domains in dns/url titles."""
    a = audit_entries(audit).where("log_type = 'alert'").select(
        *[F.coalesce(F.get_json_object("details", f"$.{k}"), F.lit("")).alias(k) for k in ("alert_type", "target", "title")])
    kind = F.col("alert_type")
    name = F.trim(F.element_at(F.split("title", ":"), -1))
    pairs = F.array_compact(F.array(
        F.when((kind.contains("ip") | kind.contains("network")) & (F.length("target") > 0),
               F.struct(F.lit("ip").alias("type"), F.col("target").alias("value"))),
        F.when((kind.contains("dns") | kind.contains("url")) & F.col("title").contains(":") & (F.length(name) > 0),
               F.struct(F.lit("domain").alias("type"), name.alias("value")))))
    return a.select(F.inline(pairs)).distinct()


# --- state ---------------------------------------------------------------------------------
def apply_alert_status(alerts: DataFrame, status_events: DataFrame) -> DataFrame:
    """Alerts with the newest status that was set."""
    now = status_events.where(F.col("new_status").isin(*fv.ALERT_STATUSES)).groupBy("alert_id").agg(
        F.max(F.struct("set_us", "new_status"))["new_status"].alias("_now"))
    return alerts.join(now, "alert_id", "left").withColumn("status", F.coalesce("_now", "status")).drop("_now")


def retain(df: DataFrame, as_of_us: int, days: int, ts: str = "ts_us") -> DataFrame:
    """Rows not older than the retention period; on day-partitioned files it prunes partitions."""
    return df.where(F.col(ts) >= as_of_us - days * 86_400_000_000)


def whitelist_current(entries: DataFrame, as_of_us: int) -> DataFrame:
    return entries.where(F.col("enabled") & ((F.col("expires_us") == 0) | (F.col("expires_us") > as_of_us)))


def execution_state(executions: DataFrame, step_log: DataFrame) -> DataFrame:
    """Current step and status of executions from a log of step states.

    Aborted executions skip their pending steps; others complete when no step is left.
    """
    latest = step_log.groupBy("execution_id", "step_index").agg(
        F.max(F.struct("ts_us", "tie", "status"))["status"].alias("step_status"))
    joined = latest.join(executions.select("execution_id", "status"), "execution_id")
    step = F.when((F.col("status") == "aborted") & (F.col("step_status") == "pending"), "skipped").otherwise(F.col("step_status"))
    done = F.col("_s").isin("executed", "skipped", "failed")
    return joined.withColumn("_s", step).groupBy("execution_id").agg(
        F.when(F.max("status") == "aborted", "aborted").when(F.bool_and(done), "completed").otherwise("running").alias("state"),
        F.min(F.when(~done, F.col("step_index"))).alias("current_step"),
        F.count_if(F.col("_s") == "skipped").alias("n_skipped"), F.count(F.lit(1)).alias("n_steps"))


def close_stale_incidents(incidents: DataFrame, as_of_us: int, max_age_us: int = 600_000_000) -> DataFrame:
    stale = (F.col("status") == "open") & (F.col("last_us") > 0) & (F.lit(as_of_us) - F.col("last_us") > max_age_us)
    return incidents.withColumn("status", F.when(stale, "closed").otherwise(F.col("status")))


def close_incident(incidents: DataFrame, requests: DataFrame) -> DataFrame:
    """Close the open incidents named in a request table."""
    asked = requests.select("incident_id").distinct().withColumn("_asked", F.lit(True))
    out = incidents.join(asked, "incident_id", "left")
    return out.withColumn("status", F.when(F.col("_asked") & (F.col("status") == "open"), "closed").otherwise(F.col("status"))).drop("_asked")


def rolling_window(df: DataFrame, keys: list[str], width_us: int = 600_000_000) -> DataFrame:
    """Rows within the width before the newest row of their series."""
    newest = df.groupBy(*keys).agg(F.max("ts_us").alias("_max"))
    return salted_join(df, newest, keys, "inner").where(F.col("ts_us") >= F.col("_max") - width_us).drop("_max")
