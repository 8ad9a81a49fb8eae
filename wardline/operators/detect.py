"""Composite detections (C-01…C-09, M-09): findings of many detectors as one alert table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.functions import names
from wardline.functions.scoring import lookup, priority
from wardline.operators import rules
from wardline.operators.joins import ioc_lookup, ja3_blacklist_hits, playbook_steps, playbook_triggers
from wardline.operators.snapshots import union_alerts
from wardline.operators.windows import beacon_alerts, dedup_alerts, prediction_table, query_rate_60s
from wardline.operators.segmented import dimension_join
from wardline.session import checkpoint_folder


def make_alert(df: DataFrame, alert_type: Column, title: Column, severity: Column, confidence: Column, engine: str,
               mitre_ids: Column | None = None) -> DataFrame:
    """Uniform alert rows; the id is a hash of event, type and engine, so reruns agree."""
    no_ids = F.array().cast("array<string>")
    return df.select(
        F.concat(F.lit("alt-"), F.sha2(F.concat_ws("|", "event_id", alert_type, F.lit(engine)), 256)).alias("alert_id"),
        "event_id", "ts_us", "seq", "host", "sensor", alert_type.alias("alert_type"), severity.alias("severity"), title.alias("title"),
        F.concat(F.lit(f"Detected by {engine} at "), F.round(F.col("ts_us") / 1e6).cast("bigint").cast("string")).alias("description"),
        confidence.cast("double").alias("confidence"), F.lit("new").alias("status"), F.lit(engine).alias("engine"),
        (no_ids if mitre_ids is None else mitre_ids).alias("mitre_ids"))


def dns_threats(queries: DataFrame, iocs: DataFrame | None = None) -> DataFrame:
    """First DNS threat of each query: known, tunnel, generated name, resolver bypass, suspicious suffix."""
    q = query_rate_60s(queries.withColumn("_base", names.base_domain(F.col("domain"))), ["_base"])
    if iocs is not None:
        q = ioc_lookup(q, "domain", iocs)
    else:
        q = q.withColumn("ioc_source", F.lit(None).cast("string"))
    q = q.withColumn("_tunnel", names.tunnel_confidence(F.col("domain"), F.col("rate"))).withColumn("_dga", names.dga_confidence(F.col("_base")))
    found = F.coalesce(F.when(F.col("ioc_source").isNotNull(), _threat("known_malicious", F.lit(0.95))), _own_dns_threat())
    return q.withColumn("_t", found).where("_t IS NOT NULL").withColumn("threat", F.col("_t.threat")).withColumn("confidence", F.col("_t.confidence")).drop("_t")


def _threat(name: str, confidence: Column) -> Column:
    return F.struct(F.lit(name).alias("threat"), confidence.cast("double").alias("confidence"))


def _own_dns_threat() -> Column:
    """What a query tells by itself, from the columns _tunnel and _dga and those of the query."""
    return F.coalesce(
        F.when(F.col("_tunnel") >= 0.6, _threat("tunneling", F.least(F.col("_tunnel"), F.lit(1.0)))),
        F.when(F.col("_dga") >= 0.6, _threat("dga", F.col("_dga"))),
        F.when(rules.doh_evasion(F.col("remote_ip"), F.col("remote_port"), F.col("name")), _threat("doh_evasion", F.lit(0.8))),
        F.when(names.suspicious_tld(F.col("domain")), _threat("suspicious_tld", F.lit(0.4))))


def dns_alerts(queries: DataFrame, iocs: DataFrame | None = None) -> DataFrame:
    hits = dns_threats(queries, iocs)
    ids = F.coalesce(*[F.when(F.col("threat") == t, F.array(*map(F.lit, m)).cast("array<string>")) for t, (_, m) in fv.DNS_THREATS.items()])
    title = F.concat(F.lit("DNS threat: "), "threat", F.lit(" — "), F.col("domain"))
    return make_alert(hits, F.concat(F.lit("dns_"), "threat"), title, lookup(F.col("threat"), {t: s for t, (s, _) in fv.DNS_THREATS.items()}),
                      F.col("confidence"), "dns_analyzer", ids)


def cert_anomalies(handshakes: DataFrame) -> DataFrame:
    """Handshakes whose certificate scores over 0.5."""
    c = F.col
    score = rules.cert_anomaly_score(c("issuer"), c("subject"), c("validity_days"), c("has_san"), c("key_type"), c("key_bits"))
    return handshakes.where("issuer IS NOT NULL").withColumn("cert_score", score).where("cert_score > 0.5")


def encrypted_traffic(events: DataFrame, ja3_blacklist: DataFrame) -> DataFrame:
    """Fingerprint, certificate and beacon alerts on handshakes; beacons also on HTTP requests."""
    tls = events.where("event_type = 'etw.tls_handshake'")
    ids = F.array(F.lit("T1071.001"), F.lit("T1573"))
    server = F.coalesce("server_name", F.lit("unknown"))
    ja3 = make_alert(ja3_blacklist_hits(tls, ja3_blacklist), F.lit("encrypted_traffic_malicious_ja3"), F.concat(F.lit("Malicious JA3 fingerprint: "), server),
                     F.lit("high"), F.lit(0.9), "encrypted_traffic", ids)
    cert = make_alert(cert_anomalies(tls), F.lit("encrypted_traffic_cert_anomaly"), F.concat(F.lit("Anomalous certificate: "), server), F.lit("medium"),
                      F.col("cert_score"), "encrypted_traffic", F.array(F.lit("T1587.003"), F.lit("T1553.004")))
    http_host = names.url_parts(F.col("url"))["host"]
    contacts = events.where(F.col("event_type").isin("etw.tls_handshake", "etw.http_request")).select(
        "host", F.col("server_name"), F.coalesce("destination", F.when(F.col("url").isNotNull(), http_host)).alias("destination"), "ts_us", "seq")
    beacon = beacon_alerts(contacts).withColumn("title", F.concat(F.lit("C2 beacon detected: "), "dest")).withColumn("engine", F.lit("encrypted_traffic")) \
        .withColumn("mitre_ids", ids).withColumn("alert_id", F.concat(F.lit("alt-"), F.sha2(F.concat_ws("|", "host", "dest", F.lit("beacon")), 256)))
    return union_alerts(ja3, cert, beacon.drop("n_events", "median_interval", "dest"))


def fileless(events: DataFrame) -> DataFrame:
    """Script, assembly, WMI and system-binary findings, dispatched by event type."""
    ps = rules.powershell_obfuscation(events.where("event_type = 'etw.powershell_scriptblock' AND length(script_text) > 0"), "script_text").where("is_obfuscated")
    lits = lambda *v: F.array(*map(F.lit, v))
    script = make_alert(ps, F.lit("fileless_powershell_obfuscation"), F.lit("Obfuscated PowerShell script detected"), F.lit("high"),
                        F.greatest("confidence", F.lit(0.5)), "fileless", lits("T1027", "T1059.001"))
    net = make_alert(rules.dotnet_injection(events.where("event_type = 'etw.dotnet_assembly_load'")), F.lit("fileless_dotnet_injection"),
                     F.lit("In-memory .NET assembly load detected"), F.lit("high"), F.lit(0.7), "fileless", lits("T1055"))
    wmi = make_alert(rules.wmi_namespace_persistence(events.where("event_type = 'etw.wmi_activity'")), F.lit("fileless_wmi_persistence"),
                     F.lit("WMI persistence namespace activity"), F.lit("high"), F.lit(0.75), "fileless", lits("T1546.003"))
    found = rules.lolbin_findings(events.where("event_type = 'process_new'"))
    lol = make_alert(found, F.lit("fileless_lolbin_abuse"), F.concat(F.lit("LOLBin abuse: "), "finding"), F.col("finding_severity"), F.col("confidence"),
                     "fileless", F.array("mitre_id"))
    # two checks of one event differ by their rule
    lol = lol.withColumn("alert_id", F.concat("alert_id", F.lit("-"), F.sha2("title", 256)))
    return union_alerts(script, net, wmi, lol)


def rule_alerts(events: DataFrame, rule_set: list[dict] | None = None) -> DataFrame:
    """Alert of the first rule that matches each event."""
    hits = rules.apply_rules(events, rule_set, first_only=True)
    return make_alert(hits, F.concat(F.lit("rule_"), "rule_id"), F.col("rule_id"), F.col("rule_severity"), F.lit(0.95), "rule_engine", F.col("rule_mitre"))


def anomaly_cascade(scored: DataFrame, verifier: bool = True) -> DataFrame:
    """Alerts from anomaly scores; anomalous rows need the verifier's consent (``verified``) when there is one."""
    c, ok = F.col("score"), F.col("verified") if verifier else F.lit(False)
    suspicious, anomalous = (c >= 0.4) & (c < 0.6), c >= 0.6
    rows = scored.where(suspicious | (anomalous & (ok if verifier else F.lit(True))))
    confirmed = anomalous & ok
    return make_alert(rows, F.when(confirmed, "confirmed_anomaly").otherwise("statistical_anomaly"),
                      F.when(confirmed, "Confirmed anomaly detected").when(anomalous, "Anomalous activity detected").otherwise("Suspicious activity detected"),
                      F.when(anomalous, "high").otherwise("medium"),
                      F.round(F.when(confirmed, F.least(c + 0.1, F.lit(1.0))).otherwise(c), 3), "isolation_forest")


def url_alerts(predictions: DataFrame) -> DataFrame:
    """Alerts of URLs classified as malicious or suspicious (columns url, label, confidence)."""
    hits = predictions.where("label <> 'benign'")
    return make_alert(hits, F.concat(F.lit("url_"), "label"), F.concat(F.initcap("label"), F.lit(" URL detected: "), F.col("url")),
                      F.when(F.col("label") == "malicious", "high").otherwise("medium"), F.round("confidence", 3), "url_classifier")


def chain_alerts(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Critical alerts of graph chains, at the event of the chain's lead node."""
    lead = nodes.select("node_id", "event_id", "ts_us", "seq", "sensor")
    hits = matches.select("host", "node_id", "chain_name", "confidence", "mitre_ids").join(lead, "node_id")
    return make_alert(hits, F.concat(F.lit("chain_"), "chain_name"), F.concat(F.lit("Attack chain detected: "), "chain_name"), F.lit("critical"),
                      F.round("confidence", 3), "graph_analyzer", F.col("mitre_ids"))


def with_predictions(alerts: DataFrame, chains: DataFrame) -> DataFrame:
    """Alerts with the likely next techniques of their last known one."""
    table = prediction_table(chains).groupBy("technique_id").agg(  # at most five per technique
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "next_technique", "probability"))),
                    lambda s: F.struct(s["next_technique"].alias("technique_id"), s["probability"].alias("probability"))).alias("predictions"))
    last = alerts.withColumn("technique_id", F.try_element_at("mitre_ids", F.lit(-1)))
    return dimension_join(last, table, ["technique_id"], "left").drop("technique_id")


def detect(*alert_tables: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Alert tables as one, with the likely next techniques of the last known one."""
    alerts = union_alerts(*alert_tables)
    return alerts if chains is None else with_predictions(alerts, chains)


# --- C-06: all stages over one scan -----------------------------------------------------------------
FINDING = "struct<alert_type:string,title:string,severity:string,confidence:double,engine:string,mitre_ids:array<string>>"
IMAGE_LOAD = "etw.process_image_load"


def _struct(alert_type: Column, title: Column, severity: Column, confidence: Column, engine: Column, mitre: Column | None = None) -> Column:
    ids = F.array() if mitre is None else mitre
    return F.struct(alert_type.alias("alert_type"), title.alias("title"), severity.alias("severity"), confidence.cast("double").alias("confidence"),
                    engine.alias("engine"), ids.cast("array<string>").alias("mitre_ids"))


def _known(df: DataFrame, stage: str, key: Column, finding: Column, detail: Column | None = None) -> DataFrame:
    """Findings that were made elsewhere, to be met by key; ``detail`` tells several of one key apart."""
    return df.select(F.lit(stage).alias("stage"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"), finding.alias("known"))


def url_findings(predictions: DataFrame) -> DataFrame:
    """From url, label, confidence (a URL is predicted once)."""
    return _known(predictions.where("label <> 'benign'"), "url", F.col("url"), _struct(
        F.concat(F.lit("url_"), "label"), F.concat(F.initcap("label"), F.lit(" URL detected: "), F.col("url")),
        F.when(F.col("label") == "malicious", "high").otherwise("medium"), F.round("confidence", 3), F.lit("url_classifier")))


def memory_alert_findings(findings: DataFrame) -> DataFrame:
    """From ``memory_findings``; met by image loads of the process."""
    return _known(findings, "memory", F.col("pid"), _struct(
        F.col("finding"), F.concat(F.lit("Memory forensics: "), "finding"), F.col("severity"), F.col("confidence"), F.lit("memory_forensics"), F.array("mitre_id")),
        F.concat_ws(":", "finding", "address", "size"))


def content_findings(matches: DataFrame) -> DataFrame:
    """From signature matches (path, rule, severity, mitre); met by created and modified files."""
    return _known(matches, "content", F.col("path"), _struct(
        F.concat(F.lit("yara_"), "rule"), F.concat(F.lit("Content match: "), "rule"), F.coalesce("severity", F.lit("high")), F.lit(0.9), F.lit("yara_scanner"),
        F.array_compact(F.array("mitre"))), F.col("rule"))


def chain_findings(matches: DataFrame) -> DataFrame:
    """From ``attack_chains``; met by the event of the chain's lead node."""
    return _known(matches, "chain", F.col("node_id"), _struct(
        F.concat(F.lit("chain_"), "chain_name"), F.concat(F.lit("Attack chain detected: "), "chain_name"), F.lit("critical"), F.round("confidence", 3),
        F.lit("graph_analyzer"), F.col("mitre_ids")), F.concat_ws(":", "chain_name", "target_id"))


def domain_findings(iocs: DataFrame) -> DataFrame:
    """From the indicators of any type; met by the queried domain."""
    severity, ids = fv.DNS_THREATS["known_malicious"]
    return _known(iocs.select("value").distinct(), "dns", F.col("value"), _struct(
        F.lit("dns_known_malicious"), F.concat(F.lit("DNS threat: known_malicious — "), "value"), F.lit(severity), F.lit(0.95), F.lit("dns_analyzer"), F.array(*map(F.lit, ids))))


def pattern_findings(patterns: DataFrame) -> DataFrame:
    """From temporal patterns (event_id, description, confidence)."""
    return _known(patterns, "pattern", F.col("event_id"), _struct(
        F.lit("temporal_pattern"), F.coalesce("description", F.lit("Temporal pattern detected")), F.lit("high"), F.coalesce("confidence", F.lit(0.75)), F.lit("lstm_analyzer")))


def _stages(columns: set[str], rule_set: list[dict] | None, verifier: bool) -> list[Column]:
    """One struct (stage, key, own) per stage; NULL where an event has no part in it."""
    stage = lambda name, use, key=None, own=None: F.when(use, F.struct(
        F.lit(name).alias("stage"), (F.lit(None) if key is None else key).cast("string").alias("key"), (F.lit(None) if own is None else own).cast(FINDING).alias("own")))
    c = F.col
    out = []
    first = rules.first_rule(columns, rule_set)
    ruled = _struct(F.concat(F.lit("rule_"), first["rule_id"]), first["rule_id"], first["rule_severity"], F.lit(0.95), F.lit("rule_engine"), first["rule_mitre"])
    out.append(stage("rule", first.isNotNull(), own=ruled))
    if "score" in columns:
        anomalous = c("score") >= 0.6
        confirmed = anomalous & F.coalesce(c("verified"), F.lit(False)) if verifier else F.lit(False)
        use = ((c("score") >= 0.4) & ~anomalous) | (confirmed if verifier else anomalous)
        out.append(stage("cascade", F.coalesce(use, F.lit(False)), own=_struct(
            F.when(confirmed, "confirmed_anomaly").otherwise("statistical_anomaly"),
            F.when(confirmed, "Confirmed anomaly detected").when(anomalous, "Anomalous activity detected").otherwise("Suspicious activity detected"),
            F.when(anomalous, "high").otherwise("medium"), F.round(F.when(confirmed, F.least(c("score") + 0.1, F.lit(1.0))).otherwise(c("score")), 3),
            F.when(confirmed, "autoencoder").otherwise("isolation_forest"))))
    have = [F.nullif(c(n), F.lit("")) for n in ("url", "domain") if n in columns]
    if have:
        out.append(stage("url", F.coalesce(*have).isNotNull(), F.coalesce(*have)))
    if {"domain", "_tunnel", "_dga"} <= columns:
        t = _own_dns_threat()
        ids = F.coalesce(*[F.when(t["threat"] == n, F.array(*map(F.lit, m)).cast("array<string>")) for n, (_, m) in fv.DNS_THREATS.items()])
        own = F.when(t.isNotNull(), _struct(F.concat(F.lit("dns_"), t["threat"]), F.concat(F.lit("DNS threat: "), t["threat"], F.lit(" — "), c("domain")),
                                            lookup(t["threat"], {n: v for n, (v, _) in fv.DNS_THREATS.items()}), t["confidence"], F.lit("dns_analyzer"), ids))
        out.append(stage("dns", (c("event_type") == "dns_query") & c("domain").isNotNull(), c("domain"), own))
    if "pid" in columns:
        out.append(stage("memory", c("event_type") == IMAGE_LOAD, c("pid")))
    if "path" in columns:
        changed = c("change_type").isin("created", "modified") if "change_type" in columns else F.lit(True)
        out.append(stage("content", (c("event_type") == "file_change") & changed, c("path")))
    return [*out, stage("chain", c("event_id").isNotNull(), c("event_id")), stage("pattern", c("event_id").isNotNull(), c("event_id"))]


def dispatch(events: DataFrame, *known: DataFrame, rule_set: list[dict] | None = None, verifier: bool = True, chains: DataFrame | None = None) -> DataFrame:
    """Alerts of all stages over one scan of the events, one row per finding.

    An event is tagged with the stages that concern it and exploded once.  Rules, the anomaly cascade (columns ``score`` and
    ``verified``) and what a DNS query tells by itself (column ``rate``, 0 if absent) are decided in the row.  URLs, known domains, memory,
    content, chains and temporal patterns meet ``known`` findings (``url_findings`` and its kind) by stage and key in one join;
    a stage without given findings costs nothing.  A known domain overrides what the query tells.  With ``chains`` every alert
    gets the likely next techniques of its last one.
    """
    work = events
    if "domain" in events.columns:
        base = names.base_domain(F.col("domain"))
        rate = F.col("rate") if "rate" in events.columns else F.lit(0)
        asked = F.col("event_type") == "dns_query"
        work = work.withColumn("_tunnel", F.when(asked, names.tunnel_confidence(F.col("domain"), rate))).withColumn("_dga", F.when(asked, names.dga_confidence(base)))
    # the findings come from large plans of their own: made once, then read three times
    checkpoint_folder(events.sparkSession)
    facts = reduce(DataFrame.unionByName, known).checkpoint() if known else None
    given = sorted(r[0] for r in facts.select("stage").distinct().collect()) if known else []  # names of stages, eight at most
    concerns = lambda x: x["own"].isNotNull() | (x["key"].isNotNull() & x["stage"].isin(given))
    tags = F.filter(F.array_compact(F.array(*_stages(set(work.columns), rule_set, verifier))), concerns)
    tagged = work.select("event_id", "ts_us", "seq", "host", "sensor", F.explode(tags).alias("_s"))
    tagged = tagged.select("event_id", "ts_us", "seq", "host", "sensor", "_s.stage", "_s.key", "_s.own")
    if known:
        tagged = dimension_join(tagged, facts, ["stage", "key"], "left")
    else:
        tagged = tagged.withColumn("known", F.lit(None).cast(FINDING)).withColumn("detail", F.lit(""))
    found = tagged.withColumn("_f", F.coalesce("known", "own")).where("_f IS NOT NULL").select("*", "_f.*")
    alerts = found.select(
        F.concat(F.lit("alt-"), F.sha2(F.concat_ws("|", "event_id", "alert_type", "engine", F.nullif(F.col("detail"), F.lit(""))), 256)).alias("alert_id"),
        "event_id", "ts_us", "seq", "host", "sensor", "stage", "alert_type", "severity", "title",
        F.concat(F.lit("Detected by "), "engine", F.lit(" at "), F.round(F.col("ts_us") / 1e6).cast("bigint").cast("string")).alias("description"),
        "confidence", F.lit("new").alias("status"), "engine", "mitre_ids")
    return alerts if chains is None else with_predictions(alerts, chains)


def process_alerts(alerts: DataFrame) -> DataFrame:
    """Deduplicated alerts with their run size and priority (the batch form of the alert flow)."""
    return dedup_alerts(alerts).withColumn("priority", priority(F.col("severity"), F.col("confidence")))


def respond(alerts: DataFrame, incidents: DataFrame, data: str = "data", min_alerts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Planned playbook steps per alert and the incidents that are due for a report.  Nothing is executed."""
    due = incidents.where((F.col("alert_count") >= min_alerts) | F.col("severity").isin("high", "critical"))
    return playbook_steps(playbook_triggers(alerts), data=data), due
