"""Enrichment and context joins (J-01…J-14, J-19, J-22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.functions.scoring import severity_rank
from wardline.operators.segmented import bounded_broadcast, dimension_join, salted_join

NETWORK_KEYS = ["dst_ip", "src_ip", "remote_addr", "remote_ip"]
DNS_KEYS = ["domain", "query_name", "hostname"]
FILE_KEYS = ["sha256", "md5", "sha1"]
INTEL_KEYS = ["dst_ip", "src_ip", "remote_ip", "domain", "query_name", "url", "sha256", "md5"]


def ioc_by_value(iocs: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """One indicator per value: of a preferred type if there is one, else the oldest."""
    rank = F.when(F.col("ioc_type").isin(*(preferred or [""])), 0).otherwise(1)
    best = F.min(F.struct(rank.alias("r"), F.col("first_us"), F.col("ioc_type"), F.col("source"), F.col("severity")))
    return iocs.groupBy("value").agg(best.alias("_b")).select(
        "value", F.col("_b.ioc_type").alias("ioc_type"), F.col("_b.source").alias("source"), F.col("_b.severity").alias("severity"))


def ioc_lookup(df: DataFrame, column: str, iocs: DataFrame, how: str = "left") -> DataFrame:
    """Indicator of a value column; a proven-small table is broadcast, else keys are salted."""
    dim = ioc_by_value(iocs).select(F.col("value").alias(column), "ioc_type", F.col("source").alias("ioc_source"),
                                    F.col("severity").alias("ioc_severity"))
    return dimension_join(df, dim, [column], how)


def enrich_by_keys(events: DataFrame, iocs: DataFrame, keys: list[str], prefix: str, last_wins: bool,
                   id_col: str, preferred: list[str] | None = None, gate: Column | None = None) -> DataFrame:
    """Add ``<prefix>match/_source/_severity`` from the first or last key that hits.

    Every key column is joined by itself: to a broadcast table if a count proves the
    indicators few, else by the salted join.  Rows are never matched through an id, so
    repeated and NULL ids keep their own hits either way.
    """
    keys = [k for k in keys if k in events.columns]
    dim, small = bounded_broadcast(ioc_by_value(iocs, preferred))
    gate = F.lit(True) if gate is None else gate
    names = [f"{prefix}_match", f"{prefix}_source", f"{prefix}_severity"]
    out, hits = events, []
    for i, k in enumerate(keys):
        side = dim.select(F.col("value").alias(f"_k{i}"), F.struct("source", "severity").alias(f"_h{i}"))
        keyed = out.withColumn(f"_k{i}", F.when(gate, F.nullif(F.col(k).cast("string"), F.lit(""))))
        out = keyed.join(side, f"_k{i}", "left") if small else salted_join(keyed, side, [f"_k{i}"], "left")
        hits.append(F.col(f"_h{i}"))
    if not hits:
        return events.select("*", F.lit(False).alias(names[0]), *[F.lit(None).cast("string").alias(n) for n in names[1:]])
    hit = F.coalesce(*(reversed(hits) if last_wins else hits))
    return out.select(*events.columns, hit.isNotNull().alias(names[0]), hit["source"].alias(names[1]), hit["severity"].alias(names[2]))


def enrich_network(events: DataFrame, iocs: DataFrame, id_col: str) -> DataFrame:
    return enrich_by_keys(events, iocs, NETWORK_KEYS, "net_ioc", True, id_col, ["ipv4-addr", "ip"])


def enrich_dns(events: DataFrame, iocs: DataFrame, id_col: str) -> DataFrame:
    return enrich_by_keys(events, iocs, DNS_KEYS, "dns_ioc", True, id_col, ["domain-name", "domain"])


def enrich_file(events: DataFrame, iocs: DataFrame, id_col: str) -> DataFrame:
    """First hit of the hashes; needs a path."""
    paths = [F.length(F.col(c)) > 0 for c in ("path", "file_path") if c in events.columns]
    gate = F.coalesce(reduce(lambda a, b: a | b, paths, F.lit(False)), F.lit(False))
    return enrich_by_keys(events, iocs, FILE_KEYS, "file_ioc", False, id_col, ["hash"], gate)


def enrich_threat_intel(events: DataFrame, iocs: DataFrame, id_col: str) -> DataFrame:
    return enrich_by_keys(events, iocs, INTEL_KEYS, "threat_intel", False, id_col)


def enrich_reputation(events: DataFrame, reputation: DataFrame, column: str = "remote_ip") -> DataFrame:
    dim = reputation.select(F.col("address").alias(column), F.col("score").alias("reputation_score"))
    return dimension_join(events, dim, [column], "left")


def enrich_events(events: DataFrame, iocs: DataFrame, reputation: DataFrame, id_col: str = "event_id") -> DataFrame:
    """All enrichments (C-05), with the combined indicator columns last."""
    out = enrich_file(enrich_dns(enrich_network(events, iocs, id_col), iocs, id_col), iocs, id_col) \
        if any(k in events.columns for k in FILE_KEYS) else enrich_dns(enrich_network(events, iocs, id_col), iocs, id_col)
    out = enrich_reputation(enrich_threat_intel(out, iocs, id_col), reputation)
    # later stages overwrite earlier ones where they hit
    stages = [s for s in ("file", "dns", "net") if f"{s}_ioc_match" in out.columns]
    pick = lambda part: F.coalesce(*[F.when(F.col(f"{s}_ioc_match"), F.col(f"{s}_ioc_{part}")) for s in stages])
    return out.withColumn("ioc_source", pick("source")).withColumn("ioc_severity", pick("severity")).withColumn(
        "ioc_match", F.col("ioc_source").isNotNull())


def ja3_blacklist_hits(handshakes: DataFrame, blacklist: DataFrame, column: str = "ja3_hash") -> DataFrame:
    dim = blacklist.where("ioc_type = 'ja3'").select(F.col("value").alias(column)).distinct()
    return dimension_join(handshakes, dim, [column], "left_semi").withColumn("severity", F.lit("high")).withColumn(
        "confidence", F.lit(0.9))


def mitre_join(alerts: DataFrame, techniques: DataFrame, keep_unknown: bool = True, ids: str = "mitre_ids",
               key: str = "alert_id") -> DataFrame:
    """(alert, position, technique, name, tactic, text) rows; unknown ids are kept or dropped."""
    rows = alerts.select(key, F.posexplode(ids).alias("pos", "technique_id"))
    out = dimension_join(rows, techniques.select("technique_id", "name", "tactic"), ["technique_id"], "left" if keep_unknown else "inner")
    text = F.when(F.col("name").isNotNull(), F.format_string("%s: %s (%s)", "technique_id", "name", "tactic")) \
        .otherwise(F.concat("technique_id", F.lit(": Unknown technique")))
    return out.select(key, "pos", "technique_id", "name", "tactic", text.alias("line"))


def alerts_with_context(alerts: DataFrame, links: DataFrame, executions: DataFrame) -> DataFrame:
    """Alerts with their incident and the status of a running response."""
    incident = links.groupBy("alert_id").agg(F.max("incident_id").alias("incident_id"))
    running = executions.where("status = 'running'").groupBy("alert_id").agg(F.max("status").alias("response_status"))
    return alerts.join(incident, "alert_id", "left").join(running, "alert_id", "left")


def incidents_with_context(incidents: DataFrame, links: DataFrame, executions: DataFrame) -> DataFrame:
    """Incidents with alert count, running responses on those alerts and duration in seconds."""
    running = executions.where("status = 'running'").groupBy("alert_id").agg(F.count(F.lit(1)).alias("_r"))
    per = links.select("incident_id", "alert_id").distinct().join(running, "alert_id", "left").groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("alert_count"), F.coalesce(F.sum("_r"), F.lit(0)).alias("active_responses"))
    return incidents.join(per, "incident_id", "left").select(
        *incidents.columns, F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
        F.coalesce("active_responses", F.lit(0)).alias("active_responses"),
        (F.greatest(F.lit(0), F.col("last_us") - F.col("first_us")) / 1e6).alias("duration_seconds"))


def executions_with_context(executions: DataFrame, steps: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per execution and step with the alert title ('' without an alert)."""
    titles = alerts.select("alert_id", F.col("title").alias("alert_title"))
    joined = salted_join(executions, titles, ["alert_id"], "left")
    return joined.join(steps.select("execution_id", "step_index", F.col("status").alias("step_status")), "execution_id", "left") \
        .withColumn("alert_title", F.coalesce("alert_title", F.lit("")))


# --- J-12, J-13 ---------------------------------------------------------------------------
def _trigger(pb: dict) -> Column:
    test = severity_rank(F.col("severity")) >= fv.SEVERITY_RANK.get(pb["min_severity"], 2)
    if pb["alert_type"]:
        test = test & (F.col("alert_type") == pb["alert_type"])
    if pb["prefix"]:
        test = test & F.col("alert_type").startswith(pb["prefix"])
    if pb["sensor"]:
        test = test & (F.col("sensor") == pb["sensor"])
    return test


def playbook_triggers(alerts: DataFrame, playbooks: list[dict] | None = None) -> DataFrame:
    """(alert, playbook) pairs.  Playbooks are a handful of predicates tested in one pass,
    which needs neither a cross join nor a shuffle."""
    books = [p for p in (fv.PLAYBOOKS if playbooks is None else playbooks) if p["enabled"]]
    hits = F.array_compact(F.array(*[F.when(_trigger(p), F.lit(p["id"])) for p in books]))
    return alerts.withColumn("playbook_id", F.explode(hits))


def _path(path: str, data: str) -> Column:
    parts = [p for p in path.split(".") if p != "alert"]
    if parts and parts[0] == "data":
        return F.get_json_object(data, "$." + ".".join(parts[1:]))
    return F.col(parts[0]).cast("string") if parts else F.lit(None).cast("string")


def _step_condition(condition: str, data: str) -> Column:
    if "!= null" in condition:
        return F.coalesce(F.length(_path(condition.replace("!= null", "").strip(), data)) > 0, F.lit(False))
    if "alert.severity ==" in condition:
        return F.col("severity") == condition.split("==")[1].strip()
    return F.lit(True)


def playbook_steps(triggers: DataFrame, playbooks: list[dict] | None = None, data: str = "data") -> DataFrame:
    """Steps of each triggered playbook with resolved target and condition outcome."""
    books = fv.PLAYBOOKS if playbooks is None else playbooks
    arms = []
    for pb in books:
        steps = []
        for i, s in enumerate(pb["steps"]):
            target = F.lit(s["target"]) if s["target"] else (
                F.coalesce(_path(s["target_from"], data), F.lit("")) if s["target_from"] else F.lit(""))
            steps.append(F.struct(F.lit(i).alias("step_index"), F.lit(s["action"]).alias("action"), target.alias("target"),
                                  _step_condition(s["condition"], data).alias("condition_met")))
        arms.append(F.when(F.col("playbook_id") == pb["id"], F.array(*steps)))
    return triggers.withColumn("_s", F.explode(F.coalesce(*arms))).select(
        *triggers.columns, "_s.step_index", "_s.action", "_s.target", "_s.condition_met")


# --- J-14, J-19, J-22 --------------------------------------------------------------------------
def timeline_causality(events: DataFrame, as_of: bool = False) -> DataFrame:
    """Parent event of each process event: the last event of the parent pid on the host.

    ``as_of`` only looks back from the child.
    """
    procs = events.where("sensor = 'process'")
    if as_of:
        from wardline.operators.graph import last_process_node
        return last_process_node(events, "ppid", "parent_event_id").where("sensor = 'process'")
    last = procs.groupBy("host", "pid").agg(F.max(F.struct("ts_us", "seq", "event_id"))["event_id"].alias("parent_event_id"))
    return salted_join(procs, last.withColumnRenamed("pid", "ppid"), ["host", "ppid"], "left")


def entity_links(entities: DataFrame, member: str = "incident_id", order: str = "ord") -> DataFrame:
    """Members of each shared entity linked to its first member (a star, not all pairs)."""
    hub = entities.groupBy("entity").agg(F.min(F.struct(order, member)).alias("_hub"), F.count(F.lit(1)).alias("_n")) \
        .where("_n > 1").select("entity", F.col(f"_hub.{member}").alias("hub"))
    return salted_join(entities, hub, ["entity"], "inner").where(F.col(member) != F.col("hub")).select(member, "hub", "entity")


def hash_baseline_mismatch(baseline: DataFrame, current: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """Baseline rows that are missing or differ now."""
    now = current.select(key, F.col(value).alias("_now"))
    return baseline.join(now, key, "left").where(F.col("_now").isNull() | (F.col("_now") != F.col(value))).select(
        key, F.when(F.col("_now").isNull(), "missing").otherwise("modified").alias("finding"))
