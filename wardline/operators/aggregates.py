"""Roll-ups (A-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as fv


def value_entropy(df: DataFrame, keys: list[str], value: str, name: str = "entropy") -> DataFrame:
    """Entropy of the value distribution of each group.

    Values are counted first (map-side combined), so the second aggregate sees
    one row per distinct value.  H = log2(N) − Σ k·log2(k) / N needs one pass.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    n = F.sum("_k")
    bits = F.log2(n) - F.sum(F.col("_k") * F.log2("_k")) / n
    return counts.groupBy(*keys).agg((F.round(bits, 4) + 0.0).alias(name))


def row_counts(df: DataFrame, by: str | None = None) -> DataFrame:
    """Total or per-value row count."""
    return df.agg(F.count(F.lit(1)).alias("n")) if by is None else df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def zero_filled_counts(df: DataFrame, dimensions: dict[str, list[str]]) -> DataFrame:
    """(dimension, value, n) for every listed value, plus the total, in one pass.

    One grouping-sets aggregate replaces a count query per value.
    """
    names = list(dimensions)
    sets = [[F.col(n)] for n in names] + [[]]
    grouped = df.groupingSets(sets, *names).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*names).alias("_g"))
    total = 2 ** len(names) - 1
    labelled = grouped.select(
        F.coalesce(*[F.when(F.col("_g") == total - 2 ** (len(names) - 1 - i), F.lit(n)) for i, n in enumerate(names)],
                   F.lit("total")).alias("dimension"),
        F.coalesce(*[F.when(F.col("_g") == total - 2 ** (len(names) - 1 - i), F.col(n)) for i, n in enumerate(names)],
                   F.when(F.col("_g") == total, F.lit("all"))).alias("value"), "n")
    wanted = [(n, v) for n, values in dimensions.items() for v in values] + [("total", "all")]
    enum = df.sparkSession.createDataFrame(wanted, "dimension STRING, value STRING")
    return F.broadcast(enum).join(labelled, ["dimension", "value"], "left").select(
        "dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))


def alert_breakdown(alerts: DataFrame) -> DataFrame:
    return zero_filled_counts(alerts, {"severity": fv.SEVERITIES, "status": fv.ALERT_STATUSES})


def incident_breakdown(incidents: DataFrame) -> DataFrame:
    return zero_filled_counts(incidents, {"status": fv.INCIDENT_STATUSES})


def execution_breakdown(executions: DataFrame) -> DataFrame:
    return zero_filled_counts(executions, {"status": fv.EXECUTION_STATUSES})


def home_stats(events: DataFrame, alerts: DataFrame, incidents: DataFrame, executions: DataFrame, as_of_us: int) -> DataFrame:
    """Exact 24-hour and open counts in one row."""
    since = as_of_us - 86_400_000_000
    recent = (F.col("ts_us") >= since)
    names = ["events_24h", "alerts_24h", "incidents_open", "responses_total"]

    def part(df, name, test):
        return df.agg(F.count_if(test).alias("_n")).select(
            *[(F.col("_n") if n == name else F.lit(0)).cast("bigint").alias(n) for n in names])

    rows = part(events, names[0], recent).unionByName(part(alerts, names[1], recent)).unionByName(
        part(incidents, names[2], F.col("status") == "open")).unionByName(part(executions, names[3], F.lit(True)))
    return rows.agg(*[F.sum(n).alias(n) for n in names])


def sensor_status(events: DataFrame) -> DataFrame:
    """Dashboard sensors with their event count and activity."""
    known = [(n, n in fv.SENSORS) for n in fv.DASHBOARD_SENSORS]
    dim = events.sparkSession.createDataFrame(known, "sensor STRING, known BOOLEAN")
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(dim).join(row_counts(events, "sensor"), "sensor", "left").select(
        "sensor", F.when(F.col("known"), n).otherwise(0).alias("event_count"),
        F.when(~F.col("known"), "unknown").when(n > 0, "active").otherwise("idle").alias("status"))


def severity_badges(alerts: DataFrame) -> DataFrame:
    s = F.col("severity")
    return alerts.agg(F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"),
                      F.count_if(s == "medium").alias("medium"), F.count_if(s.isin("low", "info")).alias("low"))


def ioc_by_type(iocs: DataFrame) -> DataFrame:
    kind = F.col("ioc_type")
    return iocs.agg(*[F.count_if(kind == t).alias(f"{t}_count") for t in ("ip", "domain", "hash")],
                    F.count(F.lit(1)).alias("total"))


def flow_stats(connections: DataFrame, width_us: int = 30_000_000, keys: list[str] | None = None) -> DataFrame:
    """Connection statistics per key and window.

    Equal connections are counted once, map-side; every measure is an aggregate of
    those counts, which Spark computes and shuffles once for all of them.
    """
    keys = keys or ["host"]
    k = [*keys, "window_us"]
    rows = connections.withColumn("window_us", F.floor(F.col("ts_us") / width_us).cast("bigint") * width_us)
    tuples = rows.groupBy(*k, "remote_ip", "remote_port", "conn_status", "protocol").agg(F.count(F.lit(1)).alias("_n"))
    # Conditions stay inside the aggregates and every branch reads the count: a
    # pushed filter or a pruned count would make the branch scan the events again
    base = tuples.groupBy(*k).agg(F.sum("_n").alias("total_connections"))
    known = (F.length("remote_ip") > 0) & (F.col("_n") > 0)
    ips = tuples.groupBy(*k, "remote_ip").agg(F.sum("_n").alias("_n"))
    first = tuples.groupBy(*keys, "remote_ip").agg(F.min("window_us").alias("window_us"), F.sum("_n").alias("_n"))
    ports = tuples.groupBy(*k, "remote_port").agg(F.sum("_n").alias("_n"))
    open_port = F.col("remote_port") > 0
    n = F.sum(F.when(open_port, F.col("_n")))
    port_agg = ports.groupBy(*k).agg(
        F.count_if(open_port).alias("unique_remote_ports"),
        (F.round(F.log2(n) - F.sum(F.when(open_port, F.col("_n") * F.log2("_n"))) / n, 4) + 0.0).alias("port_entropy"))
    mapped = lambda c, name: tuples.groupBy(*k, c).agg(F.sum("_n").alias("_n")).groupBy(*k).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "_n")))).alias(name))
    return (
        base.join(ips.groupBy(*k).agg(F.count_if(known).alias("unique_remote_ips")), k, "left")
        .join(port_agg, k, "left")
        .join(first.groupBy(*k).agg(F.count_if(known).alias("new_destination_rate")), k, "left")
        .join(mapped("conn_status", "connections_by_status"), k, "left")
        .join(mapped("protocol", "connections_by_protocol"), k, "left")
        .na.fill(0, ["unique_remote_ips", "unique_remote_ports", "new_destination_rate"])
        .na.fill(0.0, ["port_entropy"])
    )


def eventlog_features(log: DataFrame, width_us: int = 15_000_000, message: str = "cmdline") -> DataFrame:
    """Failed logins, privilege use, services, encoded commands and the severity ladder per host and window."""
    from wardline.functions.text import decode_powershell

    code = F.col("code")
    rows = log.withColumn("window_us", F.floor(F.col("ts_us") / width_us).cast("bigint") * width_us)
    decoded = F.coalesce(F.length(decode_powershell(F.col(message))) > 0, F.lit(False))
    out = rows.groupBy("host", "window_us").agg(
        F.count_if(code == 4625).alias("failed_login_rate"),
        F.count_if(code.isin(4672, 4648)).alias("privilege_escalation_events"),
        F.count_if(code == 7045).alias("new_service_count"),
        F.count_if((code == 4104) & decoded).alias("encoded_powershell_count"),
        F.count(F.lit(1)).alias("total_events_collected"),
    ).withColumn("brute_force_detected", F.col("failed_login_rate") >= 5)
    return out.withColumn("severity", (
        F.when(F.col("brute_force_detected") | (F.col("encoded_powershell_count") > 0), "high")
        .when((F.col("new_service_count") > 0) | (F.col("privilege_escalation_events") > 0), "medium")
        .when(F.col("failed_login_rate") > 0, "low").otherwise("info")))


def file_change_stats(changes: DataFrame, keys: list[str], elapsed_s: float, canary_alerts: int = 0) -> DataFrame:
    """Roll-up of a file diff (columns change, path, entropy) per ``keys``."""
    from wardline.functions.scoring import critical_path

    ext = F.lower(F.regexp_extract(F.regexp_extract("path", r"([^\\/]*)$", 1), r"[^.](\.[^.]+)$", 1))
    rows = changes.withColumn("_ext", ext).withColumn("_crit", critical_path(F.col("path")))
    minutes = max(elapsed_s, 1.0) / 60.0
    live = F.col("change").isin("created", "modified")
    agg = rows.groupBy(*keys).agg(
        F.count_if(F.col("change") == "created").alias("files_new"),
        F.count_if(F.col("change") == "modified").alias("files_modified"),
        F.count_if(F.col("change") == "deleted").alias("files_deleted"),
        F.count(F.lit(1)).alias("total_changes"),
        F.round(F.count(F.lit(1)) / minutes, 2).alias("files_changed_per_minute"),
        F.count_distinct("_ext").alias("file_types_changed"),
        F.round(F.greatest(F.lit(0.0), F.coalesce(F.avg(F.when(live, F.col("entropy"))), F.lit(0.0)) - 4.0), 4)
        .alias("entropy_increase_rate"),
        F.count_if("_crit").alias("critical_dir_changes"))
    return agg.withColumn("severity", F.when(F.lit(canary_alerts > 0), "critical")
                          .when(F.col("critical_dir_changes") > 0, "high")
                          .when(F.col("total_changes") > 50, "medium").otherwise("info"))


def incident_techniques(alerts: DataFrame) -> DataFrame:
    """Techniques of each incident in order of first appearance (one row each)."""
    pos = alerts.select("incident_id", "ts_us", "seq", F.posexplode("mitre_ids").alias("_pos", "technique_id"))
    first = pos.groupBy("incident_id", "technique_id").agg(F.min(F.struct("ts_us", "seq", "_pos")).alias("first_at"))
    return first


def incident_entities(alerts: DataFrame) -> DataFrame:
    """Distinct (incident, entity) links; the entity set of a hot incident stays distributed."""
    return alerts.select("incident_id", F.explode("entities").alias("entity")).distinct()


def incident_rollup(alerts: DataFrame) -> DataFrame:
    """One row per incident: severity, ordered technique chain, entity count, span and title.

    The chain is bounded by the number of techniques; entities are counted here
    and listed by :func:`incident_entities`.
    """
    from wardline.functions.scoring import severity_weight

    base = alerts.groupBy("incident_id").agg(
        F.max(F.struct(severity_weight(F.col("severity")).alias("w"), F.col("severity").alias("s")))["s"].alias("severity"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("alert_count"),
        F.min(F.struct("ts_us", "seq", "title"))["title"].alias("_title"))
    chain = incident_techniques(alerts).groupBy("incident_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first_at", "technique_id"))), lambda s: s["technique_id"]).alias("mitre_chain"))
    entities = incident_entities(alerts).groupBy("incident_id").agg(F.count(F.lit(1)).alias("entity_count"))
    title = F.when(F.col("alert_count") >= 2, F.concat(F.lit("Incident: "), "alert_count", F.lit(" related alerts"))) \
        .otherwise(F.concat(F.lit("Incident: "), "_title"))
    return base.join(chain, "incident_id", "left").join(entities, "incident_id", "left").select(
        "incident_id", title.alias("title"), "severity", "first_us", "last_us", "alert_count",
        F.coalesce("mitre_chain", F.array().cast("array<string>")).alias("mitre_chain"),
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


def incident_stats(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "open").alias("active"),
                         F.count_distinct("incident_id").alias("stored"))


DNA_SETS = {"files": "file", "endpoints": "endpoint", "children": "child", "dlls": "dll", "registry": "registry_key"}


def process_dna_members(events: DataFrame) -> DataFrame:
    """Distinct (process_hash, kind, value) of the five sets of :data:`DNA_SETS`, all of them; a busy program's members stay rows."""
    return events.select("process_hash", F.explode(F.array_compact(F.array(*[
        F.when(F.length(F.col(c)) > 0, F.struct(F.lit(s).alias("kind"), F.col(c).alias("value")))
        for s, c in DNA_SETS.items()]))).alias("m")).select("process_hash", "m.kind", "m.value").distinct()


def process_dna(events: DataFrame) -> DataFrame:
    """Behaviour profile per executable hash: size ``n_…`` and least member ``first_…`` of each of the five sets.

    The members are rows of :func:`process_dna_members`.
    """
    from wardline.functions.scoring import sigmoid_confidence

    base = events.groupBy("process_hash").agg(
        F.min("process_name").alias("process_name"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("observations")).withColumn("confidence", sigmoid_confidence(F.col("observations")))
    sets = process_dna_members(events).groupBy("process_hash").agg(*[
        e for s in DNA_SETS for e in (F.count_if(F.col("kind") == s).alias(f"n_{s}"), F.min(F.when(F.col("kind") == s, F.col("value"))).alias(f"first_{s}"))])
    return base.join(sets, "process_hash", "left").select(
        *base.columns, *[e for s in DNA_SETS for e in (F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}"), F.col(f"first_{s}"))])


def reputation_delta(ioc_match: Column, total_connections: Column, first_contact: Column, port: Column,
                     name_entropy: Column, tls_valid: Column, history_days: Column) -> Column:
    """Score change of one observation."""
    part = lambda test, by: F.when(F.coalesce(test, F.lit(False)), by).otherwise(0.0)
    return (part(ioc_match, 10.0) + part(total_connections > 100, -10.0) + part(first_contact, -5.0)
            + part(~port.isin(*fv.STANDARD_PORTS), -3.0) + part(name_entropy > 4.0, -2.0)
            + part(tls_valid, 5.0) + part(~tls_valid, -5.0) + part(history_days > 7, 2.0))


def _clamp_fold(steps: Column) -> Column:
    """Compose ``x → min(hi, max(lo, x + d))`` maps in order into one such map."""
    start = F.struct(F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))

    def then(f, g):
        bound = lambda v: F.least(g["hi"], F.greatest(g["lo"], v + g["d"]))
        return F.struct((f["d"] + g["d"]).alias("d"), bound(f["lo"]).alias("lo"), bound(f["hi"]).alias("hi"))

    return F.aggregate(steps, start, then)


def reputation_fold(observations: DataFrame, start: float = 50.0, block_bits: int = 10) -> DataFrame:
    """Running score per address, clamped to [0, 100] at every observation in time order.

    Clamped additions compose.  Rows are dealt in order of (address, time), so a busy address is spread over tasks, and
    numbered there; blocks of ``2**block_bits`` neighbours become one map, blocks of those another, and so on.  No
    array is longer than a block, but for the last: at most eight maps from each task that holds the address.
    """
    step = F.struct(F.col("delta").alias("d"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"))
    order = ["address", "ts_us", "seq"]
    # the number is (task, place in it), so neighbours in number are neighbours in time
    level = observations.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "address", F.monotonically_increasing_id().alias("at"), step.alias("f"),
        F.col("ts_us").alias("a"), F.col("ts_us").alias("b"), F.lit(1).cast("bigint").alias("n"))
    composed = _clamp_fold(F.transform(F.sort_array(F.collect_list(F.struct("at", "f"))), lambda s: s["f"])).alias("f")
    outer = [F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")]
    for _ in range(-(-30 // block_bits)):  # until a block holds 2**30 of the at most 2**33 rows of a task
        level = level.withColumn("block", F.shiftright("at", block_bits)).groupBy("address", "block").agg(
            composed, *outer).withColumnRenamed("block", "at")
    whole = level.groupBy("address").agg(composed, *outer)
    f = F.col("f")
    return whole.select("address", F.least(f["hi"], F.greatest(f["lo"], F.lit(start) + f["d"])).alias("score"),
                        F.col("a").alias("first_us"), F.col("b").alias("last_us"), F.col("n").alias("total_connections"))


def feedback_multiplier(feedback: DataFrame) -> DataFrame:
    """Suppression factor per alert type and sensor from user dismissals."""
    counts = feedback.groupBy("alert_type", "sensor").agg(
        F.count_if(F.col("action") == "dismiss").alias("dismissals"),
        F.count_if(F.col("action") == "investigate").alias("investigations"))
    return counts.withColumn("multiplier", F.when((F.col("dismissals") >= 3) & (F.col("investigations") == 0), 0.5)
                             .when(F.col("dismissals") >= 2, 0.75).otherwise(1.0))


def _errors_since_success(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Errors after the last success of each key: two aggregates, no window."""
    from wardline.operators.segmented import salted_join

    at = F.struct(*order)
    last = runs.groupBy(key).agg(F.max(F.when(F.col("ok") == 1, at)).alias("_last"))
    failed = salted_join(runs.where("ok = 0"), last, [key], "inner").where(
        F.col("_last").isNull() | (at > F.col("_last")))
    return failed.groupBy(key).agg(F.count(F.lit(1)).alias("consecutive_errors"), F.max_by("error", at).alias("last_error"))


def feed_health(runs: DataFrame, as_of_us: int, threshold_us: int = 7_200_000_000) -> DataFrame:
    """State of each feed: never-updated or old feeds are stale, errors since the last success win."""
    at = F.struct("ts_us", "run_id")
    good = F.col("ok") == 1
    base = runs.groupBy("feed_name").agg(
        F.max(F.when(good, F.col("ts_us"))).alias("last_update_us"),
        F.max_by("n_iocs", F.when(good, at)).alias("last_update_count"),
        F.count_if(good).alias("total_updates"), F.sum(F.when(good, F.col("n_iocs")).otherwise(0)).alias("total_iocs_added"))
    out = base.join(_errors_since_success(runs, "feed_name", ["ts_us", "run_id"]), "feed_name", "left")
    stale = F.col("last_update_us").isNull() | (F.lit(as_of_us) - F.col("last_update_us") > threshold_us)
    errors = F.coalesce("consecutive_errors", F.lit(0))
    return out.select("feed_name", "last_update_us", F.when(F.col("last_update_us").isNotNull(), F.col("last_update_count")).alias("last_update_count"),
                      "total_updates", "total_iocs_added", errors.alias("consecutive_errors"),
                      F.coalesce("last_error", F.lit("")).alias("last_error"), stale.alias("is_stale"),
                      F.when(errors > 0, "errored").when(stale, "stale").otherwise("healthy").alias("state"))


def feed_health_summary(health: DataFrame) -> DataFrame:
    return health.agg(F.count(F.lit(1)).alias("total_feeds"),
                      *[F.count_if(F.col("state") == s).alias(s) for s in ("healthy", "stale", "errored")])


def sensor_health(runs: DataFrame, as_of_us: int) -> DataFrame:
    """Events emitted, errors, errors since the last good run and the emission rate."""
    base = runs.groupBy("sensor").agg(
        F.sum(F.when(F.col("ok") == 1, F.col("n_events")).otherwise(0)).alias("events_emitted"),
        F.count_if(F.col("ok") == 0).alias("errors"), F.min("ts_us").alias("started_us"))
    out = base.join(_errors_since_success(runs, "sensor", ["ts_us", "run_id"]), "sensor", "left")
    elapsed = (F.lit(as_of_us) - F.col("started_us")) / 1e6
    return out.select("sensor", "events_emitted", "errors", F.coalesce("consecutive_errors", F.lit(0)).alias("consecutive_errors"),
                      F.when((elapsed > 0) & (F.col("events_emitted") > 0), F.col("events_emitted") / elapsed).otherwise(0.0).alias("events_per_second"))


def canary_status(canaries: DataFrame) -> DataFrame:
    s = F.col("status")
    return canaries.agg(F.count(F.lit(1)).alias("total_deployed"), F.count_if(s == "deployed").alias("healthy"),
                        F.count_if(s.isin("triggered", "missing")).alias("triggered"),
                        F.count_if(s == "error").alias("errors"), F.max("last_verified_us").alias("last_verification_us"))


def technique_transitions(chains: DataFrame) -> DataFrame:
    """Counts of consecutive technique pairs; joined on (chain, position), so long chains spread."""
    nxt = chains.select("chain_id", (F.col("pos") - 1).alias("pos"), F.col("technique_id").alias("next_technique"))
    return chains.join(nxt, ["chain_id", "pos"]).groupBy("technique_id", "next_technique").agg(F.count(F.lit(1)).alias("n"))


def top_rules(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "alert_type").limit(n)


def daily_summary(alerts: DataFrame, iocs: DataFrame, events: DataFrame, day_start_us: int, top: int = 10) -> DataFrame:
    """(section, key, n) rows: alert counts, leading rules, new indicators and active sensors of one day."""
    end = day_start_us + 86_400_000_000
    on_day = lambda df, c: df.where((F.col(c) >= day_start_us) & (F.col(c) < end))
    today = on_day(alerts, "ts_us")
    as_rows = lambda df, section, key: df.select(F.lit(section).alias("section"), F.col(key).alias("key"), "n")
    return (as_rows(row_counts(today, "severity"), "alerts", "severity")
            .unionByName(as_rows(top_rules(today, top), "top_rules", "alert_type"))
            .unionByName(as_rows(row_counts(on_day(iocs, "first_us"), "ioc_type"), "new_iocs", "ioc_type"))
            .unionByName(as_rows(row_counts(on_day(events, "ts_us"), "sensor"), "sensors", "sensor")))


def learn_baseline(events: DataFrame, start_us: int, days: int = 7, min_observations: int = 3) -> DataFrame:
    """Values seen often enough in the learning period, as whitelist entries."""
    seen = baseline_observations(events, start_us, days)
    return seen.where(F.col("n") >= min_observations).select(
        "entry_type", "value", F.concat(F.lit("Auto-baseline ("), "n", F.lit(" observations)")).alias("reason"),
        F.lit("auto_baseline").alias("added_by"))


def baseline_observations(events: DataFrame, start_us: int, days: int = 7) -> DataFrame:
    from wardline.operators.rules import typed_values

    period = events.where((F.col("ts_us") >= start_us) & (F.col("ts_us") < start_us + days * 86_400_000_000))
    pairs = period.select(F.explode(typed_values(events)).alias("p")).select("p.entry_type", "p.value")
    return pairs.where("entry_type <> 'device'").groupBy("entry_type", "value").agg(F.count(F.lit(1)).alias("n"))


def learning_progress(events: DataFrame, start_us: int, as_of_us: int, days: int = 7) -> DataFrame:
    elapsed = (as_of_us - start_us) / 86_400_000_000
    done = min(elapsed, days)
    seen = baseline_observations(events.where(F.col("ts_us") < as_of_us), start_us, days)
    return seen.agg(
        F.lit("active" if elapsed < days else "ready").alias("status"), F.lit(round(done, 1)).alias("days_elapsed"),
        F.lit(round(max(0, days - done), 1)).alias("days_remaining"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_observations"), F.count(F.lit(1)).alias("unique_values"))


def task_run_stats(runs: DataFrame) -> DataFrame:
    """Runs and errors per task with the overall total (task NULL)."""
    return runs.rollup("task").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("ok") == 0).alias("errors"),
        F.max(F.struct("ts_us", "run_id", "result"))["result"].alias("last_result"))


def response_stats(triggers: DataFrame, incidents: DataFrame, alerts: DataFrame, min_alerts: int = 3) -> DataFrame:
    """Responses routed, playbooks triggered and incident reports due."""
    due = (F.col("alert_count") >= min_alerts) | F.col("severity").isin("high", "critical")
    names = ["responses_total", "playbooks_triggered", "reports_due"]

    def part(df, name, test):
        return df.agg(F.count_if(test).alias("_n")).select(
            *[(F.col("_n") if n == name else F.lit(0)).cast("bigint").alias(n) for n in names])

    return part(alerts, names[0], F.lit(True)).unionByName(part(triggers, names[1], F.lit(True))).unionByName(
        part(incidents, names[2], due)).agg(*[F.sum(n).alias(n) for n in names])


def execution_completion(steps: DataFrame) -> DataFrame:
    """An execution is completed when every step is executed, skipped or failed."""
    return steps.groupBy("execution_id").agg(
        F.bool_and(F.col("status").isin("executed", "skipped", "failed")).alias("completed"),
        F.count(F.lit(1)).alias("n_steps"))


def execution_stats(executions: DataFrame) -> DataFrame:
    return executions.agg(F.count_if(F.col("status") == "running").alias("running"), F.count(F.lit(1)).alias("total"))


def health_report(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, metric, value) rows from one-row or grouped metric tables."""
    parts = []
    for section, df in sections.items():
        numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double")]
        label = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
        head = F.concat_ws(".", *label, F.lit("")) if label else F.lit("")
        parts.append(df.select(F.lit(section).alias("section"), F.explode(F.array(*[
            F.struct(F.concat(head, F.lit(n)).alias("metric"), F.col(n).cast("double").alias("value")) for n in numeric])).alias("m")
        ).select("section", "m.metric", "m.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
